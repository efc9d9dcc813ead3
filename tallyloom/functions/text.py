"""Identifiers, labels, links, canonical text and export cells."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.constants import PARAMETER_ANCHORS

# Identifier patterns of the record formats.
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
MODEL_KEY = r"^[A-Za-z0-9][A-Za-z0-9._-]*__[A-Za-z0-9][A-Za-z0-9._-]*$"
DATASET_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9][A-Za-z0-9._-]*$"
COMMIT = r"^[0-9a-f]{40}$"
DIGEST = r"^[0-9a-f]{64}$"

HUB_HOST = "huggingface.co"


def matches(value: Column, pattern: str) -> Column:
    """Full match. `$` would also accept a final line feed, so that is ruled out first."""
    return F.coalesce(value.rlike(pattern) & ~value.contains("\n"), F.lit(False))


def is_safe_id(value: Column) -> Column:
    return matches(value, SAFE_ID)


def canonical_text(json: Column) -> Column:
    """A JSON string verbatim; any other JSON value compact with sorted keys."""
    parsed = F.try_parse_json(json)
    is_text = F.schema_of_variant(parsed) == "STRING"
    return F.when(is_text, F.try_variant_get(parsed, "$", "string")).otherwise(F.to_json(parsed))


def revision_key(repository: Column, revision: Column) -> Column:
    return F.sha2(F.concat(repository, F.lit("@"), revision), 256)


def flattened(text: Column) -> Column:
    """Whitespace runs become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def text_key(text: Column) -> Column:
    return F.sha2(flattened(text), 256)


def benchmark_label(benchmark_id: Column, task: Column) -> Column:
    suffix = F.concat(F.lit("-"), task, F.lit(r"-test-v\d+$"))
    return F.translate(F.regexp_replace(benchmark_id, suffix, F.lit("")), "-", " ")


def model_label(
    display_name: Column,
    adapter: Column,
    model_id: Column,
    family_labels: Mapping[str, str] | None = None,
    hidden_owner: str = "",
) -> Column:
    """The display name, else the model id without `hidden_owner`.

    `family_labels` maps an adapter to the prefix of its models' labels.
    """
    parts = F.filter(F.split(model_id, "/"), lambda p: p != "")
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    tail = F.when(last == "checkpoint", F.coalesce(before, model_id)).otherwise(
        F.coalesce(last, model_id)
    )
    label = model_id
    if hidden_owner:
        at = F.instr(model_id, hidden_owner)
        rest = F.substring(model_id, at + len(hidden_owner), F.length(model_id))
        without = F.concat(F.substring(model_id, F.lit(1), at - 1), rest)
        label = F.when(at > 0, without).otherwise(model_id)
    for name, prefix in (family_labels or {}).items():
        label = F.when(adapter == name, F.concat(F.lit(prefix), tail)).otherwise(label)
    return F.coalesce(F.when(display_name != "", display_name), label)


def _path_parts(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.filter(F.split(path, "/"), lambda p: p != "")


def _is_model_path(parts: Column) -> Column:
    return (F.size(parts) >= 2) & ~F.get(parts, F.lit(0)).isin("datasets", "spaces")


def hub_label(url: Column) -> Column:
    """owner/model, with the checkpoint folder of a tree link; escapes are decoded."""
    # `+` stays itself in a path, so it is escaped before decoding.
    parts = F.transform(
        _path_parts(url), lambda p: F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
    )
    readable = F.forall(parts, lambda p: p.isNotNull())
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    folder = F.when(
        F.get(parts, F.lit(2)) == "tree", F.slice(parts, 5, F.greatest(F.size(parts), F.lit(1)))
    ).otherwise(F.array().cast("array<string>"))
    ok = (host == HUB_HOST) & scheme.isin("http", "https") & _is_model_path(parts) & readable
    return F.when(ok, F.array_join(F.concat(F.slice(parts, 1, 2), folder), "/"))


def hub_id(url: Column) -> Column:
    """owner/model of an https link to the model's root page, else NULL."""
    parts = F.split(
        F.trim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), "/"
    )
    named = F.forall(parts, lambda p: p.rlike(r"^[\w.-]+$"))
    ok = (
        (F.try_parse_url(url, F.lit("PROTOCOL")) == "https")
        & (F.try_parse_url(url, F.lit("AUTHORITY")) == HUB_HOST)
        & (F.size(parts) == 2)
        & _is_model_path(parts)
        & named
    )
    return F.when(ok, F.array_join(parts, "/"))


def is_link(url: Column) -> Column:
    """http(s) with a host."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(scheme.isin("http", "https") & (F.length(host) > 0), F.lit(False))


def is_evidence_link(url: Column) -> Column:
    """http(s) with a host and without credentials."""
    user = F.coalesce(F.try_parse_url(url, F.lit("USERINFO")), F.lit(""))
    return is_link(url) & user.isin("", ":")


def format_parameters(count: Column) -> Column:
    return (
        F.when(count.isNull(), F.lit("N/A"))
        .when(count >= 10**9, F.format_string("%.3fB", count / F.lit(1e9)))
        .when(count >= 10**6, F.format_string("%.3fM", count / F.lit(1e6)))
        .otherwise(F.format_string("%,d", count))
    )


def parameter_value(position: Column) -> Column:
    """Parameter count at a 0-100 position, linear between the anchors."""
    segment = F.least(F.lit(4), F.floor(position / F.lit(20.0)).cast("int"))
    anchors = F.array(*[F.lit(a) for a in PARAMETER_ANCHORS])
    low, high = F.get(anchors, segment), F.get(anchors, segment + 1)
    return low + (high - low) * (position / F.lit(20.0) - segment)


def parameter_label(position: Column) -> Column:
    value = parameter_value(position)
    millions = F.concat(F.floor(value / 1e6 + 0.5).cast("bigint").cast("string"), F.lit("M"))
    billions = F.regexp_replace(F.format_string("%.2f", value / F.lit(1e9)), r"\.?0+$", "")
    return (
        F.when(position == 0, F.lit("<50M"))
        .when(position == 100, F.lit("35B+"))
        .when(value < 1e9, millions)
        .otherwise(F.concat(billions, F.lit("B")))
    )


def within_parameters(count: Column, low: float, high: float) -> Column:
    """Positions 0 and 100 are open ends; unknown counts drop out of an active range."""
    if low == 0 and high == 100:
        return F.lit(True)
    kept = count.isNotNull() & (count >= 0)
    if low != 0:
        kept = kept & (count >= parameter_value(F.lit(float(low))))
    if high != 100:
        kept = kept & (count <= parameter_value(F.lit(float(high))))
    return F.coalesce(kept, F.lit(False))


def exposure_label(entries: Column) -> Column:
    used = F.exists(entries, lambda e: e["relationship"] == "evaluation_examples")
    return (
        F.when(F.coalesce(F.size(entries), F.lit(0)) <= 0, F.lit("Unknown"))
        .when(used, F.lit("Evaluation examples used"))
        .otherwise(F.lit("Known domain"))
    )


def _replaced(value: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda v, pair: F.replace(v, F.lit(pair[0]), F.lit(pair[1])), pairs, value)


# The replacements of the report and Markdown exports, in order of use.
REPORT_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
    ("|", "&#124;"),
    ("\n", " "),
    ("\r", " "),
)
MARKDOWN_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ("\\", "\\\\"),
    ("|", "\\|"),
    ("`", "\\`"),
    ("*", "\\*"),
    ("_", "\\_"),
    ("[", "\\["),
    ("]", "\\]"),
    ("\r\n", "<br>"),
    ("\r", "<br>"),
    ("\n", "<br>"),
)
LINK_ESCAPES = (
    (" ", "%20"),
    ("\t", "%09"),
    ("\n", "%0A"),
    ("\r", "%0D"),
    ("<", "%3C"),
    (">", "%3E"),
    ("|", "%7C"),
    ("(", "%28"),
    (")", "%29"),
    ("\\", "%5C"),
)


def report_cell(value: Column) -> Column:
    return _replaced(value, REPORT_ESCAPES)


def csv_cell(value: Column) -> Column:
    """Quoted, and marked as text when a spreadsheet would read a formula."""
    safe = F.when(value.rlike(r"(?U)^[\s\uFEFF]*[=+@-]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def markdown_cell(value: Column) -> Column:
    return _replaced(value, MARKDOWN_ESCAPES)


def markdown_link(label: Column, url: Column, hub_url: Column) -> Column:
    """The hub link when there is one, else the site link, else the bare label."""
    chosen = F.coalesce(F.when(hub_url != "", hub_url), F.when(url != "", url))
    linked = F.concat(
        F.lit("["), markdown_cell(label), F.lit("]("), _replaced(chosen, LINK_ESCAPES), F.lit(")")
    )
    ok = F.coalesce(chosen.rlike(r"(?i)^https?://"), F.lit(False))
    return F.when(ok, linked).otherwise(markdown_cell(label))

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import decoding as D
from tallyloom.functions import scoring as S
from tallyloom.functions import text as X


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def lit_map(**values):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def options():
    pairs = (("a", 3.0), ("b", 1.0), ("c", 2.0))
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(v).alias("value")) for i, v in pairs])


def test_softmax_is_stable_and_rejects_missing(spark):
    ids = F.array(F.lit("a"), F.lit("b"))
    found = one(spark, D.softmax(ids, lit_map(a=-1000.0, b=-1001.0), 0.5))
    assert found == pytest.approx([1 / (1 + math.exp(-2)), math.exp(-2) / (1 + math.exp(-2))])
    assert one(spark, D.softmax(ids, lit_map(a=-1.0))) is None
    assert one(spark, D.softmax(ids, lit_map(a=-1.0, b=float("-inf")))) is None


def test_rounded_answers_are_bounded(spark):
    kept = one(spark, D.renormalized(lit_map(a=0.5001, b=0.5)))
    assert sum(kept.values()) == pytest.approx(1)
    assert one(spark, D.renormalized(lit_map(a=0.1, b=0.2))) is None
    assert one(spark, D.renormalized(lit_map(a=-0.1, b=1.1))) is None
    assert one(spark, D.renormalized(lit_map(a=0.0, b=0.0))) is None


def test_level_answers_follow_the_wanted_order(spark):
    raw = lit_map(**{"0": 0.2, "1": 0.3, "2": 0.5})
    assert one(spark, D.level_answer(options(), raw)) == {"a": 0.2, "b": 0.3, "c": 0.5}
    assert one(spark, D.level_answer(options(), raw, ascending=True)) == {"b": 0.2, "c": 0.3, "a": 0.5}
    assert one(spark, D.level_answer(options(), lit_map(**{"0": 0.2, "1": 0.8}))) is None


def test_probability_rules(spark):
    ids = F.array(F.lit("a"), F.lit("b"))
    cases = [({"a": 0.5, "b": 0.5}, True), ({"b": 0.4, "a": 0.600005}, True), ({"a": 0.4, "b": 0.60002}, False),
             ({"a": 1.0}, False), ({"a": 0.5, "c": 0.5}, False), ({"a": -0.5, "b": 1.5}, False),
             ({"a": float("nan"), "b": 0.5}, False)]
    for values, good in cases:
        assert one(spark, S.valid_probabilities(lit_map(**values), ids)) is good, values


def test_clip_keeps_null(spark):
    assert one(spark, S.clip_unit(F.lit(None).cast("double"))) is None
    assert one(spark, S.clip_unit(F.lit(-4.0))) == 0 and one(spark, S.clip_unit(F.lit(4.0))) == 1


def test_prediction_in_the_padding_has_no_area(spark):
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("left", 0.0), ("top", 0.2), ("right", 0.1), ("bottom", 0.8))])
    found = one(spark, S.restored_box(box, F.array(F.lit(280), F.lit(200)), F.array(F.lit(40), F.lit(0), F.lit(200), F.lit(200))))
    assert (found["left"], found["right"]) == (0.0, 0.0) and found["top"] == pytest.approx(0.2)


@pytest.mark.parametrize(
    ("value", "expected"),
    [("a.b-1", True), ("1", True), ("", False), (".a", False), ("a b", False), ("a\n", False), ("a/b", False)],
)
def test_identifiers(spark, value, expected):
    assert one(spark, X.is_safe_id(F.lit(value))) is expected


@pytest.mark.parametrize(
    ("json", "expected"),
    [('"text"', "text"), ('{"b": [1, "é"], "a": null}', '{"a":null,"b":[1,"é"]}'), ("[1, 2]", "[1,2]")],
)
def test_canonical_text(spark, json, expected):
    assert one(spark, X.canonical_text(F.lit(json))) == expected


def test_duplicate_json_keys_are_rejected(spark):
    assert one(spark, F.try_parse_json(F.lit('{"a":1,"a":2}')).isNull())
    assert one(spark, F.try_parse_json(F.lit('{"a":NaN}')).isNull())


@pytest.mark.parametrize(
    ("url", "label", "hub"),
    [("https://huggingface.co/o/m", "o/m", "o/m"),
     ("https://huggingface.co/o/m/tree/main/x/y", "o/m/x/y", None),
     ("http://huggingface.co/o/m", "o/m", None),
     ("https://huggingface.co/o/m%20x+y", "o/m x+y", None),
     ("https://huggingface.co/datasets/d", None, None),
     ("https://huggingface.co/o", None, None),
     ("https://example.com/o/m", None, None),
     ("not a url", None, None), (None, None, None)],
)
def test_hub_links(spark, url, label, hub):
    column = F.lit(url).cast("string")
    assert one(spark, X.hub_label(column)) == label
    assert one(spark, X.hub_id(column)) == hub


@pytest.mark.parametrize(
    ("url", "good"),
    [("https://e.com/a", True), ("http://e.com", True), ("ftp://e.com", False), ("https://u:p@e.com", False),
     ("https://u@e.com", False), ("https:///x", False), ("e.com", False)],
)
def test_evidence_links(spark, url, good):
    assert one(spark, X.is_evidence_link(F.lit(url))) is good


@pytest.mark.parametrize(
    ("position", "expected"),
    [(0, "<50M"), (10, "525M"), (20, "1B"), (30, "3B"), (50, "7.5B"), (100, "35B+"), (90, "27.5B")],
)
def test_parameter_positions(spark, position, expected):
    assert one(spark, X.parameter_label(F.lit(position))) == expected


@pytest.mark.parametrize(
    ("count", "expected"),
    [(None, "N/A"), (999, "999"), (12345, "12,345"), (1_500_000, "1.500M"), (7_000_000_000, "7.000B")],
)
def test_parameter_counts(spark, count, expected):
    assert one(spark, X.format_parameters(F.lit(count).cast("bigint"))) == expected


def test_spreadsheet_and_markdown_cells(spark):
    for text, expected in (("=1+1", "\"'=1+1\""), (" @S", "\"' @S\""), ("\u00a0=x", "\"'\u00a0=x\""), ('say "x"', '"say ""x"""'), ("1-2", '"1-2"')):
        assert one(spark, X.csv_cell(F.lit(text))) == expected
    assert one(spark, X.markdown_cell(F.lit("A|B\\C\n<s>"))) == "A\\|B\\\\C<br>&lt;s&gt;"
    link = X.markdown_link(F.lit("Site"), F.lit("https://e.com/m(v1)"), F.lit(""))
    assert one(spark, link) == "[Site](https://e.com/m%28v1%29)"
    assert one(spark, X.markdown_link(F.lit("None"), F.lit(None).cast("string"), F.lit(""))) == "None"


def test_open_ended_parameter_range(spark):
    assert one(spark, X.within_parameters(F.lit(None).cast("bigint"), 0, 100)) is True
    assert one(spark, X.within_parameters(F.lit(None).cast("bigint"), 20, 100)) is False
    assert one(spark, X.within_parameters(F.lit(10**12), 20, 100)) is True
    assert one(spark, X.within_parameters(F.lit(1), 0, 80)) is True

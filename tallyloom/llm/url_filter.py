"""Judge URLs: explicit host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything on the main path is a column expression or Spark ML on DataFrames. The trees learn from labelled URLs
(`url`, `blocked`); at most about `max_rows` of them are used, taken by a hash of the URL, so that the fit has a fixed
size bound. The suffix statistics and the overall rate count all labelled URLs; they are a written table with one row
per suffix. Judging covers every row.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and is scored by its
features like any other. Repeated rows are judged alike. An empty table gives an empty result. Labels of one kind
only (or none) give that kind's score to every URL without a rule. Extra columns are kept; the columns added here
(host, path, rule, verdict, score) replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.binding import let
from tallyloom.session import shared_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "n_url",
    "n_host",
    "n_path",
    "n_labels",
    "depth",
    "digit_ratio",
    "host_digit_ratio",
    "entropy",
    "n_parameters",
    "n_marks",
    "is_https",
    "has_fragment",
    "suffix_urls",
    "suffix_rate",
)
# Pseudo-observations at the overall rate, so that rare suffixes say little.
SUFFIX_PRIOR = 20.0


@dataclass(frozen=True)
class Rule:
    """`verdict` for a host, all its subdomains, and paths that start with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    """Fitted trees (None: the constant `prior`), the suffix statistics, and the rate, of all labelled URLs."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    prior: float


def url_host(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """`value(rule)` of the longest rule that fits, else null. The rules are a short list of the caller's."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of a text."""

    def over(n: Column) -> Column:
        def term(c: Column) -> Column:
            # The same divisor for the lengths of all characters, also those outside the basic plane.
            p = (n - F.length(F.replace(text, c, F.lit("")))) / n
            return -p * F.log2(p)

        letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
        return F.aggregate(F.transform(letters, term), F.lit(0.0), lambda a, b: a + b)

    return F.when(F.length(text) == 0, 0.0).otherwise(let(F.length(text), over))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features of `url`, without those of the suffix, under a `f_` prefix, and `f_suffix`."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = F.col("f_host"), F.col("f_path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    size = F.greatest(F.length(url), F.lit(1))
    columns = {
        "n_url": F.length(url),
        "n_host": F.length(host),
        "n_path": F.length(path),
        "n_labels": F.length(host) - F.length(F.translate(host, ".", "")),
        "depth": F.length(path) - F.length(F.translate(path, "/", "")),
        "digit_ratio": _count(url, r"[^0-9]") / size,
        "host_digit_ratio": _count(host, r"[^0-9]") / F.greatest(F.length(host), F.lit(1)),
        "entropy": _entropy(url),
        "n_parameters": F.when(query == "", 0).otherwise(1 + _count(query, r"[^&;]")),
        "n_marks": _count(url, r"[^-_%@~+,=]"),
        "is_https": url.startswith("https:").cast("int"),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
    }
    parts = urls.withColumns({"f_host": url_host(F.col("url")), "f_path": url_path(F.col("url"))})
    suffix = F.substring_index(host, ".", -2).alias("f_suffix")
    return parts.select("*", suffix, *[c.cast("double").alias(f"f_{k}") for k, c in columns.items()])


def _with_suffixes(features: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    """Adds how often the suffix was seen in training and its smoothed rate of blocked URLs."""
    seen = F.coalesce(F.col("f_seen"), F.lit(0.0))
    bad = F.coalesce(F.col("f_bad"), F.lit(0.0))
    # Spark sees the size of the written table; a large one is shuffled, and skewed parts are split.
    return features.join(suffixes, "f_suffix", "left").withColumns(
        {"f_suffix_urls": F.log1p(seen), "f_suffix_rate": (bad + SUFFIX_PRIOR * prior) / (seen + SUFFIX_PRIOR)}
    )


def _vectors(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="f_vector").transform(features)


def fit_url_model(
    labelled: DataFrame, max_rows: int = 20_000, trees: int = 10, depth: int = 3, seed: int = 7
) -> UrlModel:
    """Fit on labelled URLs (`url` string, `blocked` int). `max_rows` bounds the sample in expectation, to 10 %."""
    known = labelled.filter("url is not null and blocked is not null").select(
        "url", F.col("blocked").cast("double").alias("f_label")
    )
    rows, bad = known.agg(F.count("*"), F.sum("f_label")).first()
    if not rows or bad in (0, rows):
        return UrlModel(None, None, float(bool(bad)))
    share = min(1.0, max_rows / rows)
    picked = known.filter(F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    kinds = picked.agg(F.min("f_label"), F.max("f_label")).first()
    if kinds[0] == kinds[1]:
        return UrlModel(None, None, bad / rows)
    path = shared_path(known.sparkSession, "url-suffixes")
    suffix = F.substring_index(url_host(F.col("url")), ".", -2).alias("f_suffix")
    known.groupBy(suffix).agg(
        F.count("*").cast("double").alias("f_seen"), F.sum("f_label").alias("f_bad")
    ).write.parquet(path)
    suffixes = known.sparkSession.read.parquet(path)
    prior = bad / rows
    data = _vectors(_with_suffixes(lexical(picked), suffixes, prior)).select("f_vector", "f_label").coalesce(4)
    booster = GBTClassifier(
        featuresCol="f_vector", labelCol="f_label", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=seed
    )
    return UrlModel(booster.fit(data), suffixes, prior)


def _inner_names(columns: Sequence[str]) -> dict[str, str]:
    """What the caller's columns are called beside the features: those with a feature's prefix get another name."""
    taken, names = {c.lower() for c in columns}, {}
    for c in columns:
        name = c
        while name.lower().startswith("f_") or (name != c and name.lower() in taken):
            name = f"_{name}"
        taken.add(name.lower())
        names[c] = name
    return names


def judge_urls(urls: DataFrame, rules: Sequence[Rule], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """Every row with host, path, rule, verdict (`allow` or `block`) and the trees' score of being blocked."""
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "score")]
    inner = _inner_names(kept)
    given = urls.select(*[F.col(f"`{c}`").alias(inner[c]) for c in kept])
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    if model.trees is None:
        scored = given.withColumn("score", F.lit(model.prior))
    else:
        vectors = _vectors(_with_suffixes(lexical(given), model.suffixes, model.prior))
        trees = model.trees.setPredictionCol("").setRawPredictionCol("f_raw").setProbabilityCol("f_probability")
        scored = trees.transform(vectors).withColumn("score", vector_to_array("f_probability")[1])
    by_rule = matching_rule(host, path, rules, lambda r: r.verdict)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        *[F.col(f"`{inner[c]}`").alias(c) for c in kept],
        host.alias("host"),
        path.alias("path"),
        matching_rule(host, path, rules, lambda r: r.text).alias("rule"),
        F.coalesce(by_rule, by_model).alias("verdict"),
        "score",
    )

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.llm.queries import URL_RULES, labelled_urls
from tallyloom.llm.url_filter import UrlModel, fit_url_model, judge_urls, lexical

URLS = [
    None, "", "no scheme.net/x", "http://", "http://net/", "http://NET", "http://a.Example.NET:80/en/x?y#z", "http://example.net/de/",
    "http://example.network/en/", "https://x.example.com/de/1", "http://example.com/den", "ftp://org/fr/", "http://notorg/fr/",
    "http://a.org/fr/p#q://b.net/", "x://y://z", "http://ÄÖ.net/ü", "http://u@h.net?x=1&y=2/;z", "http://a.net/" + "9" * 3000, "://net/a b\n",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame(list(enumerate(URLS)) + [(0, None)], "page_id bigint, url string")
    for score, other in ((0.0, "allow"), (1.0, "block")):
        model = UrlModel(None, None, score)
        rows = judge_urls(frame.selectExpr("*", "'x' as host", "1 as f_host", "2 as _f_host", "3 as F_seen"), URL_RULES, model).collect()
        assert all((r["f_host"], r["_f_host"], r["F_seen"]) == (1, 2, 3) for r in rows)
        assert len(rows) == len(URLS) + 1
        for r in rows:
            host, path = parts(URLS[r["page_id"]])
            rule = rule_of(host, path)
            assert (r["host"], r["path"]) == (host, path)
            assert (r["rule"], r["verdict"]) == ((rule.text, rule.verdict) if rule else (None, other))


def test_features(spark):
    frame = spark.createDataFrame([(u,) for u in URLS if u], "url string")
    for r in lexical(frame).collect():
        url = r["url"]
        share = [n / len(url) for n in Counter(url).values()]
        assert math.isclose(r["f_entropy"], -sum(p * math.log2(p) for p in share), abs_tol=1e-9)
        assert r["f_n_url"] == len(url) and r["f_depth"] == parts(url)[1].count("/")
        assert math.isclose(r["f_digit_ratio"], len(re.findall("[0-9]", url)) / len(url))


def test_trees_learn_from_labelled_urls(spark):
    bad = [(f"http://shop{i}.cheap.biz/p?id={i * 7}&ref={i * 31}&utm={i}", 1) for i in range(150)]
    good = [(f"https://site.example.org/en/page-{'abcdefgh'[i % 8]}", 0) for i in range(150)]
    labelled = spark.createDataFrame(bad + good, "url string, blocked int")
    model = fit_url_model(labelled, trees=4)
    new = spark.createDataFrame([(f"http://shop{i}.cheap.biz/p?id={i}&ref=1", 1) for i in range(500, 530)] + [("https://site.example.org/en/page-z", 0)], "url string, blocked int")
    rows = judge_urls(new, [], model).collect()
    assert all((r["verdict"] == "block") == (r["blocked"] == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_nothing_or_one_kind_to_learn_from(spark):
    empty = spark.createDataFrame([], "url string, blocked int")
    assert fit_url_model(empty) == UrlModel(None, None, 0.0)
    assert fit_url_model(spark.createDataFrame([("a", 1), (None, 0)], "url string, blocked int")).prior == 1.0
    assert judge_urls(empty, URL_RULES, UrlModel(None, None, 0.0)).collect() == []


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([("http://a.b/en/12.html?x=9",), ("http://a.b/en/",), (None,), ("http://a5.b/en/13#4",)], "url string")
    labels = spark.createDataFrame([(12, 0, 0), (13, 1, 1), (4, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = labelled_urls(pages, labels).orderBy("url").collect()
    assert [tuple(r) for r in rows] == [("http://a.b/en/12.html?x=9", 1), ("http://a5.b/en/13#4", 1)]
    assert labelled_urls(pages, labels).filter(F.col("blocked") == 0).count() == 0


def test_suffixes_count_all_labelled_urls(spark):
    rows = [(f"http://a{i}.site{i % 300}.biz/p{i}", int(i % 300 < 100)) for i in range(3000)]
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    model = fit_url_model(labelled, max_rows=100, trees=2)
    seen = {r["f_suffix"]: (r["f_seen"], r["f_bad"]) for r in model.suffixes.collect()}
    assert seen == {f"site{k}.biz": (10.0, 10.0 * (k < 100)) for k in range(300)}
    assert math.isclose(model.prior, 1 / 3)

import pathlib
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from llm_helpers import documents, groups, prose, shingles
from tallyloom import session
from tallyloom.llm.bpe import read_ranks
from tallyloom.llm.queries import ORACLES, QUERIES
from tallyloom.session import RELEASE, written

SMALL = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


def test_stages_on_planted_documents(spark):
    line = "a line that many of the documents have in common, word for word"
    base = [prose(70 + i, 25) + "." for i in range(4)]
    rows = [(i, "\n".join([prose(i, 40) + ".", prose(900 + i, 40) + ".", line])) for i in range(30)]
    rows += [(50, "\n".join(base)), (51, "\n".join(base)), (52, None), (53, ""), (54, "123 456"), (55, "\n".join([*base, prose(8, 30)]))]
    near = prose(400, 120)
    rows += [(60, near), (61, near + " one more"), (61, near + " one more"), (None, prose(401, 50))]
    docs = documents(spark, rows).withColumnRenamed("n_chars", "n_chars")
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    kept = stages["language"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {52, 53, 54} & set(ids) and len(ids) == len(rows) - 3

    cut = {r["doc_id"]: r for r in stages["lines"](spark, docs, SMALL).collect()}
    assert line in cut[0]["text"] and all(line not in cut[i]["text"] for i in range(1, 30))
    assert 51 not in cut and cut[55]["text"] == prose(8, 30) and cut[55]["n_chars"] == len(prose(8, 30))

    one = stages["near-duplicates"](spark, docs, SMALL)
    found = [r["doc_id"] for r in one.collect()]
    sets = {-1 if d is None else d: shingles(t, 5) for d, t in rows}
    link = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert sorted(-1 if d is None else d for d in found) == sorted(set(groups(list(sets), link).values()))

    mixed = stages["mixture"](spark, docs, SMALL)
    assert mixed.columns == docs.columns and 0 < mixed.count() < len(rows)

    coded = stages["tokens"](spark, docs, SMALL).collect()
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in coded:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")


def shuffled(spark):
    """Names of the shuffle files of a local session."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for x in folders for f in pathlib.Path(x).rglob("shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    before, setting = shuffled(spark), spark.conf.get(RELEASE)
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    assert written(rows, f"{tmp_path}/rows").count() == 10
    assert spark.conf.get(RELEASE) == setting
    until = time.time() + 20  # files are removed in the background
    while made := [x for x in shuffled(spark) - before if x.endswith(".data")]:
        # The count above is one row of one task.
        if len(made) <= 1 or time.time() > until:
            break
        time.sleep(0.1)
    assert len(made) <= 1


def test_stages_leave_no_texts_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    docs = documents(spark, [(i, "\n".join(prose(10 * i + k, 400) for k in range(5))) for i in range(30)])
    for name in ("lines", "near-duplicates"):
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL).count() == 30
    kept = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert kept < 0.1 * sum(len(r["text"]) for r in docs.collect())


def test_run_over_the_small_table(spark):
    df = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "text", "n_tokens", "ids"} <= set(df.columns)
    assert 100 < df.count() <= 200

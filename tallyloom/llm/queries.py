"""The registered queries of this subpackage and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    ball_tree,
    bpe,
    jaccard_join,
    langid,
    lexical,
    line_dedup,
    mixing,
    order_minhash,
    preferences,
    quality,
    suffix_dedup,
    url_filter,
    whitening,
)
from tallyloom.llm.arrow import row_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rank_file() -> str:
    """The public multilingual byte-level vocabulary; read on the driver only."""
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


URL_RULES = (
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
)


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's URL carries the number of its document, whose labels say if it is to be blocked."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    doc = F.try_to_number(F.regexp_extract("url", r"://[^/?#]*/[^?#]*?(\d{1,18})(?!\d)", 1), F.lit("9" * 18))
    return (
        pages.select("url", doc.cast("bigint").alias("doc_id"))
        .join(labels.select("doc_id", bad.cast("int").alias("blocked")), "doc_id")
        .select("url", "blocked")
    )


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = langid.scored(docs.select("doc_id", "text"), langid.fit_by_folds(docs))
    held_out = (langid.fold(F.col("doc_id")) == 0).alias("held_out")
    return judged.select("doc_id", held_out, "lang_pred", "score", "cross_entropy", "rejected")


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lengths = F.transform("removed", lambda s: s["stop"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = preferences.conversations(table(spark, sf_dir, "conversations"))
    pairs = preferences.format_pairs(preferences.with_other_answer(talks))
    return pairs.select(
        "pair_id",
        "n_prompt_turns",
        F.md5("prompt").alias("prompt_md5"),
        F.md5("chosen_text").alias("chosen_md5"),
        F.md5("rejected_text").alias("rejected_md5"),
        preferences.spans_text(F.col("chosen_spans")).alias("chosen_spans"),
        preferences.spans_text(F.col("rejected_spans")).alias("rejected_spans"),
        "usable",
    )


ORACLES["op3_chat_format"] = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) as i,
             coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null),
l as (select conv_id, max(i) as last, max(i) filter (where role = 'assistant') as n from t group by conv_id),
o as (select xor(l.conv_id, 1) as conv_id, t.text from l join t on t.conv_id = l.conv_id and t.i = l.n),
p as (select l.conv_id, l.n, coalesce(l.n, l.last) as upto, o.text, l.n is not null and o.conv_id is not null as paired
      from l left join o using (conv_id)),
a as (select t.conv_id, t.i, t.role, t.text,
        case when not paired then null when t.i = p.n then p.text else t.text end as other
      from t join p on p.conv_id = t.conv_id and t.i <= p.upto),
c as (select conv_id, coalesce(min(i) filter (where other is null or text <> other) - 1, max(i)) as common from a group by conv_id),
r as (select a.conv_id, i, role, common,
        '<|' || replace(role, '<|', '< |') || '|>' || chr(10) as head,
        replace(text, '<|', '< |') || '<|end|>' as x, replace(other, '<|', '< |') || '<|end|>' as y, other is not null as two
      from a join c using (conv_id)),
s as (select *,
        coalesce(sum(length(head) + length(x) + 1) over (partition by conv_id order by i
          rows between unbounded preceding and 1 preceding), 0) as ax,
        coalesce(sum(length(head) + length(y) + 1) over (partition by conv_id order by i
          rows between unbounded preceding and 1 preceding), 0) as ay
      from r where i > common),
g as (select conv_id,
        string_agg(head || x || chr(10), '' order by i) as chosen, string_agg(head || y || chr(10), '' order by i) as rejected,
        string_agg((ax + length(head))::bigint || '-' || (ax + length(head) + length(x))::bigint, ',' order by i)
          filter (where role = 'assistant') as cs,
        string_agg((ay + length(head))::bigint || '-' || (ay + length(head) + length(y))::bigint, ',' order by i)
          filter (where role = 'assistant' and two) as rs
      from s group by conv_id),
q as (select conv_id, string_agg(head || x || chr(10), '' order by i) as prompt from r where i <= common group by conv_id)
select c.conv_id as pair_id, cast(common as integer) as n_prompt_turns, md5(coalesce(prompt, '')) as prompt_md5,
  md5(coalesce(chosen, '')) as chosen_md5, md5(coalesce(rejected, '')) as rejected_md5,
  coalesce(cs, '') as chosen_spans, coalesce(rs, '') as rejected_spans, cs is not null and rs is not null as usable
from c left join g using (conv_id) left join q using (conv_id)
"""


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit_url_model(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return url_filter.judge_urls(pages, URL_RULES, model).drop("url")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean_lines(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_lines_removed",
        "base_failed",
        "kept",
    )


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, rank_file(), decode=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def source_tree() -> dict[str, Column]:
    """Domain (by the number at the end of the source's name), language, source."""
    number = F.regexp_extract("source", r"(\d{1,9})$", 1).try_cast("int") % 4
    return {"domain": F.concat(F.lit("d"), number.cast("string")), "lang": F.col("lang"), "source": F.col("source")}


MIX = mixing.Mix(
    share=0.6,
    epochs=2,
    seed=17,
    weights={
        ("d0",): 4,
        ("d1",): 3,
        ("d2",): 2,
        ("d3",): 1,
        **{(f"d{i}", lang): w for i in range(4) for lang, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))},
    },
)


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix_sources(docs, source_tree(), MIX).select("doc_id", "epoch", "n_tokens")


def _level(name: str, parent: str, path: str, weight: str) -> str:
    """SQL of one level of the tree: shares of `parent` (budget per path above) among the nodes `path`."""
    up = ", ".join(path.split(", ")[:-1])
    part = f"partition by {up}" if up else ""
    join = f"using ({up})" if up else "on true"
    last = path.split(", ")[-1]
    return f"""
{name}_a as (select {path}, most, w, budget from (
    select {path}, sum(most) as most, {weight} as w from leaf group by {path}) n join {parent} p {join}),
{name}_b as (select *, most * sum(w) over ({part} order by most / w::double, {last}
      rows between current row and unbounded following)
    <= greatest(budget - coalesce(sum(most) over ({part} order by most / w::double, {last}
      rows between unbounded preceding and 1 preceding), 0), 0) * w as sat from {name}_a),
{name}_c as (select *, sum(case when sat then 0 else w end) over ({part}) as ow,
    budget - sum(case when sat then most else 0 end) over ({part}) as ob from {name}_b),
{name}_d as (select *, case when sat then most else (ob::hugeint * w::hugeint) // ow::hugeint end as whole from {name}_c),
{name} as (select {path}, whole + case when not sat and row_number() over (partition by {up + ', ' if up else ''}sat
      order by {last}) <= ob - sum(case when sat then 0 else whole end) over ({part}) then 1 else 0 end as budget
    from {name}_d)"""


ORACLES["op7_mix_sources"] = f"""
with d as (select doc_id, coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source,
    coalesce('d' || (try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as integer) % 4), '(none)') as domain,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n
  from documents),
leaf as (select domain, lang, source, sum(n)::hugeint as supply, sum(n)::hugeint * 2 as most from d
  group by domain, lang, source having sum(n) > 0),
root as (select floor(sum(supply)::double * 0.6)::hugeint as budget from leaf),
{_level("l1", "root", "domain", "case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 else 1 end")},
{_level("l2", "l1", "domain, lang",
        "case when domain not in ('d0', 'd1', 'd2', 'd3') then 1 when lang = 'en' then 5 "
        "when lang in ('de', 'fr') then 2 else 1 end")},
{_level("l3", "l2", "domain, lang, source", "1")},
g as (select domain, lang, source, budget // supply as whole, budget % supply as part
  from l3 join leaf using (domain, lang, source)),
o as (select doc_id, n, whole, part, sum(n) over (partition by domain, lang, source
    order by md5('17:' || whole::bigint || ':' || doc_id), doc_id rows between unbounded preceding and current row) as upto
  from d join g using (domain, lang, source) where n > 0)
select doc_id, unnest(range(0, (whole + case when upto <= part then 1 else 0 end)::bigint)) as epoch, n as n_tokens from o
"""


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    verdicts = line_dedup.line_verdicts(docs, threshold=2, min_chars=6, exact_chars=1)
    away = (F.col("row") != F.col("class_row")) | (F.col("line") != F.col("class_line"))
    counts = verdicts.groupBy("row").agg(
        F.count("*").alias("n_lines"),
        F.sum(away.cast("bigint")).alias("n_removed"),
        F.sum(F.col("linked").cast("bigint")).alias("n_linked"),
        F.array_sort(F.collect_set(F.when(away, F.col("line")))).alias("removed_lines"),
    )
    none = F.lit(0).cast("bigint")
    # Equal rows have one key: their lines were counted together.
    copies = docs.groupBy("doc_id", row_key().alias("row")).agg(F.count("*").alias("copies"))
    each = copies.join(counts, "row", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return each.select(
        "doc_id",
        *[F.coalesce((F.col(c) / F.col("copies")).cast("bigint"), none).alias(c) for c in ("n_lines", "n_removed", "n_linked")],
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
    )


@query
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ball_tree.quantised(
        table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")),
        "vector",
    )
    return ball_tree.top_k(vectors, vectors.filter("id % 50 = 0"), k=5)


ORACLES["op9_top_k"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
           where embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
      from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
        vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.linked_documents(docs, words=3, num=90, den=100)


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


ORACLES["op11_lexical_search"] = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
p as (select doc_id, term, count(*) as tf from t group by doc_id, term),
l as (select doc_id, count(*) as n from t group by doc_id),
g as (select count(*) as docs, sum(n)::bigint as total from l),
m as (select doc_id, 10 + (90 * n * docs) // total as m from l, g),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
      from (select term, count(*) as df from p group by term), g),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
      from q join p using (term) join w using (term) join m using (doc_id) group by item_id, doc_id),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
      from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""


@query
def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = order_minhash.compare_with_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        order_minhash.fingerprint_text(F.col("prints")).alias("fingerprint"),
        order_minhash.fingerprint_text(F.col("edited_prints")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return whitening.whiten(vectors, count=8).withColumnRenamed("id", "vec_id")


_LIST = ", ".join(f"'{p}'" for p in quality.LineRules().boilerplate)
ORACLES["op5_quality_rules"] = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, text from d),
l as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as line
      from d),
j as (select doc_id, line,
        regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') as packed,
        len(list_filter([{_LIST}], lambda p: contains(lower(line), p))) > 0
        or length(regexp_replace(line, '[^|>»•·]', '', 'g')) > 4
        or (not regexp_matches(line, '[.!?…:;]')
            and len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 6) as bad
      from l),
lines as (select doc_id, count(*) - count(distinct line) as n_dup_lines,
            count(*) filter (where bad) as n_lines_removed,
            coalesce(sum(length(packed)) filter (where not bad), 0) as left_chars from j group by doc_id),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
t as (select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from g),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from t) where n > 1),
k as (select doc_id, count(distinct i + o) as n_repeat_words from r, (values (0), (1), (2)) s(o) group by doc_id),
m as (select w.doc_id, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
        coalesce(n_lines_removed, 0) as n_lines_removed, coalesce(left_chars, 0) as left_chars
      from w left join lines using (doc_id) left join k using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
    and (word_chars = 0 or 1 - left_chars / word_chars <= 0.5) as kept
from m
"""

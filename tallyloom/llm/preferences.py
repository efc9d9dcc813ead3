"""Preference formatting: the longest common turn prefix once as prompt, the rest as two masked completions.

A pair is (pair_id, chosen, rejected), both arrays of turns (role, text) in order. Turns are equal if role and text
are. The prompt is never trained on. In a completion the model is trained on the spans of turns of the trained role:
their text and their end mark, as half-open ranges of code points of the completion.

Defined results: a null role is `user`, a null text the empty text, a null conversation one without turns. Marks of
the template inside a text are broken up, so that a text cannot open or close a turn. If one side has no turn of the
trained role left after the prompt, the row is kept with `usable` false. Turns with equal numbers are ordered by role
and text. Repeated rows give repeated pairs; an empty table gives an empty result. Extra columns are kept, except those
named as results here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Text before and after a turn; `broken` replaces `mark` inside texts and roles."""

    opening: str = "<|"
    opened: str = "|>\n"
    end: str = "<|end|>"
    after: str = "\n"
    mark: str = "<|"
    broken: str = "< |"
    trained: str = "assistant"


def conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conversation, turns) with the turns of each conversation in order; a conversation is one record."""
    row = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return (
        turns.filter(F.col(conversation).isNotNull())
        .groupBy(conversation)
        .agg(F.array_sort(F.collect_list(row)).alias("turns"))
        .withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    )


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns that both begin with."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(a)).otherwise((first - 1).cast("int"))


def _safe(text: Column, t: Template) -> Column:
    return F.replace(text, F.lit(t.mark), F.lit(t.broken))


def _head(turn: Column, t: Template) -> Column:
    return F.concat(F.lit(t.opening), _safe(turn["role"], t), F.lit(t.opened))


def render(turns: Column, t: Template) -> Column:
    return F.array_join(
        F.transform(turns, lambda x: F.concat(_head(x, t), _safe(x["text"], t), F.lit(t.end + t.after))), ""
    )


def trained_spans(turns: Column, t: Template) -> Column:
    """Ranges [start, stop) of code points of the rendered turns that are trained on."""
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn, t))
        stop = start + F.length(_safe(turn["text"], t)) + len(t.end)
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        spans = F.when(turn["role"] == t.trained, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((stop + len(t.after)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(zero.alias("at"), empty.alias("spans")), step)["spans"]


def format_pairs(pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds n_prompt_turns, prompt, chosen_text, rejected_text, chosen_spans, rejected_spans and usable."""
    added = ("n_prompt_turns", "prompt", "chosen_text", "rejected_text", "chosen_spans", "rejected_spans", "usable")
    none = F.array().cast("array<struct<role:string,text:string>>")

    def sound(turns: str) -> Column:
        return F.transform(
            F.coalesce(turns, none),
            lambda t: F.struct(
                F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")
            ),
        )

    own = [c for c in pairs.columns if c not in added]
    # The caller's row is one struct, so that no name of its columns meets a working name.
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("p_row")
    both = pairs.select(row, sound("chosen").alias("p_a"), sound("rejected").alias("p_b"))
    cut = both.withColumn("n_prompt_turns", common_turns(F.col("p_a"), F.col("p_b")))

    def rest(turns: str) -> Column:
        n = F.col("n_prompt_turns")
        return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))

    parted = cut.withColumns({"p_x": rest("p_a"), "p_y": rest("p_b")})
    spans = parted.withColumns(
        {"chosen_spans": trained_spans(F.col("p_x"), template), "rejected_spans": trained_spans(F.col("p_y"), template)}
    )
    return spans.select(
        *[F.col("p_row").getField(c).alias(c) for c in own],
        "n_prompt_turns",
        render(F.slice("p_a", F.lit(1), F.col("n_prompt_turns")), template).alias("prompt"),
        render(F.col("p_x"), template).alias("chosen_text"),
        render(F.col("p_y"), template).alias("rejected_text"),
        "chosen_spans",
        "rejected_spans",
        ((F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0)).alias("usable"),
    )


def spans_text(spans: Column) -> Column:
    """Spans as `start-stop` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")


def with_other_answer(talks: DataFrame, conversation: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """(pair_id, chosen, rejected): the last answer of a conversation against that of its neighbour by id.

    Neighbours are the ids 2n and 2n + 1. Turns up to the last answer are the two sides; later ones belong to neither.
    Without an answer, all turns are the chosen side. Without an answer, or a neighbour with one, the rejected side is null.
    """

    def last(turns: Column) -> Column:
        answers = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: F.get(turns, i - 1)["role"] == trained)
        return F.when(F.size(turns) > 0, F.array_max(answers))

    ready = talks.select(F.col(conversation).alias("pair_id"), "turns").filter("pair_id is not null")
    own = ready.withColumn("p_last", last(F.col("turns")))
    other = own.filter("p_last > 0").select(
        F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"),
        F.element_at(F.col("turns"), F.col("p_last"))["text"].alias("p_other"),
        F.lit(True).alias("p_found"),
    )
    answered = F.concat(
        F.slice("turns", F.lit(1), F.col("p_last") - 1),
        F.array(F.struct(F.lit(trained).alias("role"), F.col("p_other").alias("text"))),
    )
    return own.join(other, "pair_id", "left").select(
        "pair_id",
        F.when(F.col("p_last") > 0, F.slice("turns", F.lit(1), F.col("p_last"))).otherwise(F.col("turns")).alias("chosen"),
        F.when((F.col("p_last") > 0) & F.col("p_found"), answered).alias("rejected"),
    )

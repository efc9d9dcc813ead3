"""Line-first cleaning: rules per line, then a limit on the share of a text that they may remove.

All columns are built-in expressions inside one row, so nothing is shuffled and a text's size is the only bound.
Words are runs without space or control white space; windows of three words are compared by 64-bit hashes.

Defined results: a null or empty text has no words and no lines, fails the base rules and is not kept. Repeated rows
are judged alike; an empty table gives an empty result. Extra columns are kept; a column that is added here replaces
one of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.binding import let
from tallyloom.llm.arrow import free_name

SPACES = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules and of the document limit."""

    min_words_to_end: int = 6  # a line of this many words, without any sentence mark, is navigation
    max_separators: int = 4  # a line with more separators than this is a menu or a table row
    separators: str = "|>»•·"
    end_marks: str = ".!?…:;"
    boilerplate: tuple[str, ...] = (
        "all rights reserved",
        "accept all cookies",
        "cookie policy",
        "privacy policy",
        "terms of service",
        "terms of use",
        "subscribe to our newsletter",
        "click here to",
        "javascript is disabled",
        "enable javascript",
        "skip to content",
        "lorem ipsum",
    )
    max_lost: float = 0.5  # a text that loses more than this share of its word characters is rejected


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    """`text` without some single characters; one byte search for each is far cheaper than translate()."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_chars(text: Column) -> Column:
    return F.length(without(text, SPACE_CHARS))


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more; positions are counted once.

    Hash and position share a long: the position in the low bits that the text's length needs, the hash above. Equal
    windows are then neighbours after one sort of longs. Neighbours count as equal only if their whole hashes agree.
    """

    def counted(w: Column) -> Column:
        n = F.size(w) - 2
        hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")

        def by_sort(h: Column, b: Column) -> Column:
            packed = F.sort_array(
                F.transform(h, lambda x, i: F.call_function("shiftleft", x, b).bitwiseOR(i.cast("bigint")))
            )

            def repeated(p: Column, mask: Column) -> Column:
                shift = lambda x: F.call_function("shiftright", x, b)
                near = F.filter(
                    p,
                    lambda x, k: (shift(x) == shift(F.get(p, k - 1))) | (shift(x) == shift(F.get(p, k + 1))),
                )
                at = F.transform(near, lambda x: x.bitwiseAND(mask).cast("int"))

                def covered(a: Column) -> Column:
                    same = lambda x, k: F.get(h, x) == F.get(h, F.get(a, k))
                    twice = F.filter(a, lambda x, k: same(x, k - 1) | same(x, k + 1))
                    return let(
                        F.sort_array(twice),
                        lambda s: F.aggregate(
                            F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))),
                            F.lit(0).cast("bigint"),
                            lambda a, b: a + b,
                        ),
                    )

                return let(at, covered)

            return let(packed, lambda p: repeated(p, F.call_function("shiftleft", F.lit(1).cast("bigint"), b) - 1))

        return F.when(n < 2, F.lit(0).cast("bigint")).otherwise(let(bits, lambda b: let(hashes, lambda h: by_sort(h, b))))

    return let(words, counted)


def word_counts(text: Column) -> Column:
    """Number of words and of repeated ones, with one split of the text."""
    return let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).alias("n_repeat_words")),
    )


def line_fails(line: Column, rules: LineRules) -> Column:
    """Navigation, boilerplate, or a long line without any sentence mark."""

    def says(low: Column) -> Column:
        found = F.lit(False)
        for phrase in rules.boilerplate:
            found = found | F.contains(low, F.lit(phrase))
        return found

    boilerplate = let(F.lower(line), says)
    separators = F.length(line) - F.length(without(line, rules.separators))
    no_mark = ~line.rlike("[" + "".join("\\" + c if c.isascii() else c for c in rules.end_marks) + "]")
    long_line = line.rlike(
        f"^(?:{SPACES}*[^\\x20\\x09-\\x0D]+){{{rules.min_words_to_end}}}"
        if rules.min_words_to_end <= 1
        else f"^{SPACES}*(?:[^\\x20\\x09-\\x0D]+{SPACES}+){{{rules.min_words_to_end - 1}}}[^\\x20\\x09-\\x0D]"
    )
    return boilerplate | (separators > rules.max_separators) | (no_mark & long_line)


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Adds the base counts, `clean_text` (lines that pass, in order), `n_lines`, `n_lines_removed`,
    `lost` (share of word characters removed), `base_failed` and `kept`."""
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    added += ("clean_text", "n_lines", "n_lines_removed", "lost", "base_failed", "kept")
    t = F.coalesce(F.col("text"), F.lit(""))
    cut = let(
        lines_of(t),
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n"),
            F.filter(x, lambda y: ~line_fails(y, rules)).alias("ok"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("repeated"),
        ),
    )
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    words, cuts, left = (free_name(docs, name) for name in ("q_words", "q_cut", "q_left"))
    counted = docs.select(
        *own,
        word_counts(t).alias(words),
        cut.alias(cuts),
        word_chars(t).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(without(t, SYMBOLS))).cast("bigint").alias("n_symbols"),
    )
    measured = counted.withColumns(
        {
            "n_words": F.col(f"{words}.n_words"),
            "n_repeat_words": F.col(f"{words}.n_repeat_words"),
            "n_dup_lines": F.col(f"{cuts}.repeated"),
            "clean_text": F.array_join(f"{cuts}.ok", "\n"),
            "n_lines": F.col(f"{cuts}.n"),
            "n_lines_removed": F.col(f"{cuts}.n") - F.size(f"{cuts}.ok"),
            left: F.aggregate(f"{cuts}.ok", F.lit(0), lambda a, x: a + word_chars(x)),
        }
    )
    lost = F.when(F.col("word_chars") == 0, 0.0).otherwise(1 - F.col(left) / F.col("word_chars"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        measured.withColumns({"lost": lost, "base_failed": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= rules.max_lost))
        .drop(cuts, words, left)
    )

"""Helpers for functions over sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_ID = -(1 << 63)

_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row goes by inside: 64 bits of id and whole text, so that rows of one id, or of none, are told apart."""
    return F.xxhash64(F.col(doc_id).cast("bigint"), F.lit(1), F.coalesce(text, F.lit("")))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(row, doc, text) of (doc_id, text) rows; null texts are empty, null ids the smallest number."""
    doc = F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("bigint").alias("doc")
    return docs.select(row_key().alias("row"), doc, F.coalesce("text", F.lit("")).alias("text"))


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with as many underscores as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows from batches sorted by integer `keys`; equal keys stay together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size + batch.num_rows < rows:
            held.append(batch)
            size += batch.num_rows
            continue
        table = pa.Table.from_batches([*held, batch])
        change = np.zeros(table.num_rows, bool)
        for key in keys:
            column = table[key].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        if len(starts):
            at = done = 0
            for cut in starts:
                if cut - done >= rows:
                    yield table.slice(done, cut - done)
                    done = int(cut)
                at = int(cut)
            if at > done and table.num_rows - done >= rows:
                yield table.slice(done, at - done)
                done = at
            table = table.slice(done)
        held, size = table.combine_chunks().to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to `size`; base is odd."""
    known = _POWERS.get((base, 0))
    if known is None or len(known[0]) <= size:
        room = 1 << max(int(size).bit_length(), 12)
        up = np.full(room, base, np.uint64)
        down = np.full(room, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        known = _POWERS[(base, 0)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return known


class Hashes:
    """64-bit polynomial hashes of any stretch of an integer sequence."""

    def __init__(self, values: np.ndarray, base: int):
        self.up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """Of all stretches of one size, by start."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated start .. start + size - 1."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total)

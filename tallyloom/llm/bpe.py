"""Byte-level BPE by prefix dynamic programming, and decoding.

For every byte prefix of a piece there is exactly one valid last token: the token that ends there and is compatible
with the valid last token of the prefix before it. The table of last tokens gives the encoding of every prefix, so
bytes can be appended exactly, and an edit recomputes only from its place until the table falls into step again.

A text is cut by the split pattern; each piece is encoded by itself, without special tokens. Workers keep the ids of
pieces they have met in a memo of bounded size; a long piece is never kept.

Defined results: a null text is the empty text, with no ids and no bytes. Repeated rows are encoded alike; an empty
table gives an empty result. Extra columns are kept, except those named `ids`, `decoded` and `n_tokens`, which are
replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The usual split of byte-level vocabularies with 50,257 ids; a parameter of encode_documents.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_PIECES = 600_000
MEMO_PAIRS = 500_000
LONGEST_KEPT = 64
ROWS = 512

NONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and a rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks, and how each token comes about: the two tokens of its last merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=0)
        self.packed = [rank.to_bytes(4, "little") for rank in range(len(self.tokens))]
        self.parts: list[tuple[int, int] | None] = [None] * len(self.tokens)
        # Tokens that the merges do not reach stand only for a whole piece.
        self.reached = [False] * len(self.tokens)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.reached[rank] = True
            elif len(last := self._merged(token, rank)) == 2:
                self.parts[rank] = (ranks[last[0]], ranks[last[1]])
                self.reached[rank] = True
        # Every ending of a token that the merges reach: the token's rank, or NONE where only longer ones end so.
        self.endings: dict[bytes, int] = {}
        for token, rank in ranks.items():
            if self.reached[rank]:
                for at in range(1, len(token)):
                    self.endings.setdefault(token[at:], NONE)
                self.endings[token] = rank

    def _merged(self, data: bytes, below: int) -> list[bytes]:
        """`data` after all merges of a rank under `below`, lowest first; used to build the table only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min(
                (self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)
            )
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, encoded together, give a and b again.

        Merges are undone along the seam from the latest to the earliest. If two neighbours at the seam would have
        merged before the merges undone so far, the seam does not hold. On equal ranks the left place goes first.
        """
        tokens, ranks, parts = self.tokens, self.ranks, self.parts
        before = len(tokens) + 1
        while True:
            if ranks.get(tokens[a] + tokens[b], before) < before:
                return False
            left, right = parts[a], parts[b]
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]


class PrefixEncoder:
    """The growing and editable encoding of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", seams: dict | None = None):
        self.vocabulary = vocabulary
        self.seams = {} if seams is None else seams
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def _fill(self, first: int, stop: int) -> None:
        """The valid last tokens of the prefixes of first + 1 .. stop bytes, given those of all shorter ones."""
        endings, seams, last, data = self.vocabulary.endings, self.seams, self.last, self.data
        for end in range(first + 1, stop + 1):
            found = NONE
            for start in range(end - 1, -1, -1):
                token = endings.get(data[start:end])
                if token is None:
                    break
                if token < 0:
                    continue
                if start:
                    before = last[start - 1]
                    if before < 0:
                        continue
                    key = before << 32 | token
                    holds = seams.get(key)
                    if holds is None:
                        if len(seams) >= MEMO_PAIRS:
                            seams.clear()
                        holds = seams[key] = self.vocabulary.compatible(before, token)
                    if not holds:
                        continue
                found = token
                break
            last.append(found)

    def append(self, more: bytes) -> PrefixEncoder:
        done = len(self.data)
        self.data += more
        self._fill(done, len(self.data))
        return self

    def follow(self, data: bytes) -> PrefixEncoder:
        """Go on to other data; what it shares with the beginning of the present one is kept."""
        common = 0
        for a, b in zip(self.data, data, strict=False):
            if a != b:
                break
            common += 1
        self.data = data
        del self.last[common:]
        self._fill(common, len(data))
        return self

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns how many prefixes were encoded anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        size, longest, steady = len(self.data), self.vocabulary.longest, 0
        for at in range(start, size):
            self._fill(at, at + 1)
            # A last token depends on no more than the `longest` entries and bytes before it.
            beyond = at + 1 - (start + len(new))
            steady = steady + 1 if beyond > 0 and self.last[at] == old[at - shift] else 0
            if steady >= longest:
                self.last += old[at + 1 - shift :]
                return at + 1 - start
        return size - start

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix of `end` bytes (default: all)."""
        found, at = [], len(self.data) if end is None else end
        while at > 0:
            token = self.last[at - 1]
            if token == NONE:
                raise ValueError("The vocabulary has no token for a byte of the text")
            found.append(token)
            at -= len(self.vocabulary.tokens[token])
        return found[::-1]


class Coder:
    """Encodes and decodes whole texts with one vocabulary; keeps the ids of short pieces, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.vocabulary = vocabulary
        self.memo: dict[str, bytes] = {}
        self.seams: dict[int, bool] = {}
        self.find = regex.compile(pattern).findall

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Piece -> its ids. In sorted order neighbours share their beginnings, whose last tokens stay."""
        packed, ranks = self.vocabulary.packed, self.vocabulary.ranks
        encoder, found = PrefixEncoder(self.vocabulary, b"", self.seams), {}
        for data, piece in sorted((piece.encode("utf-8"), piece) for piece in pieces):
            whole = ranks.get(data)
            # A piece that is a token is that token, also where the merges do not reach it.
            ids = [whole] if whole is not None else encoder.follow(data).ids()
            found[piece] = b"".join([packed[i] for i in ids])
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) if t else [] for t in texts]
        memo = self.memo
        new = self._learn(set().union(*cut).difference(memo))
        if len(memo) + len(new) > MEMO_PIECES:
            kept = set().union(*cut)
            memo = self.memo = {k: v for k, v in memo.items() if k in kept}
        memo.update(new)
        encoded = [b"".join(map(memo.__getitem__, pieces)) for pieces in cut]
        for piece in [k for k in new if len(k) > LONGEST_KEPT]:
            del memo[piece]
        return encoded

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODERS: dict[tuple, Coder] = {}


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str = PATTERN, text: str = "text", decode: bool = False
) -> DataFrame:
    """Adds `n_tokens` and `ids` (little-endian unsigned 32-bit integers) and, if wanted, `decoded` (bytes of the ids).

    The rank file is read on the driver; its table, of fixed size, travels with the tasks as a broadcast.
    """
    own = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded")]
    given = docs.select(*[docs[f"`{c}`"] for c in own])
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    schema = T.StructType([*given.schema.fields, *fields, *[T.StructField("decoded", T.BinaryType())] * decode])
    table = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path)))
    key = (ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _CODERS.get(key)
        if coder is None:
            coder = _CODERS[key] = Coder(table.value, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            # Some rows at a time, so that a batch of long texts is never held several times over.
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = coder.encode_all(part.column(at).to_pylist())
                columns = [
                    *part.columns,
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    *([pa.array(map(coder.decode, ids), pa.binary())] if decode else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return given.mapInArrow(run, schema)

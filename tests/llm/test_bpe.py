import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from llm_helpers import documents
from tallyloom.llm.bpe import Coder, PrefixEncoder, Vocabulary, encode_documents, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BITS = ["a", "th", "é", "Ü", " ", "  ", "\n", "1", "23", "中", "文", "🙂", "'s", "ing", "!!", "\x00", "ß", "tion", "e", " "]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(read_ranks(PATH))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def text(r, n):
    return "".join(r.choice(BITS) for _ in range(n))


def test_equals_the_library_and_round_trips(vocabulary, library):
    r, coder = random.Random(1), Coder(vocabulary)
    for t in [text(r, r.randint(0, 50)) for _ in range(1500)] + ["a" * 5000, " " * 3000, "ab" * 2000, "<|endoftext|>", "", None]:
        ids = coder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t or "")
        assert coder.decode(ids).decode() == (t or "")


def test_every_prefix_has_its_own_encoding(vocabulary):
    data = "thetionsthing ébcd".encode()
    encoder = PrefixEncoder(vocabulary, data)
    for end in range(len(data) + 1):
        assert encoder.ids(end) == PrefixEncoder(vocabulary, data[:end]).ids()
    for cut in range(len(data)):
        assert PrefixEncoder(vocabulary, data[:cut]).append(data[cut:]).last == encoder.last
        assert PrefixEncoder(vocabulary, b"then" * 9).follow(data).last == encoder.last


def test_edits_recompute_little(vocabulary):
    r = random.Random(3)
    for _ in range(60):
        data = bytes(r.choice(b"abcdetion \xc3\xa9") for _ in range(400))
        a = r.randrange(400)
        b = min(400, a + r.randrange(9))
        new = bytes(r.choice(b"xyz") for _ in range(r.randrange(6)))
        encoder = PrefixEncoder(vocabulary, data)
        steps = encoder.edit(a, b, new)
        assert encoder.last == PrefixEncoder(vocabulary, data[:a] + new + data[b:]).last
        assert steps <= len(new) + 200


def test_tables(spark, library):
    rows = [(1, "Hello there"), (2, None), (2, None), (3, ""), (None, "naïve 🙂"), (4, "long " * 20_000)]
    frame = documents(spark, rows).selectExpr("*", "'x' as ids", "7 as n_tokens")
    found = encode_documents(frame, PATH, decode=True).collect()
    assert len(found) == len(rows)
    for row, (_, t) in zip(sorted(found, key=lambda r: (r["text"] or "", r["doc_id"] or 0)), sorted(rows, key=lambda r: (r[1] or "", r[0] or 0)), strict=True):
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert ids == library.encode_ordinary(t or "") and row["n_tokens"] == len(ids)
        assert bytes(row["decoded"]).decode() == (t or "")
    assert encode_documents(frame.limit(0), PATH).collect() == []

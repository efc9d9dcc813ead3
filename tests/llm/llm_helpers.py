"""Small inputs and plain reference versions for the tests of tallyloom.llm."""

import random
import re
import string

from tallyloom.llm.arrow import row_key

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """(doc_id, text) rows, or with lang and source."""
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    full = [(r[0], r[1], *(r[2:] or ("en", "src1")), len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, names)


def prose(seed, words, vocabulary=300):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
    return " ".join(r.choice(known) for _ in range(words))


def shared_ids(rows):
    """Distinct texts of which every third has no id and every third the id of another one."""
    texts = sorted({t for _, t in rows if t})
    return [(None if i % 3 == 0 else i // 3 if i % 3 == 1 else 1000 - i // 6, t) for i, t in enumerate(texts)]


def row_keys(spark, rows):
    """(doc_id, text) -> what a row goes by inside the operators."""
    found = documents(spark, rows).select("doc_id", "text", row_key().alias("k")).collect()
    return {(r["doc_id"], r["text"]): r["k"] for r in found}


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def groups(items, linked):
    """Item -> smallest item of its component, by trying all pairs."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted(items)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {x: find(x) for x in items}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]

"""Several texts under one doc_id, and texts with very many matches."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest

from quantweft.llm import debruijn, secrets, suffixes


def sha(data):
    return hashlib.sha256(data).hexdigest()


def clashing(seed):
    """Rows of few ids, with pieces in common; some rows repeat."""
    rng = random.Random(seed)
    pieces = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(4)]
    rows = [(rng.choice([None, 1, 2, 3, 9]), " ".join(rng.choice([*pieces, "short", "other"]) for _ in range(rng.randint(0, 3)))) for _ in range(40)]
    return [*rows, *rows[:6], (1, None), (2, "short"), (7, pieces[0] + " of its own")]


def plain_words(rows, size):
    first, out = {}, Counter()
    distinct = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0], sha(r[1].encode())))
    for d, t in distinct:
        w = t.split()
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), (d, t, i))
    for d, t in rows:
        t = t or ""
        w = t.split()
        gone = set()
        for i in range(len(w) - size + 1):
            if first.get(tuple(w[i : i + size])) != (d, t, i):
                gone.update(range(i, i + size))
        out[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_texts_under_one_id_words(spark, seed):
    rows = [r for r in clashing(seed) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in debruijn.dedup_words(docs).collect())
    assert found == plain_words(rows, 20)


@pytest.mark.parametrize("seed", [1, 2])
def test_texts_under_one_id_bytes(spark, seed):
    rows = [r for r in dict.fromkeys(clashing(seed)) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.dedup_bytes(docs).collect())
    texts = [(d, (t or "").encode()) for d, t in rows]
    n = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    expected = Counter()
    for d, t in texts:
        gone = {k for i in range(len(t) - 199) if n[t[i : i + 200]] > 1 for k in range(i, i + 200)}
        expected[d, len(t), len(gone), bytes(b for i, b in enumerate(t) if i not in gone)] += 1
    assert found == expected


def test_a_short_text_beside_a_copy(spark):
    """A place of one text is never read in another of its id."""
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (1, "short"), (2, long), (2, "other"), (None, long), (None, "null")], "doc_id long, text string")
    found = {(r.doc_id, r.kept) for r in debruijn.dedup_words(docs).collect()}
    assert found == {(1, ""), (1, "short"), (2, ""), (2, "other"), (None, long), (None, "null")}
    found = {(r.doc_id, bytes(r.kept)) for r in suffixes.dedup_bytes(docs).collect()}
    assert found == {(1, b""), (1, b"short"), (2, b""), (2, b"other"), (None, b""), (None, b"null")}


def test_secrets_of_a_text_with_very_many(spark):
    """Blocks of matches follow on one another, and the time is in proportion to the matches."""
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(20_000))
    some = " ".join(f"{'ab12' * 6}{'x' * (i % 3)}" for i in range(3 * secrets.BLOCK + 5))
    docs = spark.createDataFrame([(1, text), (2, some), (3, "")], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: [(x.start, x.stop) for x in r.hex] for r in secrets.secret_spans(docs).collect()}
    assert time.time() - began < 150
    assert found == {k: [m.span() for m in re.finditer("[0-9a-f]{24,}", t)] for k, t in ((1, text), (2, some), (3, ""))}

"""Whole results of queries and operators against plain Python, and defined values on awkward rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
import regex

from quantweft.llm import bpe, debruijn, decontamination, exact_dedup, jaccard_join, quality, secrets, suffixes, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
SHA = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r.item_id: r.text or "" for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def thue_morse(n, a, b):
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


# whole queries


def token_row(library, text):
    ids = library.encode_ordinary(text)
    return len(ids), SHA(",".join(map(str, ids)).encode()), SHA(text.encode())


def test_op3_like_the_library(spark, texts, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op3_byte_bpe(spark, DATA).collect()}
    assert got == {d: token_row(library, t) for d, t in texts.items()}


def test_op7_like_a_table_per_token(spark, texts):
    path, pattern = bpe.vocabulary()
    ranks = bpe.read_ranks(path)
    whole = math.log(math.fsum(1 / (r + token_counts.SHIFT) for r in ranks.values()))
    score = {p: -math.log(r + token_counts.SHIFT) - whole for p, r in ranks.items()}
    assert math.fsum(map(math.exp, score.values())) == pytest.approx(1)
    longest = max(map(len, score))
    kept = {}

    def best(token):
        b = token.encode()
        table = [(0.0, 0)]
        for i in range(1, len(b) + 1):
            table.append(max((table[j][0] + score[b[j:i]], table[j][1] - 1) for j in range(max(0, i - longest), i) if b[j:i] in score))
        return -table[-1][1], table[-1][0]

    find = regex.compile(pattern).findall
    for r in token_counts.op7_token_counts(spark, DATA).collect():
        tokens = find(texts[r.doc_id])
        for t in set(tokens) - set(kept):
            kept[t] = best(t)
        assert (r.n_pretokens, r.n_tokens) == (len(tokens), sum(kept[t][0] for t in tokens))
        assert r.score == pytest.approx(math.fsum(kept[t][1] for t in tokens), rel=1e-12)


def plain_words(text):
    return [w for w in "".join(" " if c < "\x7f" and not c.isalnum() and c > " " else c for c in text.lower()).replace("\x1c", "\x1c").split(" ") for w in regex.findall(r"[^\x20\x09-\x0D]+", w)]


def exhaustive(texts, items):
    """(doc, item) -> score of every pair with three words in a row in common."""
    number = defaultdict(lambda: len(number))
    coded = lambda t: np.array([number[w] for w in plain_words(t)], dtype=np.int64)
    grams = lambda w: set(zip(w.tolist(), w[1:].tolist(), w[2:].tolist(), strict=False))
    docs = {d: coded(t) for d, t in texts.items()}
    held = {d: grams(w) for d, w in docs.items()}
    out = {}
    for i, t in items.items():
        w = coded(t)
        g = grams(w)
        for d, doc in docs.items():
            if g & held[d]:
                out[d, i] = decontamination.align(w, doc)[0] / (2 * len(w))
    return {k: s for k, s in out.items() if s >= decontamination.THRESHOLD}


def test_op4_like_alignment_of_all_pairs(spark, texts, items):
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.op4_decontamination(spark, DATA).collect()}
    assert got == pytest.approx(exhaustive(texts, items))
    assert got


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row


def plain_toxicity(model, text, kept):
    """The score by full tables of edit distances and all stretches."""
    lower = text.lower()
    found = list(toxicity.WORD.finditer(lower))
    words = [m[0] for m in found]

    def nearest(w):
        whole = [(0, i) for i, t in enumerate(model.terms) if t == w]
        stem = [(len(t), 0, i) for i, t in enumerate(model.terms) if t.endswith("*") and len(w) > len(t) - 1 - 1 and w.startswith(t[:-1])]
        if whole:
            return whole[0]
        if stem:
            return min(stem)[1:]
        near = []
        for i, t in enumerate(model.terms):
            row = edit_distance(t.rstrip("*") if t.endswith("*") else t, w)
            k = min(row) if t.endswith("*") else row[-1]
            if k <= toxicity.edits_allowed(t):
                near.append((k, i))
        return min(near) if near else None

    quotes = [m.span() for m in toxicity.QUOTED.finditer(lower)]
    hits = []
    for n, m in enumerate(found):
        if m[0] not in kept:
            kept[m[0]] = nearest(m[0])
        if kept[m[0]]:
            e, t = kept[m[0]]
            told = any(x < m.start() and m.end() < y for x, y in quotes) or not model.reporting.isdisjoint(words[max(0, n - toxicity.WINDOW) : n + toxicity.WINDOW + 1])
            hits.append((n, model.weights.get((t, e), 0.0) * (model.quoted if told else 1.0)))
    best = 0.0
    for a in range(len(hits)):
        total = 0.0
        for b in range(a, len(hits)):
            total += hits[b][1] - (model.rate * (hits[b][0] - hits[b - 1][0]) if b > a else 0.0)
            best = max(best, total)
    return 1 / (1 + math.exp(-model.slope * (best - model.offset))) if model.slope else 0.0


def test_op1_like_full_tables(spark, texts):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    fitted = toxicity.fit(docs, labels)
    model = toxicity.Model(["idiot", "worthless", "lowlif*", "scum", "the", "ungs*"], {(0, 0): 5.0, (0, 1): 2.0, (1, 0): 6.0, (1, 1): 4.0, (1, 2): 1.0, (2, 0): 3.0, (2, 1): 1.0, (3, 0): 4.0, (4, 0): 0.1, (5, 0): 0.2}, 0.3, 0.02, 1.0, 4.0)
    for m in (fitted, model):
        kept = {}
        got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
        assert got == pytest.approx({d: plain_toxicity(m, t, kept) for d, t in texts.items()})
    out = toxicity.op1_toxicity(spark, DATA).collect()
    assert len(out) == len(texts) and all(r.predicted == (r.score >= 0.5) for r in out)


def test_op9_like_sorting_all_neighbours(spark, texts):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.op9_quality(spark, DATA).collect()}
    batch = pa.record_batch({"doc_id": pa.array(list(texts)), "text": pa.array(list(texts.values()))})
    for rows, counts in quality._blocks([batch]):
        for d, c in zip(rows.column("doc_id").to_pylist(), counts, strict=True):
            if not c.sum():
                assert got[d] == pytest.approx(model.prior)
                continue
            z = model.latent(c[None, :])[0]
            cosine = sorted(((round(float(z @ v), 9), y, s) for v, y, s in zip(model.vectors, model.labels, model.shares, strict=True)), reverse=True)
            least = cosine[min(quality.NEIGHBOURS, len(cosine)) - 1][0]
            votes = [(max(0, x) ** quality.POWER * s, y) for x, y, s in cosine if x >= least]
            total = sum(w for w, _ in votes)
            assert got[d] == pytest.approx(sum(w * y for w, y in votes) / total if total else model.prior, abs=1e-6)


def test_op10_brute_force(spark, texts):
    count = Counter(b[i : i + 200] for b in (t.encode() for t in texts.values()) for i in range(len(b) - 199))
    for r in suffixes.op10_suffix_dedup(spark, DATA).collect():
        b = texts[r.doc_id].encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0, SHA(kept))


def linked(texts, k, percent):
    sets = []
    for t in texts:
        w = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def test_pipeline_like_plain_python(spark, texts, items, library):
    import corpus_pipeline as P

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    kept = {}
    left = {d: t for d, t in texts.items() if plain_toxicity(model, t, kept) < 0.5}
    last = {t: d for d, t in sorted(left.items())}
    left = {d: t for d, t in sorted(left.items()) if last[t] == d}
    ids = list(left)
    left = {d: left[d] for d, r in zip(ids, linked([left[d] for d in ids], P.SHINGLE_WORDS, P.SIMILARITY_PERCENT), strict=True) if ids[r] == d}
    leaked = {d for d, _ in exhaustive(left, items)}
    want = {d: token_row(library, t) for d, t in left.items() if d not in leaked}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, DATA).collect()}
    assert got == want and len(got) < len(texts)


# awkward values


def test_words_in_thue_morse_order_do_not_clash(spark):
    rows = []
    for n, (a, b) in enumerate((("a", "b"), ("b", "d"), ("0", "1"))):
        for m, word in enumerate(thue_morse(1024, a, b)):
            rows.append((2 * n + m, " ".join([word] + [f"w{i}" for i in range(19)])))
            rows.append((100 + 2 * n + m, word))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in debruijn.dedup_words(docs).collect()} == {0}
    assert all(r.doc_id == r.component_id for r in jaccard_join.jaccard_groups(docs).collect() if r.doc_id >= 100)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_that_branch_overlap_and_cycle(spark, seed):
    rng = random.Random(seed)
    tandem = lambda n: " ".join(["x", "y", "z"][i % 3] for i in range(n))
    word = lambda: rng.choice("abcdefghij")
    core = " ".join(word() for _ in range(30))
    texts = [tandem(40), tandem(41), "q " + tandem(23), " ".join(["m"] * 60), " ".join(["m"] * 21)]
    texts += [" ".join([*(word() for _ in range(rng.randint(0, 9))), core, *(word() for _ in range(rng.randint(0, 9)))]) for _ in range(20)]
    texts += [core[: rng.randint(10, 59)] + " " + core[rng.randint(0, 30) :] for _ in range(10)]
    tm = thue_morse(64, "a ", "b ")
    texts += [tm[0] * 2, tm[1] * 2, tm[0] + tm[1]]
    rng.shuffle(texts)
    size, k = 7, 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), (d, i))
    got = {r.doc_id: r for r in debruijn.dedup_words(docs, size, k).collect()}
    for d, t in enumerate(texts):
        w = t.split()
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] != (d, i) for j in range(i, i + size)}
        assert (got[d].n_words, got[d].n_removed, got[d].kept) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)), t
    count = Counter(t.encode()[i : i + 14] for t in texts for i in range(len(t) - 13))
    for r in suffixes.dedup_bytes(docs, 14, 5, 4).collect():
        t = texts[r.doc_id]
        assert r.n_removed == len({j for i in range(len(t) - 13) if count[t.encode()[i : i + 14]] > 1 for j in range(i, i + 14)})


def test_values_on_awkward_rows(spark, library):
    long = " ".join(f"w{i % 7919}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long), (None, "null id"), (None, "other null id"), (6, "one two three"), (6, "one two three"), (7, "é" * 300)]
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, n_words int, gid string")
    text = lambda d: next(t or "" for i, t in rows if i == d)
    words = {r.doc_id: (r.n_words, r.n_removed) for r in debruijn.dedup_words(docs).collect() if r.doc_id is not None}
    # the words w0 .. w7918 come round after 7,919, so all later windows of document 4 go as well
    assert words == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (20_000, 20_000 - 7919), 5: (20_000, 20_000), 6: (3, 0), 7: (1, 0)}
    removed = defaultdict(list)
    for r in suffixes.dedup_bytes(docs).collect():
        removed[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans))
    assert removed[1] == removed[2] == [(0, 0, 0)] and removed[6] == [(13, 0, 0)] * 2 and removed[7] == [(600, 600, 1)]
    assert removed[4] == removed[5] == [(len(long), len(long), 1)] and sorted(removed[None]) == [(7, 0, 0), (13, 0, 0)]
    groups = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id if r.keep_id is not None else -1, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    assert groups == [(-1, -1, 1, True)] * 2 + [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 2, False), (6, 6, 2, True), (7, 7, 1, True)]
    near = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in jaccard_join.jaccard_groups(docs).collect())
    assert near == [(-1, 1, -1), (-1, 1, -1), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 7919, 4), (5, 7919, 4), (6, 1, 6), (6, 1, 6), (7, 1, 7)]
    path, pattern = bpe.vocabulary()
    for r in bpe.round_trip_documents(docs, path, pattern).collect():
        if r.doc_id is not None:
            assert (list(r.ids), bytes(r.decoded).decode()) == (library.encode_ordinary(text(r.doc_id)), text(r.doc_id))
    counts = Counter((r.doc_id, r.n_tokens > 0) for r in token_counts.count_tokens(docs, path, pattern).collect())
    assert counts == Counter({(1, False): 1, (2, False): 1, (3, True): 1, (4, True): 1, (5, True): 1, (None, True): 2, (6, True): 2, (7, True): 1})
    model = toxicity.Model(["three"], {(0, 0): 5.0, (0, 1): 1.0}, 0.5, 0.0, 1.0, 4.0)
    scores = sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score(docs, model).collect() if r.doc_id is not None)
    none, one = round(1 / (1 + math.exp(4)), 6), round(1 / (1 + math.exp(-1)), 6)
    assert scores == [(d, one if d == 6 else none) for d in (1, 2, 3, 4, 5, 6, 6, 7)]
    spans = {r.doc_id: [len(x) for x in (r.assign, r.access, r.hex, r.entropy)] for r in secrets.secret_spans(docs).collect()}
    assert all(v == [0] * 4 for v in spans.values())
    empty = quality.Model(np.ones(quality.TERMS), np.zeros((quality.TERMS, 0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.25)
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.25}


@pytest.mark.parametrize(("kind", "ids"), [("int", [1, 2]), ("smallint", [1, 2]), ("decimal(9,2)", [Decimal("1.50"), Decimal("2.50")]), ("string", ["a", None]), ("date", [date(2024, 1, 1), None])])
def test_item_ids_of_any_type(spark, kind, ids):
    bench = spark.createDataFrame([(ids[0], "alpha beta gamma delta epsilon"), (ids[1], "one two three four five six")], f"item_id {kind}, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon y"), (2, "One, two, three; four five nine"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, round(r.score, 3)) for r in decontamination.contaminated(docs, bench).collect()) == [(1, ids[0], 1.0), (2, ids[1], 0.833)]
    assert [r.doc_id for r in decontamination.clean(docs, bench).collect()] == [3]
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_seeds_in_parts_are_the_same():
    rng = random.Random(3)
    bench = [(i, " ".join(rng.choice("ab") for _ in range(12))) for i in range(30)]
    items = decontamination.Items.of(bench)
    chunk = next(decontamination._plain(pa.array([" ".join(rng.choice("ab") for _ in range(300)) for _ in range(5)])))
    whole = decontamination.matches(chunk, items, 0.5)
    words, at, which = decontamination._found(chunk, items.grams)
    parts = [decontamination._aligned(words, items, 0.5, *p) for p in decontamination.expanded(items, at, which, 500)]
    assert len(parts) > 3 and sorted(sum(parts, [])) == whole


def test_recall_by_score(spark):
    """Of copies in four alphabets with words changed, left out or put in, at least 0.9 are found in each twentieth of the
    score from the threshold on, against alignment with every item."""
    rng = random.Random(12)
    alphabets = ("abcdefgh", "äöüßenrt", "éèçàlous", "абвгдежз")
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(3, 6)))
    items, texts, true = [], [], {}
    for n in range(1200):
        a = alphabets[n % 4]
        item = [word(a) for _ in range(rng.randint(10, 59))]
        p, copy = rng.uniform(0.05, 0.45), []
        for w in item:
            if rng.random() >= p:
                copy.append(w)
            elif (x := rng.random()) < 0.6:
                copy.append(word(a))
            elif x < 0.8:
                copy += [w, word(a)]
        items.append((n, " ".join(item)))
        texts.append((n, " ".join([word(a) for _ in range(15)] + copy + [word(a) for _ in range(15)])))
        number = defaultdict(lambda: len(number))
        code = lambda ws: np.array([number[w] for w in ws])  # noqa: E731, B023
        true[n] = decontamination.align(code(item), code(texts[-1][1].split()))[0] / (2 * len(item))
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    bands = defaultdict(list)
    for n, s in true.items():
        if s >= decontamination.THRESHOLD:
            bands[n % 4, min(int(s * 20), 19)].append((n, n) in found)
    for score in range(10, 20):
        hits = [x for (_, b), found_ in bands.items() if b == score for x in found_]
        print(f"score {score / 20:.2f}: {sum(hits)} of {len(hits)}")
        assert sum(hits) >= 0.9 * len(hits)
    for language in range(4):
        hits = [x for (a, _), found_ in bands.items() if a == language for x in found_]
        assert sum(hits) >= 0.9 * len(hits)

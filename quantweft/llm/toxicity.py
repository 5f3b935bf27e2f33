"""Toxicity by Levenshtein automata over a lexicon trie (operator 1).

The lexicon comes from labelled documents: words, and stems (beginnings of several words), whose rate in toxic
documents is many times that in others.  It forms a trie.  A word of a document becomes a Levenshtein automaton (bit vectors of the
states reached with 0, 1, 2 edits); automaton and trie are walked together, and branches without live states are cut.
Terms of 5 characters take one edit, of 9 two, stems of 6 one (of a beginning of the word); shorter ones none.
Each match weighs the log of the rates of its term and number of edits in the labelled documents.  A window of words
around a match decides how much of it counts: text in quotation marks of one paragraph, or with a reporting word near, is taken as
quotation, by a factor that the labelled documents correct.  Reporting words are a short English list and, for any language,
those that stand beside matches in clean documents many times as often as in toxic ones.  Words between matches count against toxicity, at the rate
of toxic text, and the best stretch of the document is its sum; a logistic function of it gives the score.

At most TOXIC and CLEAN labelled documents are read to learn (a documented bound; xxhash64 order).  Scoring is one pass
over all documents, without a shuffle; the model is a few hundred terms.

Defined cases: null and empty text score like a text without matches; null doc_id stays null; without labels of both
kinds every score is 0; repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C
from quantweft.llm import kernels as K
from quantweft.llm import samples
from quantweft.llm.bpe import slices

TOXIC, CLEAN = 4_000, 8_000
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
#: A term occurs in this number of the sampled toxic documents at least, at this many times its rate in others.
DOCUMENTS, LIFT = 10, 15
WINDOW = 8
#: The boundary is this share of the largest weight at least.
LEAST = 0.75
KEPT = 200_000
#: Documents whose terms are counted together before they go to Spark.
PART = 250
#: A reporting word is beside matches of this number of clean documents at least, at this many times its rate beside those of toxic ones.
TOLD, TOLD_LIFT = 5, 8
#: Words that tell of speech rather than speak (fixed values).
REPORTING = frozenset("said says called calls quote quoted quotes wrote written word words term terms reported".split())
WORD = re.compile(r"\w+(?:[*@$]\w+)*")
#: Within a paragraph, however long.
QUOTED = re.compile("|".join(f"{a}(?:[^{b}\\n]|\\n(?!\\n))+{b}" for a, b in ('""', "“”", "«»", "„“")))


def edits_allowed(term: str) -> int:
    if term.endswith("*"):
        return int(len(term) > 6)
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms; a stem is written with a final *."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.root: dict = {}
        self.stems = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("*")}
        self.stem_lengths = sorted({len(s) for s in self.stems})
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith("*")}
        fuzzy = [t for t in self.words if edits_allowed(t)]
        for t in fuzzy:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = self.words[t]
        loose = [s for s, i in self.stems.items() if edits_allowed(terms[i])]
        for t in loose:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node["\0"] = self.stems[t]
        #: halves of stems by their lengths: a beginning, or what follows it one place to the left or right at most
        self.halves = [(n, {t[: n // 2] for t in loose if len(t) == n}, {t[n // 2 :] for t in loose if len(t) == n}) for n in sorted(set(map(len, loose)))]
        # some part of a term stays whole: a half for one edit, a third for two
        once = [t for t in fuzzy if edits_allowed(t) == 1]
        self.fronts, self.backs = {t[: len(t) // 2] for t in once}, {t[len(t) // 2 :] for t in once}
        self.sides = sorted({len(t) for t in self.fronts}), sorted({len(t) for t in self.backs})
        self.thirds = {t[i : i + 3] for t in fuzzy if len(t) >= 9 for i in range(len(t) - 2)}
        self.sizes = (min(map(len, fuzzy), default=99) - 1, max((len(t) + edits_allowed(t) for t in fuzzy), default=0))

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, or None."""
        found = self.words.get(word)
        if found is not None:
            return found, 0
        for n in self.stem_lengths:
            if word[:n] in self.stems:
                return self.stems[word[:n]], 0
        return self.nearest(word) if self.may_be_near(word) else None

    def may_be_near(self, word: str) -> bool:
        """Whether the word has a part that a term within its edits must share."""
        n = len(word)
        for size, heads, tails in self.halves:
            h = size // 2
            if n >= size - 1 and (word[:h] in heads or any(word[h + d : size + d] in tails for d in (-1, 0, 1))):
                return True
        if not self.sizes[0] <= n <= self.sizes[1]:
            return False
        if any(word[:k] in self.fronts for k in self.sides[0]) or any(word[-k:] in self.backs for k in self.sides[1]):
            return True
        return n >= 7 and bool(self.thirds) and any(word[i : i + 3] in self.thirds for i in range(n - 2))

    def nearest(self, word: str) -> tuple[int, int] | None:
        """Walks the word's automaton and the trie together."""
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end = 1 << len(word)
        best: tuple[int, int] | None = None
        # a node's "" is a word that ends there, its "\0" a stem
        # bit i of r0, r1, r2: the path so far spells word[:i] with at most 0, 1, 2 edits
        stack = [(self.root, 1, 3, 7)]
        while stack:
            node, r0, r1, r2 = stack.pop()
            for c, child in node.items():
                if not c or c == "\0":
                    at = (end << 1) - 1 if c else end  # a stem may end anywhere in the word
                    edits = 0 if r0 & at else 1 if r1 & at else 2 if r2 & at else 3
                    if edits <= edits_allowed(self.terms[child]) and (best is None or (edits, child) < (best[1], best[0])):
                        best = child, edits
                    continue
                m = masks.get(c, 0)
                n0 = (r0 & m) << 1
                n1 = (r1 & m) << 1 | r0 | r0 << 1 | n0 << 1
                n2 = (r2 & m) << 1 | r1 | r1 << 1 | n1 << 1
                if n2:
                    stack.append((child, n0, n1, n2))
        return best


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    quoted: float = 1.0
    rate: float = 0.0
    slope: float = 0.0
    offset: float = -math.inf
    reporting: frozenset[str] = REPORTING


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lexicon = model, Lexicon(model.terms)
        self.kept: dict[str, tuple[int, int] | None] = {}

    def matches(self, text: str) -> list[tuple[int, int, int, float]]:
        """(word, term, edits, share that counts) of each match in the text."""
        return self.found(WORD.findall(text.lower()), text)

    def found(self, words: list[str], text: str) -> list[tuple[int, int, int, float]]:
        kept, match = self.kept, self.lexicon.match
        if len(kept) > KEPT:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = match(w)
        if not any(map(kept.get, words)):
            return []
        hits = [(i, found) for i, w in enumerate(words) if (found := kept[w])]
        spans = [m.span() for m in WORD.finditer(text.lower())]
        quotes = [m.span() for m in QUOTED.finditer(text.lower())]
        out = []
        for i, (term, edits) in hits:
            a, b = spans[i]
            told = any(x < a and b < y for x, y in quotes) or not self.model.reporting.isdisjoint(words[max(0, i - WINDOW) : i + WINDOW + 1])
            out.append((i, term, edits, self.model.quoted if told else 1.0))
        return out

    def total(self, text: str) -> float:
        return best_stretch([(i, self.model.weights.get((t, e), 0.0) * share) for i, t, e, share in self.matches(text)], self.model.rate)

    def score(self, text: str | None) -> float:
        m = self.model
        return 1 / (1 + math.exp(-m.slope * (self.total(text or "") - m.offset))) if m.slope else 0.0


def best_stretch(weighted: list[tuple[int, float]], rate: float) -> float:
    """The largest sum of weights less `rate` for each word between the first match and the last, over all stretches."""
    run = best = 0.0
    before = 0
    for i, w in weighted:
        run = max(0.0, run - rate * (i - before)) + w
        best, before = max(best, run), i
    return best


def unlike(sample: DataFrame, k: int = 4) -> DataFrame:
    """(text, label): of texts of a label with the same smallest k-word shingle one.

    Two texts have it in common as likely as they share shingles (min-hashing), so near copies, whose words would count
    as often as there are copies, mostly become one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for chunk in K.text_chunks(batch.column("text"), mapped=K.LOWER):
                words = K.Words(chunk)
                grams = np.where(words.fits(k), words.grams(k), K.U64((1 << 64) - 1))
                sketch = np.full(len(chunk), K.U64((1 << 64) - 1))
                some = words.count > 0
                if some.any():
                    short = K.mix(words.hash) | K.U64(1 << 63)  # of fewer words than k
                    sketch[some] = np.minimum.reduceat(np.where(words.count[words.doc] < k, short, grams), words.bounds[:-1][some])
                least.append(K.signed(sketch))
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("label"), pa.array(np.concatenate(least) if least else np.zeros(0, np.int64))], ["text", "label", "sketch"])

    return sample.mapInArrow(read, "text string, label int, sketch long").groupBy("sketch", "label").agg(F.max("text").alias("text")).select("text", "label")


def candidate_terms(sample: DataFrame) -> dict[str, tuple[int, int]]:
    """Words of toxic documents with each word and stem, and in how many of them, for the terms that stand out; "*": all words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PART):
                yield counted(batch.slice(lo, PART))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        count: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = Counter(WORD.findall(text.lower()))
            terms = Counter(words)
            for w, n in words.items():
                for k in STEM_LENGTHS:
                    if len(w) > k:
                        terms[w[:k] + "*"] += n
            terms["*"] = sum(words.values())
            for t, n in terms.items():
                c = count[t]
                c[label] += n
                c[2 + label] += 1
        columns = [pa.array([c[i] for c in count.values()], pa.int64()) for i in (1, 0, 3, 2)]
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *columns], ["term", "c1", "c0", "n1", "n0"])

    rows = sample.mapInArrow(read, "term string, c1 long, c0 long, n1 long, n0 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("c1", "c0", "n1", "n0")])
    rows = C.materialize(rows, "terms")
    whole = rows.filter("term = '*'").first()
    if not whole or not whole.c1 or not whole.c0:
        return {}
    strong = rows.filter((F.col("n1") >= DOCUMENTS) & (F.col("c1") / whole.c1 >= LIFT * (F.col("c0") + 0.5) / whole.c0))
    return {"*": (whole.c1, whole.c0)} | {r.term: (r.c1, r.n1) for r in strong.collect()}


def chosen_terms(counts: dict[str, tuple[int, int]]) -> list[str]:
    """Words, and stems that no longer stem or single word accounts for."""
    names = {t: c for t, (c, _) in counts.items() if t != "*"}
    stems = []
    for t, n in names.items():
        if t.endswith("*"):
            s = t[:-1]
            longer = max((m for u, m in names.items() if u != t and u.startswith(s)), default=0)
            if longer < 0.9 * n:
                stems.append(s)
    stems = [s for s in stems if not any(s != u and s.startswith(u) for u in stems)]
    words = [t for t in names if not t.endswith("*")]  # what a stem covers too: it may be misspelled
    return sorted([s + "*" for s in stems] + words)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> Model:
    """Learns from labels.toxic of rows whose crc32(doc_id) mod modulus is not remainder."""
    with C.scratch():
        return _fit(docs, labels, modulus, remainder)


def _fit(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int) -> Model:
    sample, _ = samples.labelled(docs, labels, "toxic", modulus, remainder, {1: TOXIC, 0: CLEAN})
    # a given number of parts: the passes below are more work than their few MB suggest
    sample = C.materialize(unlike(sample).repartition(2 * docs.sparkSession.sparkContext.defaultParallelism), "toxic-sample")
    counts = candidate_terms(sample)
    if not counts:
        return Model()
    words1, words0 = counts["*"]
    model = Model(chosen_terms(counts))
    model.reporting = REPORTING | reporting_words(sample, model)
    plain = Scorer(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(model.terms, quoted=0.0, reporting=model.reporting))
        for batch in batches:
            found = [scorer.matches(t) for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.int32())
            columns = [pa.array([[x[0] for x in f] for f in found], kind), pa.array([[x[1] * 4 + x[2] for x in f] for f in found], kind), pa.array([[int(x[3] == 0) for x in f] for f in found], kind)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *columns], ["label", "at", "matches", "told"])

    # at most TOXIC + CLEAN rows of matches
    rows = sample.mapInArrow(read, "label int, at array<int>, matches array<int>, told array<int>").collect()
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    told = Counter()
    for r in rows:
        seen[r.label].update(r.matches)
        told[r.label] += sum(r.told)
    for t, term in enumerate(plain.lexicon.terms):
        for e in range(edits_allowed(term) + 1):
            a, b = seen[1][t * 4 + e], seen[0][t * 4 + e]
            # a number of edits that was never seen counts by half of the next smaller one
            if a + b:
                model.weights[t, e] = max(0.0, math.log((a + 0.5) / words1 * words0 / (b + 0.5)))
            else:
                model.weights[t, e] = 0.5 * model.weights.get((t, e - 1), 0.0)
    model.rate = sum(seen[1].values()) / words1
    model.quoted = (told[1] + 1) / (told[1] + 1 + (told[0] + 3) * words1 / words0)
    totals = []
    for r in rows:
        weighted = [(i, model.weights[m >> 2, m & 3] * (model.quoted if q else 1)) for i, m, q in zip(r.at, r.matches, r.told, strict=True)]
        totals.append((best_stretch(weighted, model.rate), r.label))
    # one match with edits never suffices, however few labels there are
    model.offset = max(boundary(totals), LEAST * max(model.weights.values(), default=1.0))
    model.slope = 4 / model.offset
    return model


def reporting_words(sample: DataFrame, model: Model) -> frozenset[str]:
    """The words near matches that tell clean documents with a term from toxic ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(model.terms))
        for batch in batches:
            out: list[tuple[str, int]] = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                hits = [i for i, *_ in scorer.found(words, text)]
                beside = {w for i in hits for w in words[max(0, i - WINDOW) : i] + words[i + 1 : i + WINDOW + 1]}
                out += [(w, label) for w in beside if scorer.kept.get(w) is None]
                out += [("*", label)] * bool(hits)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], ["word", "label"])

    counts = sample.mapInArrow(read, "word string, label int").groupBy("word").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    counts = C.materialize(counts, "beside")
    whole = counts.filter("word = '*'").first()
    if not whole or not whole.n0 or not whole.n1:
        return frozenset()
    told = counts.filter((F.col("word") != "*") & (F.col("n0") >= TOLD) & (F.col("n0") / whole.n0 >= TOLD_LIFT * (F.col("n1") + 0.5) / whole.n1))
    return frozenset(r.word for r in told.collect())  # of a bounded sample


def boundary(totals: list[tuple[float, int]]) -> float:
    """The middle of the gap that splits the labels best (balanced)."""
    totals = sorted(totals)
    n1 = sum(y for _, y in totals)
    n0 = len(totals) - n1
    below = {0: 0, 1: 0}
    best, cut = -1.0, 0.0
    for (x, y), (z, _) in zip(totals[:-1], totals[1:], strict=True):
        below[y] += 1
        if z > x:
            right = below[0] / n0 + (n1 - below[1]) / n1
            if right > best + 1e-12:
                best, cut = right, (x + z) / 2
    return cut


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), one row per row of docs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([scorer.score(t) for t in part.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, score double")


def civil(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([scorer.score(t) < threshold for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(read, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", samples.held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

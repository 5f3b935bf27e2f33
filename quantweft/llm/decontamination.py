"""Benchmark decontamination by n-gram seeds and Smith-Waterman alignment (operator 4).

Words are compared in small letters without ASCII punctuation.  All trigrams of an item are seeds, frequent ones as well: which
of them an edited copy keeps does not depend on their frequency.  One seed makes a passage, seeds near each other a common
one.  Passages that hold too few of the item's words to reach the threshold are left out; local alignment of the item
with the others (match 2, mismatch and gap -1) scores copies with words changed, put in or left out.  The score is that of the
alignment over that of an exact copy; from THRESHOLD on the document is contaminated.

Where many items share many trigrams of a long text, its seeds are expanded for a part of the items at a time, MOST_SEEDS in each.

Benchmark items are handled in blocks of about BLOCK_WORDS words, each broadcast to one pass over the documents:
the broadcast is bounded whatever the size of the benchmark or the corpus.  Documents are never shuffled.

Defined cases: null text has no words; items of fewer than 3 words have no trigrams and are never found, nor are copies
without three words of the item in a row; null ids stay null, and item ids may be of any type;
repeated documents give repeated rows, repeated items one row each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantweft.llm import common as C
from quantweft.llm import kernels as K

N = 3
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
MOST_SEEDS = 4_000_000


def _plain(column: pa.Array) -> Iterator[K.Chunk]:
    """Texts in small letters of any alphabet, ASCII punctuation as spaces."""
    return K.text_chunks(pc.utf8_lower(column), mapped=K.PLAIN)


@dataclass
class Items:
    """A block of benchmark items."""

    ids: list
    words: list[np.ndarray]  # hashes
    grams: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each gram: its places in `item` and `at` begin here
    item: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        ids, words, gram, item, at = [], [], [], [], []
        for item_id, text in rows:
            for chunk in _plain(pa.array([text], pa.string())):
                w = K.Words(chunk)
                n = max(0, len(w.start) - N + 1)
                gram.append(w.grams(N)[:n])
                item.append(np.full(n, len(ids)))
                at.append(np.arange(n))
                words.append(w.hash)
            ids.append(item_id)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        g, item, at = cat(gram, K.U64), cat(item, np.int64), cat(at, np.int64)
        order = np.argsort(g, kind="stable")
        grams, first = np.unique(g[order], return_index=True)
        return Items(ids, words, grams, np.append(first, len(g)), item[order], at[order])


def _found(chunk: K.Chunk, grams: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """(words, word positions at which a gram of the benchmark starts, indices of the grams)."""
    words = K.Words(chunk)
    g = words.grams(N)
    at = np.flatnonzero(words.fits(N))
    if not len(grams) or not len(at):
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    which = np.minimum(np.searchsorted(grams, g[at]), len(grams) - 1)
    hit = grams[which] == g[at]
    return words, at[hit], which[hit]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local score, passage position of its end) by Smith-Waterman, a row of the matrix at a time."""
    n = len(passage)
    steps = np.arange(n + 1)
    row = np.zeros(n + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, 2, -1))
        row = np.maximum.accumulate(new + steps) - steps  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def expanded(items: Items, at: np.ndarray, which: np.ndarray, most: int = MOST_SEEDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word position, place in `items`) of all seeds: in parts of whole items, read in slices of `most` seeds."""
    count = items.first[which + 1] - items.first[which]
    parts = max(1, -(-int(count.sum()) // most))
    cuts = np.searchsorted(np.cumsum(count), np.arange(1, parts) * most)
    for part in range(parts if len(at) else 0):
        found = []
        for x, n, w in zip(np.split(at, cuts), np.split(count, cuts), np.split(which, cuts), strict=True):
            place = np.repeat(items.first[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            mine = items.item[place] % parts == part
            found.append((np.repeat(x, n)[mine], place[mine]))
        yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def matches(chunk: K.Chunk, items: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row in chunk, item, score, seeds, end word) of every item found in a document: its best passage."""
    words, at, which = _found(chunk, items.grams)
    out = []
    for x, place in expanded(items, at, which):
        out += _aligned(words, items, threshold, x, place)
    return sorted(out)


def _aligned(words: K.Words, items: Items, threshold: float, at: np.ndarray, place: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    if not len(at):
        return []
    doc, item = words.doc[at], items.item[place]
    order = np.lexsort((at, item, doc))
    at, place, doc, item = at[order], place[order], doc[order], item[order]
    size = np.array([len(w) for w in items.words])
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * size[item[1:]])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at))
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        seeds = len(set(items.at[place[a:b]].tolist()))
        i, d = int(item[a]), int(doc[a])
        m = int(size[i])
        lo = max(int(words.bounds[d]), int(at[a]) - int(items.at[place[a:b]].max()) - m // 4)
        hi = min(int(words.bounds[d + 1]), int(at[b - 1]) + m + m // 4 + N)
        # each match gives 2 at most
        if np.isin(items.words[i], words.hash[lo:hi]).sum() < threshold * m:
            continue
        best, stop = align(items.words[i], words.hash[lo:hi])
        score = best / (2 * m)
        if score >= threshold and score > found.get((d, i), (0.0,))[0]:
            found[d, i] = score, seeds, lo + stop - int(words.bounds[d])
    return [(d, i, *x) for (d, i), x in found.items()]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first().n or 0
    n = -(-total // block_words)
    for i in range(n):
        yield Items.of([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, end_word): every document with every item that it holds a copy of."""
    spark = docs.sparkSession
    kind = benchmark.select("item_id").schema
    out = spark.createDataFrame([], "doc_id long, score double, n_seeds int, end_word long").crossJoin(spark.createDataFrame([], kind))
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def read(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                for chunk in _plain(batch.column("text")):
                    rows = matches(chunk, shared.value, threshold)
                    d, i, score, seeds, end = zip(*rows, strict=True) if rows else ((),) * 5
                    cols = [ids.take(pa.array(chunk.rows[list(d)], pa.int64())), pa.array(i, pa.int64()), pa.array(score, pa.float64()), pa.array(seeds, pa.int32()), pa.array(end, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item", "score", "n_seeds", "end_word"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, item long, score double, n_seeds int, end_word long")
        # a block of items is bounded
        names = spark.createDataFrame(list(enumerate(items.ids)), T.StructType([T.StructField("item", T.LongType()), *kind.fields]))
        out = out.unionByName(found.join(F.broadcast(names), "item").drop("item"))
    return out.select("doc_id", "item_id", "score", "n_seeds", "end_word")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def read(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for chunk in _plain(batch.column("text")):
                    keep[[chunk.rows[r[0]] for r in matches(chunk, shared.value, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(read, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))

"""Quality by nearest-neighbour voting in a latent-semantic space (operator 9).

A document's terms are its words, and the shapes of its words (runs of capitals, small letters, digits and symbols), pairs of shapes,
punctuation, and whether a word repeats the one before; no list of words, so any language and any vocabulary will do.
Terms are hashed to TERMS columns, half for words and half for shapes, and weighted by 1 + log(count) and by inverse document
frequency over all documents; the words together weigh WORDS times as much as the shapes.
The singular vectors of the labelled sample span the latent space.  The labelled vectors are broadcast: at most SAMPLE
of each label (a documented bound) with DIMENSIONS numbers each.  Every document's cosines with all of them are one matrix
product a block; the NEIGHBOURS nearest, and all that tie with the last of them, vote with weight max(0, cosine)**POWER times the share that the sample holds
of its label.

Defined cases: null and empty text, and text without labelled neighbours, get the share of label 1; without labels 0.5;
null doc_id stays null; repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C
from quantweft.llm import kernels as K
from quantweft.llm import samples

TERMS, DIMENSIONS = 2048, 64
SHAPES, WORDS = TERMS // 2, 0.5
SAMPLE = 2_000
NEIGHBOURS, POWER = 25, 8

#: Character class of each byte: 0 other symbol, 1 small, 2 capital, 3 digit; bytes of other alphabets are small letters;
#: punctuation has a class of its own each.
_CLASS = np.zeros(256, dtype=np.uint64)
_CLASS[33:127] = np.arange(33, 127)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1


def term_counts(chunk: K.Chunk) -> np.ndarray:
    """(documents, TERMS) counts of hashed terms."""
    words = K.Words(chunk)
    n, w = len(chunk), len(words.start)
    if not w:
        return np.zeros((n, TERMS))
    kind = _CLASS[chunk.buf]
    new = np.ones(len(kind), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[words.start] = True
    # shape: the classes of a word without repeats, as a sum of mixed (class, place) pairs
    place = np.cumsum(new) - 1
    base = place[words.start]
    owner = np.repeat(np.arange(w), words.end - words.start)
    at = np.concatenate([np.arange(0)] + [np.flatnonzero(_solid(words, len(kind)))])
    piece = np.where(new[at], K.mix(kind[at] + (place[at] - base[owner]).astype(K.U64) * K.U64(257)), K.U64(0))
    total = np.concatenate([np.zeros(1, K.U64), np.cumsum(piece)])
    ends = np.cumsum(words.end - words.start)
    shape = K.mix(total[ends] - total[ends - (words.end - words.start)])
    same = np.zeros(w, dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    pair = np.zeros(w, dtype=K.U64)
    pair[1:] = K.mix(shape[:-1] * K.U64(3) + shape[1:])
    pair[words.bounds[:-1][words.count > 0]] = K.mix(shape[words.bounds[:-1][words.count > 0]])
    half = SHAPES // 2
    word = words.hash % K.U64(TERMS - SHAPES) + K.U64(SHAPES)
    ids = np.concatenate([shape % K.U64(half), pair % K.U64(half - 2) + K.U64(half), np.where(same, K.U64(SHAPES - 1), K.U64(SHAPES - 2)), word]).astype(np.int64)
    doc = np.concatenate([words.doc] * 4)
    return np.bincount(doc * TERMS + ids, minlength=n * TERMS).reshape(n, TERMS).astype(np.float64)


def _solid(words: K.Words, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int32)
    edge[words.start] += 1
    edge[words.end] -= 1
    return np.cumsum(edge[:-1]) > 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for chunk in K.text_chunks(batch.column("text")):
            for lo in range(0, len(chunk), 256):
                part = chunk.rows[lo : lo + 256]
                a, b = chunk.offsets[lo], chunk.offsets[min(lo + 256, len(chunk))]
                offsets = chunk.offsets[lo : lo + len(part) + 1] - a
                yield batch.slice(int(part[0]), len(part)), term_counts(K.Chunk(part, chunk.buf[a:b], offsets))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents that hold each term, over all documents; the last number is that of documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, dtype=np.int64)
        for rows, counts in _blocks(batches):
            total[:TERMS] += np.count_nonzero(counts, axis=0)
            total[TERMS] += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], ["term", "n"])

    out = np.zeros(TERMS + 1)
    for r in docs.select("text").mapInArrow(read, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # labelled x DIMENSIONS, of length 1
    labels: np.ndarray
    shares: np.ndarray  # weight of each labelled vector
    prior: float

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * self.idf
        for part, weight in ((x[:, :SHAPES], 1.0), (x[:, SHAPES:], WORDS)):
            part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = self.weighted(counts) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        # rounded, so that the last bits of a product decide nothing; what ties with the last neighbour votes too
        cosine = np.round(self.latent(counts) @ self.vectors.T, 9)
        k = min(NEIGHBOURS, cosine.shape[1])
        least = np.partition(cosine, -k, axis=1)[:, -k][:, None]
        vote = np.where(cosine >= least, np.maximum(cosine, 0) ** POWER * self.shares, 0.0)
        total = vote.sum(axis=1)
        voted = vote @ self.labels / np.maximum(total, 1e-300)
        return np.where((counts.sum(axis=1) > 0) & (total > 0), voted, self.prior)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> Model:
    """Learns from labels.quality of rows whose crc32(doc_id) mod modulus is not remainder."""
    sample, sizes = samples.labelled(docs, labels, "quality", modulus, remainder, {1: SAMPLE, 0: SAMPLE})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array([c.astype(np.float32).tobytes() for c in counts], pa.binary())], ["label", "counts"])

    # at most 2 * SAMPLE rows of TERMS numbers
    rows = sorted(sample.mapInArrow(read, "label int, counts binary").collect())
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    model = Model(np.ones(TERMS), np.zeros((TERMS, 0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0), prior)
    if not rows:
        return model
    df = document_frequencies(docs)
    model.idf = np.log((df[TERMS] + 1) / (df[:TERMS] + 1)) + 0.1
    counts = np.stack([np.frombuffer(r.counts, np.float32) for r in rows]).astype(np.float64)
    model.labels = np.array([r.label for r in rows], dtype=np.float64)
    x = model.weighted(counts)
    values, axes = np.linalg.eigh(x.T @ x)
    model.axes = axes[:, np.argsort(-values)[:DIMENSIONS]]
    model.vectors = model.latent(counts)
    seen = {label: max(1, int((model.labels == label).sum())) for label in (0, 1)}
    model.shares = np.where(model.labels == 1, sizes.get(1, 0) / seen[1], sizes.get(0, 0) / seen[0])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(shared.value.score(counts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", samples.held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

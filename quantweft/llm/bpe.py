"""Byte-level BPE encoding and decoding (operator 3).

Merges run on a linked list of bytes.  Each merge rank has a bucket of list positions; a hierarchical bitmap (64 bits
a word, one level over the other) marks the ranks whose buckets hold something, so find-first-set from the top level
gives the next rank in three steps.  Entries whose pair has changed meanwhile are stale and skipped.  A pre-token of
n bytes takes O(n log n) whatever its length: no quadratic rescans.  All new pre-tokens of a slice of text share one
list and one queue (no pair crosses pre-tokens), so short ones share the cost of the queue.

Encoded pre-tokens are kept in a bounded table per Python worker, so most are merged about once per worker.
The rank file is read on the driver and broadcast; its size is that of the vocabulary file, whatever the corpus.

Defined cases: null and empty text give no ids; null doc_id stays null; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C

#: Encoded pre-tokens that a worker keeps in each of two generations, about, and the longest that is kept.
KEPT, KEPT_LENGTH = 250_000, 64
SLICE_BYTES = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by merge rank; `first` finds the lowest rank that has one."""

    def __init__(self, n_ranks: int):
        self.levels = []
        n = n_ranks
        while True:
            n = (n + 63) >> 6
            self.levels.append([0] * n)
            if n == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, bucket: list[int]) -> None:
        self.buckets[rank] = bucket
        at = rank
        for level in self.levels:
            before, bit = level[at >> 6], 1 << (at & 63)
            at >>= 6
            level[at] = before | bit
            if before:
                break

    def first(self) -> int:
        """The lowest rank with a bucket, or -1."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = (at << 6) | ((word & -word).bit_length() - 1)
        return at

    def take(self, rank: int) -> list[int]:
        at = rank
        for level in self.levels:
            bit = 1 << (at & 63)
            at >>= 6
            level[at] &= ~bit
            if level[at]:
                break
        return self.buckets.pop(rank)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.size = size = max(ranks.values()) + 1
        #: left id * size + right id -> rank of the two joined
        self.joined = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    self.joined[a * size + b] = rank
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.double = np.array([self.joined.get(int(a * size + b), -1) for a in self.single for b in self.single], dtype=np.int64)
        self.queue = RankQueue(size)
        self.ids = list(range(size))
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.kept = Kept()

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece (none empty)."""
        whole = [self.ranks.get(p) for p in pieces]
        rest = [p for p, r in zip(pieces, whole, strict=True) if r is None]
        merged = iter(self._merge(rest) if rest else ())
        return [next(merged) if r is None else (r,) for r in whole]

    def _merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        n = len(data)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate([[0], ends[:-1]])
        first_pairs = np.full(n, -1, dtype=np.int64)
        first_pairs[:-1] = self.double[data[:-1] * 256 + data[1:]]
        first_pairs[ends - 1] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[starts] = -1
        queue = self.queue
        order = np.argsort(first_pairs, kind="stable")
        ranked = first_pairs[order]
        edges = np.flatnonzero(np.diff(ranked)) + 1
        for bucket in np.split(order, edges):
            if (r := int(first_pairs[bucket[0]])) >= 0:
                queue.open(r, bucket.tolist())
        ids, pair, after, before = self.single[data].tolist(), first_pairs.tolist(), after.tolist(), before.tolist()
        size, joined, buckets = self.size, self.joined.get, queue.buckets
        while (r := queue.first()) >= 0:
            bucket = queue.take(r)
            bucket.sort()  # of overlapping pairs of one rank the left one merges
            for i in bucket:
                if pair[i] != r:
                    continue  # stale
                j = after[i]
                k = after[j]
                after[i] = k
                ids[i], ids[j], pair[j] = r, -1, -1
                if k >= 0:
                    before[k] = i
                    pair[i] = s = joined(r * size + ids[k], -1)
                    if s >= 0:
                        if s in buckets:
                            buckets[s].append(i)
                        else:
                            queue.open(s, [i])
                else:
                    pair[i] = -1
                h = before[i]
                if h >= 0:
                    pair[h] = s = joined(ids[h] * size + r, -1)
                    if s >= 0:
                        if s in buckets:
                            buckets[s].append(h)
                        else:
                            queue.open(s, [h])
        out = np.array(ids, dtype=np.int64)
        alive = out >= 0
        bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(alive, starts, dtype=np.int64))]).tolist()
        flat = [self.ids[i] for i in out[alive].tolist()]  # one object an id, however often it is kept
        return [tuple(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        kept = self.kept
        if len(kept) > KEPT:
            kept.turn()
        split = [[kept[t] for t in self.find(text)] if text else [] for text in texts]
        new, kept.new = kept.new, []
        for token, ids in zip(new, self.merge([t.encode() for t in new]), strict=True):
            kept[token].extend(ids)
            if len(token) > KEPT_LENGTH:
                del kept[token]
        return [list(chain.from_iterable(ids)) for ids in split]


class Kept(dict):
    """Ids by pre-token in two generations: what was used since the last turn, and before.  An unknown pre-token gets an
    empty list, to be filled, and is noted in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.before: dict[str, list[int]] = {}

    def __missing__(self, token: str) -> list[int]:
        ids = self.before.get(token)
        if ids is None:
            ids = []
            self.new.append(token)
        self[token] = ids
        return ids

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()


#: Of this worker, by rank file and pattern.
_encoders: dict[tuple[str, str], Encoder] = {}


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of text."""
    size = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, side="right"))
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _list_array(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs (doc_id, text)."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((ranks_path, pattern))
        if encoder is None:
            encoder = _encoders[ranks_path, pattern] = Encoder(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = _list_array(encoder.encode_all(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds `decoded` (binary): the bytes of the ids of each row."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: b for b, i in ranks.value.items()}.__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = part.column("ids")
                offsets = ids.offsets.to_numpy()
                flat = ids.values.to_numpy(zero_copy_only=False)
                out = [b"".join(map(table, flat[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): encoding and decoding in one pass, by the same encoder and piece table."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((ranks_path, pattern))
        if encoder is None:
            encoder = _encoders[ranks_path, pattern] = Encoder(ranks.value, pattern)
        piece = encoder.pieces.__getitem__
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode_all(part.column("text").to_pylist())
                decoded = pa.array([b"".join(map(piece, row)) for row in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _list_array(ids), decoded], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the production vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def digests() -> list[Column]:
    """n_tokens, ids_sha256, decoded_sha256 of (ids, decoded)."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    return round_trip_documents(C.table(spark, sf_dir, "documents"), path, pattern).select("doc_id", *digests())

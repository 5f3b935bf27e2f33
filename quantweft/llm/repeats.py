"""A sparse de Bruijn graph of strings that occur more than once, without shuffling every window.

Shared by the word-level (operator 2) and the byte-level (operator 10) substring dedup.  A *unit* is a word or a byte, a
*window* is `size` consecutive units of one document.

1. Edges.  Of the k-grams in a window the one of smallest hash is its anchor; consecutive windows share anchors, so a
   document falls into *runs*: an anchor k-gram, the windows that hang on it, and the units that they span (its path).
   Equal windows have equal anchors at equal offsets.  Anchors are counted, pre-aggregated before the shuffle; what
   occurs once ends here.
2. Nodes and degrees.  The run after a run is its successor.  An anchor with one path at all places is *unbranched*.  If all
   places of u have the successor v (out-degree 1) and v has as many places as u (so u is before each: in-degree 1), the
   link u-v does not branch either.
3. Compaction.  Chains of such links become one *span* each, by pointer jumping: joins that double the distance, until all
   point at their head.  A place of the head is then a place of the whole span.  Cycles cannot occur: the last place
   of a cycle in a document has another successor.
4. Anchors with several paths (forks).  Copies of one path are a span; of each path the first place is a *head*, whose windows
   the operator compares with those of the other heads.
5. Source coordinates.  Every place of a span is read again in its document and its units are digested (BLAKE2b).  Places
   whose digest is not that of the span are taken out and compared window by window instead.

Only hashes, offsets and ids are shuffled in 1-4; joins are built so that AQE can split hot anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantweft.llm import common as C
from quantweft.llm import kernels as K

#: A place in a document: the first window, the number of windows, the offset of the anchor, in one integer that sorts by the first.
_BITS = 12


@dataclass(frozen=True)
class Unit:
    """What a window is made of: `size` units, anchored on k-grams of k units."""

    words: bool
    size: int
    k: int
    #: Bits of the hashes of anchors and paths; fewer only to test that clashes do no harm.
    bits: int = 64

    def __post_init__(self) -> None:
        if not 0 < self.k <= self.size < 1 << _BITS:
            raise ValueError(f"0 < k <= size < {1 << _BITS} is needed, not {self}")


def prepared(chunk: K.Chunk, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """(k-gram hashes, document bounds in units) of a chunk."""
    if unit.words:
        words = K.Words(chunk)
        return words.grams(unit.k), words.bounds
    return K.byte_grams(chunk.buf, unit.k), chunk.offsets


def runs(chunk: K.Chunk, unit: Unit) -> tuple[np.ndarray, ...]:
    """(document in chunk, lo, windows, anchor offset, anchor, path, anchor of the next run or 0)."""
    grams, bounds = prepared(chunk, unit)
    size = unit.size
    best = K.sliding_argmin(grams, size - unit.k + 1)
    best = best[: max(0, bounds[-1] - size + 1)]
    doc = np.repeat(np.arange(len(chunk)), np.diff(bounds))[: len(best)]
    at = np.flatnonzero(np.arange(len(best)) + size <= bounds[1:][doc])
    best, doc = best[at], doc[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
    lo, hi, p, d = at[begin], at[end], best[begin], doc[begin]
    n, off = hi - lo + 1, p - lo
    path = K.span_hash(grams, unit.k, lo, hi + size) + off.astype(K.U64) * K.U64(size + 1) + n.astype(K.U64)
    seed, path = ((K.mix(x) >> K.U64(64 - unit.bits)) | K.U64(1) for x in (grams[p], path))  # not 0, which stands for none
    after = np.zeros(len(seed), dtype=K.U64)
    after[:-1] = np.where(d[1:] == d[:-1], seed[1:], K.U64(0))
    return d, lo - bounds[d], n, off, seed, path, after


def run_rows(docs: DataFrame, unit: Unit) -> DataFrame:
    """(doc_id, place, seed, path, after): the runs of all documents (doc_id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for chunk in K.text_chunks(batch.column("text")):
                d, lo, n, off, *hashes = runs(chunk, unit)
                if len(d):
                    place = (lo << 2 * _BITS) + (n << _BITS) + off
                    yield pa.RecordBatch.from_arrays([pa.array(ids[chunk.rows[d]]), pa.array(place), *(pa.array(K.signed(x)) for x in hashes)], ["doc_id", "place", "seed", "path", "after"])

    return docs.mapInArrow(read, "doc_id long, place long, seed long, path long, after long")


def _lo(place: Column | str) -> Column:
    return F.shiftright(place, 2 * _BITS)


def _n(place: Column | str) -> Column:
    return F.shiftright(place, _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))


def _off(place: Column | str) -> Column:
    return F.shiftright(place, 0).bitwiseAND(F.lit((1 << _BITS) - 1))


def repeated_runs(docs: DataFrame, unit: Unit) -> DataFrame:
    """(node, doc_id, place, path, after, c): runs whose anchor occurs at several places; c of them, negative if it forks.

    node and after are anchors as `apart` gives them.  path is 0 unless the anchor forks, after is 0 if it does.
    """
    rows = run_rows(docs, unit)
    anchors = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("c"), F.min("path").alias("p0"), F.max("path").alias("p1")).filter("c > 1")
    anchors = anchors.select(C.apart("seed").alias("node"), F.when(F.col("p0") == F.col("p1"), F.col("c")).otherwise(-F.col("c")).alias("c"))
    hits = rows.select("doc_id", "place", C.apart("seed").alias("node"), "path", "after").join(anchors, "node")
    after = F.when((F.col("c") > 0) & (F.col("after") != 0), C.apart("after")).otherwise(0)
    return C.materialize(hits.select("node", "doc_id", "place", F.when(F.col("c") < 0, F.col("path")).otherwise(0).alias("path"), after.alias("after"), "c"), "hits")


def nodes_of(hits: DataFrame) -> DataFrame:
    """(node, c, out, n, at): the unbranched anchors, with their places, successor (0: none, or several), windows and
    first place."""
    nodes = hits.filter("c > 0").groupBy("node").agg(F.max("c").alias("c"), F.min("after").alias("a0"), F.max("after").alias("a1"), F.min(F.struct("doc_id", "place")).alias("at"))
    return C.materialize(nodes.select("node", "c", F.when(F.col("a0") == F.col("a1"), F.col("a0")).otherwise(0).alias("out"), _n("at.place").alias("n"), "at"), "nodes")


def links_of(nodes: DataFrame) -> DataFrame:
    """(node, to): unbranched links, from each node to the one before it."""
    left = nodes.filter("out <> 0").select(F.col("node").alias("to"), F.col("out").alias("node"), F.col("c").alias("c_to"))
    return left.join(nodes.select("node", "c"), "node").filter("c = c_to").select("node", "to")


def chain_heads(links: DataFrame) -> DataFrame:
    """(node, head) of every node with a link, by pointer jumping: log2 of the longest chain rounds."""
    active, done = C.materialize(links, "chains"), None
    while True:
        ends = active.select(F.col("node").alias("to"), F.col("to").alias("further"), F.lit(False).alias("ended"))
        if done is not None:
            ends = ends.unionByName(done.select(F.col("node").alias("to"), F.col("head").alias("further"), F.lit(True).alias("ended")))
        # a pointer to what has no link itself is at the head
        step = active.join(ends, "to", "left").select("node", F.coalesce("further", "to").alias("to"), F.coalesce("ended", F.lit(True)).alias("done"))
        step = C.materialize(step, "chains")
        found = step.filter("done").select("node", F.col("to").alias("head"))
        done = found if done is None else done.unionByName(found)
        active = step.filter("not done").select("node", "to")
        if active.isEmpty():
            return done


@dataclass
class Graph:
    """spans (node, path, doc_id, lo, n, first): places of strings that occur at several places; node and path name the
    string, first: the smallest place.
    heads (node, doc_id, lo, n, off, c, m): of each path of a forking anchor the first place, the number of its places and
    that of the anchor's paths."""

    spans: DataFrame
    heads: DataFrame


def graph(docs: DataFrame, unit: Unit) -> Graph:
    with C.scratch() as kept:
        return _graph(docs, unit, kept)


def _graph(docs: DataFrame, unit: Unit, kept: Callable) -> Graph:
    hits = repeated_runs(docs, unit)
    nodes = nodes_of(hits)
    chains = nodes.join(chain_heads(links_of(nodes)), "node", "left").groupBy(F.coalesce("head", "node").alias("node")).agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    whole = chains.select(C.apart("node").alias("nx"), "n", F.col("at.doc_id").alias("d0"), F.col("at.place").alias("p0"))
    starts = hits.filter("c > 0").withColumn("nx", C.apart("node")).join(whole, "nx")
    forks = hits.filter("c < 0").select("node", "path", "doc_id", "place")
    paths = forks.groupBy("node", "path").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "place")).alias("at"))
    paths = kept(C.materialize(paths, "paths"))
    width = paths.groupBy("node").agg(F.count(F.lit(1)).alias("m")).select(C.apart("node").alias("nx"), "m")
    heads = paths.select("node", "at.doc_id", _lo("at.place").alias("lo"), _n("at.place").alias("n"), _off("at.place").alias("off"), "c", C.apart("node").alias("nx"))
    often = paths.filter("c > 1").select(C.apart("node").alias("nx"), C.apart("path").alias("px"), F.col("at.doc_id").alias("d0"), F.col("at.place").alias("p0"))
    copies = forks.withColumns({"nx": C.apart("node"), "px": C.apart("path"), "n": _n("place")}).join(often, ["nx", "px"])
    columns = ["node", "path", "doc_id", _lo("place").alias("lo"), "n", ((F.col("doc_id") == F.col("d0")) & (F.col("place") == F.col("p0"))).alias("first")]
    spans = starts.select(*columns).unionByName(copies.select(*columns))
    return Graph(kept(C.materialize(spans, "spans")), heads.join(width, "nx").drop("nx"))


def with_lists(docs: DataFrame, items: DataFrame, how: str, *fields: str) -> DataFrame:
    """docs with `items`: all structs of the document; their number is bounded by the document's own length."""
    lists = items.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("items"))
    return docs.join(lists.select(F.col("doc_id").alias("di"), "items"), F.col("doc_id") == F.col("di"), how).drop("di")


def items_of(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(offsets, field arrays) of the `items` column."""
    column = batch.column("items")
    offsets = np.zeros(batch.num_rows + 1, dtype=np.int64)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    np.cumsum(lengths, out=offsets[1:])
    flat = column.flatten()
    return offsets, {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def normal(chunk: K.Chunk, words: K.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(text, starts, ends): the words of a chunk with one space after each, and where each is."""
    size = words.end - words.start
    ends = np.cumsum(size + 1) - 1
    at = np.repeat(words.start - (ends - size), size + 1) + np.arange(int(ends[-1]) + 1 if len(ends) else 0)
    text = np.append(chunk.buf, np.uint8(32))[at]
    text[ends] = 32
    return text.tobytes(), ends - size, ends


def digest(text: bytes) -> bytes:
    return blake2b(text, digest_size=16).digest()


def read_places(docs: DataFrame, spans: DataFrame, heads: DataFrame, unit: Unit, fields: tuple[str, ...], look: Callable, schema: str) -> DataFrame:
    """(key1, key2, digest) of each place of a span, and in other rows, where digest is null, what `look` makes of the heads.

    look(chunk, row in chunk of each head, {field: array}) -> {column: Arrow array}; schema: its columns.
    """
    names = ["lo", "n", *fields]
    both = spans.select("doc_id", F.lit(True).alias("span"), F.col("node").alias("key1"), F.col("path").alias("key2"), "lo", "n", *[F.lit(0).cast("long").alias(f) for f in fields])
    both = both.unionByName(heads.select("doc_id", F.lit(False).alias("span"), *[F.lit(0).cast("long").alias(x) for x in ("key1", "key2")], "lo", "n", *[F.col(f).cast("long").alias(f) for f in fields]))
    types = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, f = items_of(batch)
            for chunk in K.text_chunks(batch.column("text")):
                a, b = offsets[chunk.rows[0]], offsets[chunk.rows[-1] + 1]
                row = np.repeat(np.arange(len(chunk)), np.diff(offsets[chunk.rows[0] : chunk.rows[-1] + 2]))
                mine = {x: f[x][a:b] for x in ("span", "key1", "key2", *names)}
                span = mine["span"].astype(bool)
                if unit.words:
                    words = K.Words(chunk, hashed=False)
                    bounds = words.bounds
                    text, starts, ends = normal(chunk, words)
                else:
                    text, bounds = chunk.buf.tobytes(), chunk.offsets
                if span.any():
                    lo = bounds[row[span]] + mine["lo"][span]
                    hi = lo + mine["n"][span] + unit.size - 1
                    if unit.words:
                        lo, hi = starts[lo], ends[hi - 1]
                    found = [digest(text[x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    nothing = [pa.nulls(len(found), t) for t in types.types]
                    yield pa.RecordBatch.from_arrays([*(pa.array(mine[x][span]) for x in ("key1", "key2")), pa.array(found, pa.binary()), *nothing], ["key1", "key2", "digest", *types.names])
                if not span.all():
                    ids = batch.column("doc_id").slice(int(chunk.rows[0]), len(chunk)).to_numpy(zero_copy_only=False)
                    out = look(chunk, ids, row[~span], {x: mine[x][~span].astype(np.int64) for x in names})
                    n = len(out[types.names[0]])
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *(out[c] for c in types.names)], ["key1", "key2", "digest", *types.names])

    listed = with_lists(docs, both, "inner", "span", "key1", "key2", *names)
    return C.materialize(listed.mapInArrow(read, f"key1 long, key2 long, digest binary, {schema}"), "places")


def verified(found: Graph, places: DataFrame, docs: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame | None]:
    """(spans whose places all hold the same units, windows to compare besides those that were read).

    The others, hashes of 128 bits that clash, are hardly ever there; then their windows and those of all heads are
    compared one by one.
    """
    bad = places.filter("digest is not null").groupBy("key1", "key2").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).filter("d0 <> d1")
    bad = bad.select(F.col("key1").alias("node"), F.col("key2").alias("path"))
    if bad.isEmpty():
        return found.spans, None
    bad = C.materialize(bad, "unlike")
    again = found.spans.join(bad, ["node", "path"]).select("doc_id", "lo", "n").unionByName(found.heads.select("doc_id", "lo", "n"))
    return found.spans.join(bad, ["node", "path"], "left_anti"), window_rows(docs, again, unit)


def window_hashes(chunk: K.Chunk, ids: np.ndarray, row: np.ndarray, f: dict[str, np.ndarray], unit: Unit) -> dict[str, np.ndarray]:
    """h1, h2, doc_id, at: 128 bits and place of every window of the given heads."""
    if unit.words:
        words = K.Words(chunk)
        bounds, grams = words.bounds, (words.grams(unit.k), words.grams(unit.k, of=words.second()))
    else:
        bounds = chunk.offsets
        grams = (K.byte_grams(chunk.buf, unit.k), K.byte_grams(chunk.buf ^ np.uint8(0x5A), unit.k))
    n, lo = f["n"], f["lo"]
    d = np.repeat(row, n)
    lo = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    # a place that several spans hold is one
    d, lo = np.divmod(np.unique(d * (1 << 40) + lo), 1 << 40)
    inside = lo + unit.size <= np.diff(bounds)[d]
    d, lo = d[inside], lo[inside]
    at = bounds[d] + lo
    h1, h2 = (K.span_hash(g, unit.k, at, at + unit.size) for g in grams)
    return {"h1": K.signed(h1), "h2": K.signed(h2), "doc_id": ids[d], "at": lo}


WINDOWS = "h1 long, h2 long, doc_id long, at long"


@dataclass(frozen=True)
class WindowsOf:
    """`window_hashes` as what read_places calls."""

    unit: Unit

    def __call__(self, chunk: K.Chunk, ids: np.ndarray, row: np.ndarray, f: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        return {c: pa.array(x) for c, x in window_hashes(chunk, ids, row, f, self.unit).items()}


def window_rows(docs: DataFrame, spans: DataFrame, unit: Unit) -> DataFrame:
    """WINDOWS of whole spans (doc_id, lo, n)."""
    none = spans.filter("false").select(*[F.lit(0).cast("long").alias(x) for x in ("node", "path")], "doc_id", "lo", "n")
    return read_places(docs, none, spans, unit, (), WindowsOf(unit), WINDOWS).select("h1", "h2", "doc_id", "at")


def repeated_windows(rows: DataFrame, keep_first: bool) -> DataFrame:
    """(doc_id, lo, n = 1): windows that are at several places (keep_first: at a smaller one).

    A row with `more` stands for several places, which are known to repeat.
    """
    rows = rows if "more" in rows.columns else rows.withColumn("more", F.lit(False))
    twice = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("m0"), F.max(F.struct("doc_id", "at")).alias("m1"), F.max("more").alias("more")).filter("m0 <> m1 or more")
    twice = twice.select(C.apart("h1").alias("x1"), F.col("h2").alias("x2"), F.col("m0.doc_id").alias("d0"), F.col("m0.at").alias("a0"))
    found = rows.filter("not more").select("*", C.apart("h1").alias("x1"), F.col("h2").alias("x2")).join(twice, ["x1", "x2"])
    if keep_first:
        found = found.filter("doc_id <> d0 or at <> a0")
    return found.select("doc_id", F.col("at").alias("lo"), F.lit(1).cast("long").alias("n"))


def covered(lo: np.ndarray, n: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of `length` units the windows at lo .. lo+n-1 cover."""
    edge = np.zeros(length + 1, dtype=np.int32)
    end = np.minimum(lo.astype(np.int64) + n + size - 1, length)
    inside = lo < length
    np.add.at(edge, lo[inside], 1)
    np.add.at(edge, end[inside], -1)
    return np.cumsum(edge[:-1]) > 0


def rewritten(docs: DataFrame, gone: DataFrame, rewrite: Callable, schema: str) -> DataFrame:
    """rewrite(text bytes, lo, n) -> row, for every document with the windows that go from it."""
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            offsets, f = items_of(batch)
            lo, n = (f["lo"], f["n"]) if f else (np.zeros(0, np.int64),) * 2
            for chunk in K.text_chunks(batch.column("text"), 4 * K.CHUNK_BYTES):
                rows = [rewrite(chunk.text(i), lo[offsets[r] : offsets[r + 1]], n[offsets[r] : offsets[r + 1]]) for i, r in enumerate(chunk.rows)]
                part = pa.table(dict(zip(names[1:], zip(*rows, strict=True), strict=True)), schema=pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in schema.split(", ")[1:]]))
                part = part.add_column(0, "doc_id", ids.slice(int(chunk.rows[0]), len(chunk)))
                yield from part.to_batches()

    listed = with_lists(docs, gone, "left", "lo", "n")
    return listed.mapInArrow(read, schema)


TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}

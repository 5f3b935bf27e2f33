"""N-gram Jaccard join by token-combination prefixes (operator 8).

A document is the set of its distinct 4-word shingles (64-bit hashes, the tokens here).  Documents of one set are one
*entity*.  If 100 |x & y| >= t |x | y| then x and y share at least a = ceil(t |x| / 100) tokens of x; at most e = |x| - a are
missing from y.

1. Screening, over all entities: the e + 1 + extra tokens of smallest hash are a prefix of which at least extra + 1 (that of the
   smaller partner allowed) are in the partner's prefix too; extra is a sixteenth of the set, EXTRA at least.  Tokens
   are counted over prefixes; an entity with fewer shared ones has no links.
2. Prefixes, over what is left: tokens are counted over whole sets, and those of one entity alone go.  Of the h that stay
   at least a must be shared, so with tokens in one order, rarest first, the first h - a + 1 hold a shared one.
   Prefixes are extended by GROUPS tokens: rare tokens are signatures by themselves, frequent ones only in pairs
   within GROUPS token groups.  h - a deletions can void all single tokens and n - 1 of each group of n, so a whole signature
   survives, and the partner, whose prefix ends later, has it too.  Entities of up to SMALL tokens have no room for the
   extension; they use single tokens, and so do those that may be like them.
3. Entities that share a signature are candidates.  They are not paired with each other: per signature all are checked
   against one hub, the entity whose tokens are most common (of near copies, the text they come from), and accepted
   links merge into components.  Only where a signature still joins several components, the entities outside the
   hub's are compared with others of that hub, as bit vectors over the hub's tokens.
4. An entity differs from its hub by tokens that it misses and extra ones.  Two entities without a common difference are less
   alike than each is to the hub, so an outsider has a link that merges components only with entities that share
   some of its differences, and as many at least as it is short of the hub's similarity.  Hubs of more than BLOCK entities
   are screened by joins on (hub, difference); outsiders that share too few, and entities that share none with an
   outsider of another component, drop out.  Tasks compare a block of outsiders with a block of entities; no pair leaves
   them but links that merge components.  All checks are on whole token sets.

Defined cases: null or wordless text has an empty set, linked with nothing; shorter texts than 4 words are one shingle;
null doc_ids stay null and count as smallest in ties; repeated rows are copies of each other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C
from quantweft.llm import kernels as K
from quantweft.llm.links import components

SHINGLE, PERCENT = 4, 85
EXTRA, GROUPS, SMALL, FREQUENT = 16, 16, 24, 32
#: Outsiders of a hub that one task compares with as many entities.
BLOCK = 128


def shingle_sets(chunk: K.Chunk, k: int, salts: frozenset[int], twice: bool = False) -> tuple[np.ndarray, ...]:
    """(document, token) sorted by both and distinct; (bounds per document, size, set id, second id).

    The second id comes from the bytes of the words by another hash, where asked for or where set ids clash; else it is 0.
    """
    words = K.Words(chunk)
    at = np.flatnonzero(words.fits(k))
    twice = twice or bool(salts)
    other = words.second() if twice else words.hash
    doc, token, again = [words.doc[at]], [words.grams(k)[at]], [words.grams(k, of=other)[at] if twice else at]
    for c in range(1, k):
        short = np.flatnonzero(words.count == c)
        if len(short):
            doc.append(short)
            token.append(words.grams(c, salt=c)[words.bounds[short]])
            again.append(words.grams(c, salt=c, of=other)[words.bounds[short]] if twice else short)
    d, g, g2 = np.concatenate(doc), np.concatenate(token), np.concatenate(again)
    order = np.lexsort((g, d))
    d, g, g2 = d[order], g[order], g2[order]
    keep = np.ones(len(d), dtype=bool)
    keep[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    d, g, g2 = d[keep], g[keep], g2[keep]
    bounds = np.searchsorted(d, np.arange(len(chunk) + 1))
    size = np.diff(bounds)
    total = lambda x: np.diff(np.concatenate([np.zeros(1, K.U64), np.cumsum(x)])[bounds])
    sid = K.mix(total(K.mix(g)) ^ (size.astype(K.U64) << K.U64(40)))
    second = K.mix(total(K.mix(g2))) if twice else np.zeros(len(size), K.U64)
    if salts:
        clash = np.isin(sid, np.array(sorted(salts), dtype=K.U64))
        sid = np.where(clash, K.mix(sid ^ second), sid)
    return d, g, bounds, size, sid, second


def _scan(docs: DataFrame, k: int, salts: frozenset[int], emit, schema: str, twice: bool = False) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for chunk in K.text_chunks(batch.column("text"), mapped=K.LOWER):
                yield emit(ids[chunk.rows], *shingle_sets(chunk, k, salts, twice))

    return docs.mapInArrow(read, schema)


def entity_rows(docs: DataFrame, k: int, salts: frozenset[int]) -> DataFrame:
    """(doc_id, size, sid, second) of every document."""

    def emit(ids, d, g, bounds, size, sid, second):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size.astype(np.int64)), pa.array(K.signed(sid)), pa.array(K.signed(second))], ["doc_id", "size", "sid", "second"])

    return _scan(docs, k, salts, emit, "doc_id long, size long, sid long, second long", twice=True)


def prefix_rows(docs: DataFrame, k: int, percent: int, salts: frozenset[int]) -> DataFrame:
    """(token, sid) of the screening prefixes."""

    def emit(ids, d, g, bounds, size, sid, second):
        length = np.where(size > 0, size - (percent * size + 99) // 100 + 1 + np.where(size > SMALL, np.maximum(EXTRA, size // 16), 0), 0)
        length = np.minimum(length, size)
        at = np.repeat(bounds[:-1], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        return pa.RecordBatch.from_arrays([pa.array(K.signed(g[at])), pa.array(np.repeat(K.signed(sid), length))], ["token", "sid"])

    return _scan(docs, k, salts, emit, "token long, sid long")


def set_rows(docs: DataFrame, k: int, salts: frozenset[int]) -> DataFrame:
    """(sid, tokens binary: sorted 64-bit integers)."""

    def emit(ids, d, g, bounds, size, sid, second):
        return pa.RecordBatch.from_arrays([pa.array(K.signed(sid)), pa.array([g[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["sid", "tokens"])

    return _scan(docs, k, salts, emit, "sid long, tokens binary")


def token_rows(docs: DataFrame, k: int, salts: frozenset[int]) -> DataFrame:
    """(token, sid) of whole sets."""

    def emit(ids, d, g, bounds, size, sid, second):
        return pa.RecordBatch.from_arrays([pa.array(K.signed(g)), pa.array(np.repeat(K.signed(sid), size))], ["token", "sid"])

    return _scan(docs, k, salts, emit, "token long, sid long")


def signature_rows(shared: DataFrame, percent: int) -> DataFrame:
    """(sig, sid, size, weight) from (sid, size, tokens array<struct<n, token>>: the shared tokens and their counts).

    weight: mean logarithm of the counts, 0 for tokens of one entity alone.
    """
    wide = _wide(percent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, size = batch.column("sid").to_numpy(), batch.column("size").to_numpy()
            lists = batch.column("tokens")
            flat, offsets = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            counts, tokens = flat.field(0).to_numpy(), flat.field(1).to_numpy().view(K.U64)
            sigs, rows, weight = [], [], np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                n, t = counts[offsets[i] : offsets[i + 1]], tokens[offsets[i] : offsets[i + 1]]
                weight[i] = np.log(n).sum() / size[i]
                need = (percent * size[i] + 99) // 100
                order = np.lexsort((t, n))[: len(t) - need + 1 + (GROUPS if size[i] > SMALL else 0)]
                n, t = n[order], t[order]
                if size[i] <= wide:
                    out = [t]
                else:
                    out = [t[n <= FREQUENT]]
                if size[i] > SMALL:
                    often = t[n > FREQUENT]
                    group = often % K.U64(GROUPS)
                    for x in range(GROUPS):
                        mine = K.mix(np.sort(often[group == x]))
                        if len(mine) > 1:
                            a, b = np.triu_indices(len(mine), 1)
                            out.append(K.mix(mine[a] + K.mix(mine[b])))
                out = np.concatenate(out)
                sigs.append(out)
                rows.append(np.full(len(out), i))
            if rows:
                row = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(np.concatenate(sigs))), pa.array(sid[row]), pa.array(size[row]), pa.array(np.round(weight, 9)[row])], ["sig", "sid", "size", "weight"])

    return shared.mapInArrow(read, "sig long, sid long, size long, weight double")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose token sets are similar enough."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, K.U64), np.frombuffer(y, K.U64)
                if len(x) > len(y):
                    x, y = y, x
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a")
    joined = joined.join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b")
    return C.materialize(joined.select("a", "b", "ta", "tb").mapInArrow(read, "a long, b long").distinct(), "links")


DELTA = "hub long, sid long, root long, out boolean, size long, hub_size long, missing long, bits binary, extras binary"


def delta_rows(members: DataFrame, sets: DataFrame) -> DataFrame:
    """DELTA: each entity as its difference from a hub: which of the hub's tokens it has (a bit each) and which others.
    A few bytes for a near copy."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, extras, size, whole, missing = [], [], [], [], []
            for x, h in zip(batch.column("tokens").to_pylist(), batch.column("hub_tokens").to_pylist(), strict=True):
                x, h = np.frombuffer(x, K.U64), np.frombuffer(h, K.U64)
                has = _in_sorted(h, x)
                bits.append(np.packbits(has).tobytes())
                extras.append(x[~_in_sorted(x, h)].tobytes())
                size.append(len(x))
                whole.append(len(h))
                missing.append(len(h) - int(has.sum()))
            cols = [*(batch.column(c) for c in ("hub", "sid", "root", "out")), *(pa.array(c, pa.int64()) for c in (size, whole, missing)), pa.array(bits, pa.binary()), pa.array(extras, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in DELTA.split(", ")])

    rows = members.join(sets, "sid").join(sets.select(F.col("sid").alias("hub"), F.col("tokens").alias("hub_tokens")), "hub")
    return rows.select("hub", "sid", "root", "out", "tokens", "hub_tokens").mapInArrow(read, DELTA)


def difference_rows(deltas: DataFrame) -> DataFrame:
    """(hub, extra, token, sid, root, out): a row for each token that the entity misses (its number in the hub) or has besides."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                tokens, counts = [], []
                for bits, extras, n in zip(*(part.column(c).to_pylist() for c in ("bits", "extras", "hub_size")), strict=True):
                    lost = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[:n] == 0)
                    more = np.frombuffer(extras, np.int64)
                    tokens += [lost, more]
                    counts += [len(lost), len(more)]
                row = np.repeat(np.arange(len(counts)), counts)
                at = pa.array(row // 2)
                cols = [part.column("hub").take(at), pa.array(row % 2 == 1), pa.array(np.concatenate(tokens)), *(part.column(c).take(at) for c in ("sid", "root", "out"))]
                yield pa.RecordBatch.from_arrays(cols, ["hub", "extra", "token", "sid", "root", "out"])

    return deltas.mapInArrow(read, "hub long, extra boolean, token long, sid long, root long, out boolean")


def screened(deltas: DataFrame, percent: int) -> DataFrame:
    """The rows of deltas that can have a link which merges components.

    x, short of the hub's similarity by d = percent * (hub + extras) - 100 * (hub - missing), needs d / 100 differences in common.
    """
    rows = difference_rows(deltas)
    key = ["hub", "extra", "token"]
    useful = rows.groupBy(*key).agg(F.max("out").alias("any"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("any and r0 <> r1")
    useful = useful.select(C.apart("hub").alias("hx"), F.col("extra").alias("ex"), C.apart("token").alias("tx"))
    hits = rows.select("hub", "sid", C.apart("hub").alias("hx"), F.col("extra").alias("ex"), C.apart("token").alias("tx")).join(useful, ["hx", "ex", "tx"])
    hits = hits.groupBy("hub", "sid").agg(F.count(F.lit(1)).alias("hits"))
    short = percent * (F.col("hub_size") + F.col("size") - F.col("hub_size") + F.col("missing")) - 100 * (F.col("hub_size") - F.col("missing"))
    return deltas.join(hits, ["hub", "sid"]).filter(~F.col("out") | (100 * F.col("hits") >= short)).drop("hits")


def _in_sorted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted y."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def outside_links(deltas: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join further components, between entities of one hub of which one is outside the hub's component.

    A task has a block of a hub's outsiders (side 0) and one of its entities (side 1), and compares their bit vectors with
    whole-array popcounts.  What the bits and the shared extras allow is checked in full.  Only links that merge two
    components of the task are returned: no more than it has entities.
    """

    def group(rows: list[dict]) -> Iterator[tuple[int, int]]:
        side = np.array([r["side"] for r in rows])
        xs, ys = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(xs) or not len(ys):
            return
        size = np.array([r["size"] for r in rows])
        pad = -len(rows[0]["bits"]) % 8
        bits = np.stack([np.frombuffer(r["bits"] + bytes(pad), np.uint64) for r in rows])
        extras = [np.frombuffer(r["extras"], K.U64) for r in rows]
        seen, n = np.unique(np.concatenate(extras), return_counts=True)
        seen = seen[n > 1]
        extras = [e[_in_sorted(e, seen)] for e in extras]
        more = np.array([len(e) for e in extras])
        codes = {r: i for i, r in enumerate(sorted({r["root"] for r in rows}))}
        root = np.array([codes[r["root"]] for r in rows])
        parent = list(range(len(codes)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        common = np.bitwise_count(bits[xs][:, None, :] & bits[ys][None, :, :]).sum(axis=2, dtype=np.int64)
        most = common + np.minimum(more[xs][:, None], more[ys][None, :])
        may = ((100 + percent) * most >= percent * (size[xs][:, None] + size[ys][None, :])) & (root[xs][:, None] != root[ys][None, :])
        for i, j in zip(*np.nonzero(may), strict=True):
            x, y = xs[i], ys[j]
            p, q = find(int(root[x])), find(int(root[y]))
            if p != q:
                shared = int(common[i, j]) + len(np.intersect1d(extras[x], extras[y]))
                if (100 + percent) * shared >= percent * int(size[x] + size[y]):
                    parent[p] = q
                    yield rows[x]["sid"], rows[y]["sid"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in batch.to_pylist():
                if held and any(held[0][c] != row[c] for c in ("hub", "bx", "by")):
                    found.extend(group(held))
                    held = []
                held.append(row)
            yield _pairs(found)
        yield _pairs(list(group(held)) if held else [])

    wide = deltas.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.max("out").alias("any")).filter("any").select(C.apart("hub").alias("hx"), "n")
    wide = C.materialize(deltas.withColumn("hx", C.apart("hub")).join(wide, "hx").drop("hx"), "mixed")
    kept = C.materialize(wide.filter(F.col("n") <= BLOCK).drop("n").unionByName(screened(wide.filter(F.col("n") > BLOCK).drop("n"), percent)), "left")
    blocks = kept.groupBy("hub").agg(F.ceil(F.sum(F.col("out").cast("int")) / BLOCK).cast("int").alias("nx"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ny")).filter("nx > 0")
    rows = kept.withColumn("hx", C.apart("hub")).join(blocks.select(C.apart("hub").alias("hx"), "nx", "ny"), "hx").drop("hx")
    place = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.filter("out").withColumn("side", F.lit(0)).withColumn("bx", place("nx")).withColumn("by", every("ny"))
    right = rows.withColumn("side", F.lit(1)).withColumn("by", place("ny")).withColumn("bx", every("nx"))
    rows = left.unionByName(right).select("hub", "bx", "by", "side", "sid", "root", "size", "bits", "extras")
    return rows.repartition("hub", "bx", "by").sortWithinPartitions("hub", "bx", "by").mapInArrow(read, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _wide(percent: int) -> int:
    """The largest entity that may be like one that uses single tokens."""
    return SMALL * 100 // percent + 1


def _alike(percent: int) -> str:
    return f"100 * least(size, hub_size) >= {percent} * greatest(size, hub_size)"


def _shared(tokens: DataFrame) -> DataFrame:
    """The rows (token, sid) of tokens that several entities have, with n, their number of rows."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("s0"), F.max("sid").alias("s1")).filter("s0 <> s1")
    return tokens.withColumn("tx", C.apart("token")).join(counts.select(C.apart("token").alias("tx"), "n"), "tx").drop("tx")


def entity_links(docs: DataFrame, entities: DataFrame, k: int, percent: int, salts: frozenset[int]) -> DataFrame:
    """(node, root) of the entities that are linked with another."""
    with C.scratch() as kept:
        return kept(_entity_links(docs, entities, k, percent, salts))


def _entity_links(docs: DataFrame, entities: DataFrame, k: int, percent: int, salts: frozenset[int]) -> DataFrame:
    heads = C.materialize(entities.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.count(F.lit(1)).alias("copies")), "heads")
    screened = _shared(prefix_rows(docs, k, percent, salts)).groupBy("sid").agg(F.count(F.lit(1)).alias("hits"))
    heads = heads.join(screened, "sid").filter(F.col("hits") >= F.col("copies") * F.when(F.col("size") > _wide(percent), F.greatest(F.lit(EXTRA), F.floor(F.floor(F.col("size") * percent / 100) / 16)) + 1).otherwise(1))
    heads = C.materialize(heads.select("sid", "doc_id", "size"), "screened")
    tokens = _shared(token_rows(C.only(docs, heads), k, salts))
    shared = tokens.groupBy("sid").agg(F.collect_set(F.struct("n", "token")).alias("tokens"))
    shared = shared.join(heads.select("sid", "size"), "sid").filter(F.size("tokens") >= F.ceil(F.col("size") * percent / 100))
    sigs = signature_rows(C.materialize(shared, "shared"), percent)
    buckets = sigs.groupBy("sig").agg(F.max(F.struct("weight", "sid")).alias("top"), F.min("sid").alias("s0"), F.max("sid").alias("s1")).filter("s0 <> s1")
    rows = sigs.drop("weight").withColumn("gx", C.apart("sig")).join(buckets.select(C.apart("sig").alias("gx"), F.col("top.sid").alias("hub")), "gx").drop("gx")
    rows = C.materialize(rows, "candidates")  # (sig, sid, size, hub)
    heads = C.materialize(heads.join(rows.select("sid").distinct(), "sid"), "heads")
    sets = C.materialize(set_rows(C.only(docs, heads), k, salts), "sets")

    sizes = heads.select(F.col("sid").alias("b"), F.col("size").alias("hub_size"))
    first = rows.filter("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b"), "size").distinct().join(sizes, "b").filter(_alike(percent)).select("a", "b")
    links = linked(first, sets, percent)
    roots = C.materialize(components(links), "roots")
    # signatures that join entities of several components: their entities, by hub
    at = rows.select("sig", "sid", "hub", F.col("sid").alias("node")).join(roots, "node", "left").drop("node").withColumn("root", F.coalesce("root", "sid"))
    mixed = at.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(F.when(F.col("sid") == F.col("hub"), F.col("root"))).alias("main")).filter("r0 <> r1")
    rest = at.withColumn("gx", C.apart("sig")).join(mixed.select(C.apart("sig").alias("gx"), "main"), "gx")
    members = C.materialize(rest.select("hub", "sid", "root", (F.col("root") != F.col("main")).alias("out")).distinct(), "rest")
    found = C.materialize(outside_links(C.materialize(delta_rows(members, sets), "deltas"), percent).distinct(), "links")
    return roots if found.isEmpty() else C.materialize(components(links.unionByName(found)), "roots")


def jaccard_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id it reaches by links)."""
    rows = C.texts(docs)
    salts: frozenset[int] = frozenset()
    while True:
        entities = C.materialize(entity_rows(rows, k, salts), "entities")
        clash = entities.groupBy("sid").agg((F.min("second") != F.max("second")).alias("clash")).filter("clash").select("sid").collect()  # two sets under one 64-bit id: a few in 10**10 documents
        if not clash:
            break
        salts |= {int(r.sid) & (1 << 64) - 1 for r in clash}
    filled = entities.filter("size > 0")
    roots = entity_links(rows, filled, k, percent, salts)
    heads = filled.groupBy("sid").agg(F.min("doc_id").alias("d0"))
    heads = heads.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    heads = C.materialize(heads, "roots")
    least = heads.groupBy("root").agg(F.min("d0").alias("component_id"))
    named = heads.select("sid", C.apart("root").alias("rx")).join(least.select(C.apart("root").alias("rx"), "component_id"), "rx").select(C.apart("sid").alias("sx"), "component_id")
    out = filled.withColumn("sx", C.apart("sid")).join(named, "sx").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    out = out.unionByName(entities.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.select(C.real_id("doc_id").alias("doc_id"), "n_shingles", C.real_id("component_id").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(C.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, sh from (
  select doc_id, unnest([array_to_string(words[i:i+3], ' ') for i in range(1, len(words) - 2)]) as sh from w where len(words) > 3
  union all select doc_id, array_to_string(words, ' ') from w where len(words) between 1 and 3)),
n as (select doc_id, count(*) as n from s group by doc_id),
t as (select sh, list(doc_id) as docs from s group by sh having count(*) > 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id
      where a.sh in (select sh from t) group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * common >= 85 * (x.n + y.n - common)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.doc_id)
select d.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(r.root) as component_id
from documents d join r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""

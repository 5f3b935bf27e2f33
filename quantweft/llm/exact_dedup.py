"""Exact dedup by deterministic block naming (operator 6); DataFrame functions only.

Each text is cut into blocks of BLOCK characters.  Distinct blocks are sorted and get integer names, so equal
blocks and only equal blocks share a name.  Then adjacent names are paired, the distinct pairs sorted and named,
again and again, until every document has one name: its identity.  The sort order of blocks
is (xxhash64, content), and content is compared wherever blocks meet: no two texts are taken for equal by a hash.  (Blocks of
several texts under one doc_id are kept apart by 128 bits of hash.)

Skew: distinct blocks and pairs come from groupBy with map-side partial aggregation, so a block that a third of
all rows hold is one row per task before the shuffle; names return by joins that AQE can split.
Depth: a text of one block is named at once; log2(longest text / BLOCK) rounds follow, over the longer ones only.

Defined cases: null text is the empty text; a null doc_id counts as the smallest id; of several rows with the largest doc_id of
a group one stays, the others are dropped like all of the group (they are alike, so which one is of no account);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C

BLOCK = 8192


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Adds `name`: an integer that follows the sort order of the rows (all different)."""
    placed = distinct.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])
    return C.materialize(placed.withColumn("name", F.monotonically_increasing_id()), "names")


def block_names(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, m1, m2, n, pos, sha, name): the named blocks of every text; n of them, sha at the first only.  m1 and m2 tell
    the texts of one doc_id apart."""
    n = f"cast((greatest(length(text), 1) - 1) div {block} + 1 as int)"
    many = f"length(text) > {block}"
    parts = F.expr(f"transform(sequence(0, n - 1), i -> substring(text, i * {block} + 1, {block}))")
    rows = docs.select("doc_id", "text", F.expr(n).alias("n"), F.expr(f"if({many}, xxhash64(text), 0L)").alias("m1"), F.expr(f"if({many}, xxhash64(1, text), 0L)").alias("m2"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    blocks = rows.select("doc_id", "m1", "m2", "n", "sha", F.posexplode(parts).alias("pos", "block"))
    blocks = blocks.withColumn("h", F.xxhash64("block")).withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))
    columns = ["doc_id", "m1", "m2", "n", "pos", "sha"]
    kinds = blocks.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = C.materialize(kinds, "kinds")
    clash = kinds.filter("kinds > 1")
    if clash.isEmpty():
        names = _named(kinds.select("h"), "h").select(C.apart("h").alias("hx"), "name")
        return blocks.select(*columns, C.apart("h").alias("hx")).join(names, "hx").drop("hx")
    # two different blocks under one hash: sort those by content too
    kept = blocks.join(clash.select("h"), "h", "left_semi").select("h", "block").distinct()
    others = kinds.filter("kinds = 1").select("h", F.lit(None).cast("string").alias("block"))
    names = _named(others.unionByName(kept), "h", "block").withColumnRenamed("block", "same")
    on = (blocks["h"] == names["h"]) & (names["same"].isNull() | (names["same"] == blocks["block"]))
    return blocks.join(names, on).select(*columns, "name")


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, sha, level, name), one row per row of docs: two texts are equal exactly if level and name are."""
    named = C.materialize(block_names(docs, block), "blocks")
    done = named.filter("n = 1").select("doc_id", "sha", F.lit(0).alias("level"), "name")
    rest = named.filter("n > 1").withColumn("copies", F.lit(1))
    level = 0
    while not rest.isEmpty():
        even = F.col("pos") % 2 == 0
        # rows that repeat an id and its text are one until the end
        copies = F.sum(F.when(even, 1)) if level == 0 else F.max("copies")
        pairs = rest.groupBy("doc_id", "m1", "m2", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            F.expr("cast((max(n) + 1) div 2 as int)").alias("n"), F.max("sha").alias("sha"), copies.cast("int").alias("copies"),
        )
        pairs = C.materialize(pairs, "pairs")
        names = _named(pairs.select("a", "b").distinct(), "a", "b")
        key = [C.apart("a").alias("ax"), F.col("b").alias("bx")]
        named = pairs.select(*[c for c in pairs.columns if c not in "ab"], *key).join(names.select(*key, "name"), ["ax", "bx"]).drop("ax", "bx")
        named = C.materialize(named, "level")
        level += 1
        whole = named.filter("n = 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        done = done.unionByName(whole.select("doc_id", "sha", F.lit(level).alias("level"), "name"))
        rest = named.filter("n > 1")
    return done


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256."""
    with C.scratch() as kept:
        # the number, once written, breaks ties
        rows = kept(C.materialize(identities(C.texts(docs), block).withColumn("row", F.monotonically_increasing_id()), "ident"))
    groups = rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.col("level").alias("lx"), C.apart("name").alias("nx"), "top", "group_size")
    out = rows.select("*", F.col("level").alias("lx"), C.apart("name").alias("nx")).join(groups, ["lx", "nx"])
    return out.select(C.real_id("doc_id").alias("doc_id"), C.real_id("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(C.table(spark, sf_dir, "documents"))


OP6_SQL = """
with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.text) as text_sha256
from t join g using (text)
"""

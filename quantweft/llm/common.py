"""What the corpus operators share: table access, written intermediates, skew-safe joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids below stand for null doc_ids inside the operators (told apart by their texts); null again in results.
NO_ID = -(1 << 62)
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null ids and null texts replaced; other columns never enter an operator."""
    text = F.coalesce(F.col("text"), F.lit(""))
    no_id = F.lit(NO_ID - 1) - F.shiftrightunsigned(F.xxhash64(text), 2)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("doc_id"), text.alias("text"))


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows, names): rows as of `texts`, but each doc_id has one text.  Where ids repeat with different texts, rows have numbers in the
    order of (doc_id, sha256 of the text) instead, and names (doc_id, real) tells whose they are; else names is None.  Rows that repeat
    an id and its text share a number."""
    rows = texts(docs)
    if docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().filter("count > 1").isEmpty():
        return rows, None
    marked = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    if marked.groupBy("doc_id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).filter("a <> b").isEmpty():
        return rows, None
    kinds = marked.select("doc_id", "sha").distinct().repartitionByRange("doc_id", "sha").sortWithinPartitions("doc_id", "sha")
    kinds = materialize(kinds.withColumn("key", F.monotonically_increasing_id()), "keys")
    rows = materialize(marked.join(kinds, ["doc_id", "sha"]).select(F.col("key").alias("doc_id"), "text"), "keyed")
    return rows, kinds.select(F.col("key").alias("doc_id"), F.col("doc_id").alias("real"))


def named(out: DataFrame, names: DataFrame | None) -> DataFrame:
    """out with the ids that its documents came with."""
    if names is not None:
        out = out.join(names, "doc_id").select(F.col("real").alias("doc_id"), *[c for c in out.columns if c != "doc_id"])
    return out.withColumn("doc_id", real_id("doc_id"))


def real_id(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= F.lit(NO_ID), c)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on one machine (tests) a temporary one where the session has none."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        sc.setCheckpointDir(at := tempfile.mkdtemp(prefix="quantweft-"))
    return at


#: Shuffle files go as soon as the write that needed them is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = [[]]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written within are deleted at the end, but for those that it is called with: what is returned is read
    from them.  These go with the enclosing scope, at last when the driver ends."""
    mine: list[str] = []
    keep: set[str] = set()

    def kept(df: DataFrame) -> DataFrame:
        keep.add(df.written_at)
        return df

    _scopes.append(mine)
    try:
        yield kept
    finally:
        _scopes.pop()
        _scopes[-1].extend(p for p in mine if p in keep)
        _delete([p for p in mine if p not in keep])


def _delete(paths: list[str]) -> None:
    for path in paths:
        # a store that Arrow does not know, or a folder that is gone: left to whoever clears the shared folder
        with suppress(OSError, pa.ArrowException):
            fs, at = FileSystem.from_uri(path)
            fs.delete_dir(at)


atexit.register(lambda: _delete(_scopes[0]))

#: A list of ids is broadcast up to so many of them (8 bytes each, some tens of MB as a hash table).
MOST_BROADCAST = 1_000_000


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (materialized): texts stay where they are while the list is short."""
    ids = ids.select("doc_id").distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi")


def apart(c: Column | str) -> Column:
    """The same integer key in another guise.

    After groupBy(key) Spark would join on that partitioning without an exchange, and then AQE cannot split
    a hot partition of the other side.  Joining on apart(key) on both sides gives both an exchange of their own.
    """
    c = F.col(c) if isinstance(c, str) else c
    return c.bitwiseXOR(F.lit(0x5DEECE66D))

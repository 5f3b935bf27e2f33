"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, remainder: int):
    """Whether a row's label is kept from training: crc32 of doc_id as text, a null id as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def labelled(docs: DataFrame, labels: DataFrame, target: str, modulus: int, remainder: int, most: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of training rows, at most most[label] of each label, and the numbers of rows by label.

    The sample is the rows of smallest xxhash64(doc_id): the same on every run and spread over the corpus.  Its size is
    bounded by `most` whatever the corpus, so it is broadcast to find the texts.
    """
    rows = labels.select("doc_id", F.col(target).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    rows = rows.filter(~held_out(modulus, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = rows.filter("label = 1").orderBy(order, "doc_id").limit(most[1]).unionByName(rows.filter("label = 0").orderBy(order, "doc_id").limit(most[0]))
    chosen = chosen.select(F.col("doc_id").alias("li"), "label")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("li"))
    return found.select("text", "label"), sizes

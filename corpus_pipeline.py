"""Corpus cleaning pipeline: toxicity, exact copies, near copies, benchmark passages, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.  Each stage's result
is written as Parquet and read again as the next one's documents.  All stages but the last return the columns of
documents.  Ids that are null or repeat are handled: such inputs get row numbers in the order of doc_id for the stages
that decide by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import bpe, common, decontamination, exact_dedup, jaccard_join, toxicity

#: SQL has no form for the learned, aligned and tokenised stages.
ORACLE_SQL = None

#: Near copies share this much of their shingles of so many words.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.5 or more."""
    model = toxicity.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.civil(docs, model)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of distinct row numbers in the order of doc_id: doc_id itself where that is distinct."""
    name = "row"
    while name in docs.columns:
        name += "_"
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    placed = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return common.materialize(placed.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    gone = gone.select(F.col("doc_id").alias(row))
    return docs.join(gone, row, "left_anti").drop(row)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the row of the largest doc_id."""
    rows, row = _numbered(docs)
    groups = exact_dedup.exact_groups(rows.select(F.col(row).alias("doc_id"), "text"))
    return _without(rows, row, groups.filter("not kept")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the similarity of their word shingles keeps the one of the smallest doc_id."""
    rows, row = _numbered(docs)
    groups = jaccard_join.jaccard_groups(rows.select(F.col(row).alias("doc_id"), "text"), SHINGLE_WORDS, SIMILARITY_PERCENT)
    return _without(rows, row, groups.filter("component_id <> doc_id")).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes that they decode to."""
    path, pattern = bpe.vocabulary()
    coded = bpe.round_trip_documents(docs, path, pattern)
    return coded.select("doc_id", "ids", *bpe.digests())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

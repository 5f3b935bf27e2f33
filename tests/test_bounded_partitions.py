"""Windows by code: partitions of a bounded size, one pass, no join back to the rows."""

from pyspark.sql import functions as F

from quantweft.operators import preparation as Q
from quantweft.operators import windows as X


def test_partitions_by_code(spark):
    rows = spark.range(6000).select((F.col("id") % 60).alias("code"), (F.col("id") / 60).cast("int").alias("t"))
    parts = X.by_code(rows, "test", most=500)
    assert parts.rdd.getNumPartitions() == 12 and parts.count() == 6000
    assert parts.select("code", F.spark_partition_id().alias("p")).distinct().count() == 60
    assert X.by_code(rows, "test").rdd.getNumPartitions() == 4


def test_styles_without_a_join(spark):
    panel = spark.range(400).selectExpr("id % 4 as code", "cast(id div 4 as int) as t", "1.0 + id as close", "10.0 as cap", "2.0 as trade_value", "1.0 as ttm", "0.01D * (id div 4 % 7) as m")
    out = Q.risk_styles(panel, 4, 2.0, 2, 2, 3, 1, ((2, 0.5), (4, 0.5)), 21.0)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 400

"""Risk queries without SQL read every code and date of their tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.plans import panel_queries as P
from quantweft.plans import risk_queries as K
from quantweft.sources import shapes as S

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def values(rows, column):
    return {r[0] for r in rows.select(column).distinct().collect()}


def test_every_code(spark):
    assert K.position_fold(spark, DATA).count() == S.table(spark, DATA, "lineitem").count()
    known = F.count(F.when(F.col("m").isNotNull(), F.col("r"))).over(W.partitionBy("code").orderBy("t").rowsBetween(-59, 0))
    enough = K._market_rows(P.panel(spark, DATA)).withColumn("known", known).filter("known >= 30 and t >= 60")
    assert values(K.rolling_beta(spark, DATA), "code") == values(enough, "code") != set()


def test_every_date(spark):
    panel = P.panel(spark, SMALL)
    assert values(K.factor_regression(spark, SMALL), "date") == values(panel, "date")
    assert values(K.optimize_dates(spark, SMALL), "date") == values(panel.filter("signal is not null"), "date")

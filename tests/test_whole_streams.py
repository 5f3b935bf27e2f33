"""Stream queries read all days of events."""

from pyspark.sql import functions as F

from quantweft.plans import stream_queries as K
from quantweft.sources import shapes as S

SMALL = "/root/testdata/sf0.001"


def test_every_day(spark):
    days = {str(r.day) for r in S.ticks(spark, SMALL).select("day").distinct().collect()}
    assert len(days) > 2
    assert {r.day for r in K.stream_minute_bars(spark, SMALL).select(F.substring("minute", 1, 10).alias("day")).distinct().collect()} == days
    assert {r.day for r in K.stream_second_features(spark, SMALL).select("day").distinct().collect()} == days

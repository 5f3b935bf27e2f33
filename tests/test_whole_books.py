"""Queries without SQL read all rows: every code, date, slot and day of their tables."""

from pyspark.sql import functions as F

from quantweft.plans import book_queries as K
from quantweft.sources import shapes as S

SMALL = "/root/testdata/sf0.001"


def test_limit_queue_orders_in_every_slot_of_every_day(spark):
    days = S.ticks(spark, SMALL).select("code", "day").distinct()
    got = K.limit_queue(spark, SMALL).groupBy("code", "day").agg(F.countDistinct("order_id").alias("n"))
    assert days.select("day").distinct().count() > 3
    assert sorted(map(tuple, got.collect())) == sorted((r.code, r.day, K.SLOTS) for r in days.collect())

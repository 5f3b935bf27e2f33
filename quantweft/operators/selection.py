"""Exact quantiles of groups of any size by narrowing: counts by bucket, then only the bucket that holds the rank.

No group is sorted or gathered.  A round counts the values of each wanted rank's interval in at most BUCKETS monotone buckets, in the
tasks first, and keeps the bucket with the rank; its own least and largest values bound the next round.  A double has 64 bits, so a
handful of rounds leave one value, or few enough to order.  Buckets are even over an interval, or even in the logarithm where it
spans magnitudes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.operators.windows import UP
from quantweft.sources.staging import written

BUCKETS = 1024
#: An interval of so many values is ordered.
SMALL = 100_000
#: Intervals (groups x ranks) are broadcast up to so many rows.
MOST_BROADCAST = 200_000


def _bucket(x: Column, lo: Column, hi: Column) -> Column:
    """0 .. BUCKETS - 1, never falling in x."""
    half = BUCKETS // 2 - 1
    even = F.floor((x - lo) / (hi - lo) * (BUCKETS - 1))
    magnitude = lambda a, v, b: F.floor((F.log(v) - F.log(a)) / (F.log(b) - F.log(a)) * (BUCKETS - 1))
    around = F.when(x < 0, half - 1 - F.floor(x / lo * (half - 1))).when(x == 0, half).otherwise(half + 1 + F.floor(x / hi * (half - 1)))
    kind = F.when((lo < 0) & (hi > 0), around).when((lo > 0) & (hi / lo > BUCKETS), magnitude(lo, x, hi)).when((hi < 0) & (lo / hi > BUCKETS), (BUCKETS - 1) - magnitude(-hi, -x, -lo)).otherwise(even)
    return F.least(F.greatest(kind, F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def exact_quantiles(rows: DataFrame, by: list[str], value: str, quantiles: list[float], small: int = SMALL, stored: bool = False) -> DataFrame:
    """(by, quantile, n, value): linear quantiles of the known values of each group.  Infinite values are not allowed; groups without a
    known value have no row; NULL is a group like any other.  stored: rows are a table, which need not be written once more."""
    keys = [f"_k{i}" for i in range(len(by))]
    x = F.col(value).cast("double")
    named = rows.filter(x.isNotNull() & ~F.isnan(x)).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], x.alias("_x"))
    # groups get numbers: a NULL key never equals another in a join
    data = named.withColumn("_g", F.xxhash64(F.struct(*keys)) if keys else F.lit(0).cast("long")).withColumn("_h", F.hash(F.struct(*keys)) if keys else F.lit(0))
    data = data.select("_g", "_h", "_x", *keys)
    data = data if stored else written(data, "values")
    groups = data.groupBy("_g", "_h", *keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    groups = written(groups, "groups")
    at = F.col("q") * (F.col("n") - 1)
    wanted = groups.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))).withColumn("k", F.floor(at)).withColumn("part", at - F.floor(at))
    ranks = wanted.select("_g", "_h", "n", "lo", "hi", F.explode(F.array("k", F.least(F.col("k") + 1, F.col("n") - 1))).alias("k")).distinct()
    left = ranks.select("_g", "_h", "k", F.col("k").alias("rank"), F.col("n").alias("size"), "lo", "hi")
    data = data.select("_g", "_h", "_x")
    within = F.col("_x").between(F.col("lo"), F.col("hi"))
    sent = lambda t: F.broadcast(t) if t.count() <= MOST_BROADCAST else t
    done = left.limit(0)
    while True:
        wide = (F.col("lo") < F.col("hi")) & (F.col("size") > small)
        done, narrow = done.unionByName(left.filter(~wide)), left.filter(wide)
        if narrow.isEmpty():
            break
        hits = data.join(sent(narrow), ["_g", "_h"]).filter(within)
        counts = hits.groupBy("_g", "_h", "k", "rank", _bucket(F.col("_x"), F.col("lo"), F.col("hi")).alias("b")).agg(F.count(F.lit(1)).alias("size"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        before = F.coalesce(F.sum("size").over(W.partitionBy("_g", "_h", "k").orderBy("b").rowsBetween(UP, -1)), F.lit(0))
        held = counts.withColumn("_before", before).filter((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("size")))
        left = written(held.select("_g", "_h", "k", (F.col("rank") - F.col("_before")).alias("rank"), "size", "lo", "hi"), "ranks")
    few = done.filter("lo < hi")
    place = F.row_number().over(W.partitionBy("_g", "_h", "k").orderBy("_x")) - 1
    ordered = data.join(sent(few), ["_g", "_h"]).filter(within).withColumn("_at", place).filter("_at = rank").select("_g", "_h", "k", F.col("_x").alias("v"))
    values = done.filter("lo = hi").select("_g", "_h", "k", F.col("lo").alias("v")).unionByName(ordered)
    low = values.select("_g", "_h", "k", F.col("v").alias("v0"))
    high = values.select("_g", "_h", F.col("k").alias("k1"), F.col("v").alias("v1"))
    out = wanted.withColumn("k1", F.least(F.col("k") + 1, F.col("n") - 1)).join(low, ["_g", "_h", "k"]).join(high, ["_g", "_h", "k1"])
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], F.col("q").alias("quantile"), "n", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")).alias("value"))

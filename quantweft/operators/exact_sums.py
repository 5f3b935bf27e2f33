"""Sums of doubles without rounding: values are split into parts whose sums are exact, whatever their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.operators.windows import UP

#: Bits of a double; smallest exponent of a unit.
BITS, LEAST = 53, -1000


def exact_rolling(df: DataFrame, value: Column, partition: list[str], order: list[str], n: int, out: str, parts: int = 3) -> DataFrame:
    """Adds `out_n`, `out_sum` and `out_mean` over the known values of the last n rows (fewer at the beginning); mean and sum are NULL
    without any.  NULL, NaN and infinite values are unknown.

    A value is the sum of `parts` multiples of falling units (powers of two), chosen by the largest value and the number of rows of its
    partition, so that no running sum of a part needs more than 53 bits: sums and their differences are exact, a large value leaves
    nothing behind when it leaves the window.  What is below the last unit, 2**-99 of the largest value in a million rows, is left
    out; the parts are added with their error, so the sum is the exact one to a unit in the last place.

    Two running columns a part, constant work a row whatever n is, one partitioning.  `order` must tell rows apart.
    """
    whole = W.partitionBy(*partition)
    v = value.cast("double")
    df = df.withColumn("_v", F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))
    top = F.coalesce(F.ceil(F.log2(F.max(F.abs("_v")).over(whole))), F.lit(0)) + 1
    room = F.ceil(F.log2(F.count(F.lit(1)).over(whole))) + 1
    df = df.withColumns({"_top": top, "_room": room})
    rest, split = F.coalesce("_v", F.lit(0.0)), {}
    for k in range(parts):
        unit = F.pow(F.lit(2.0), F.greatest(F.col("_top") + (F.col("_room") - BITS) * (k + 1), F.lit(LEAST)))
        df = df.withColumn("_unit", unit).withColumn("_rest", rest).withColumn(f"_p{k}", F.rint(F.col("_rest") / F.col("_unit")) * F.col("_unit"))
        rest = F.col("_rest") - F.col(f"_p{k}")
    split = {f"_p{k}": F.col(f"_p{k}") for k in range(parts)} | {"_known": F.col("_v").isNotNull().cast("long")}
    rows = whole.orderBy(*order)
    old = lambda c: F.coalesce(F.sum(c).over(rows.rowsBetween(UP, -n)), F.lit(0))
    df = df.withColumns({f"{name}_s": F.sum(c).over(rows.rowsBetween(UP, 0)) - old(c) for name, c in split.items()})
    total, error = F.col("_p0_s"), F.lit(0.0)
    for k in range(1, parts):
        df = df.withColumns({"_total": total, "_error": error, "_next": F.col(f"_p{k}_s")})
        both = F.col("_total") + F.col("_next")
        back = both - F.col("_total")
        df = df.withColumns({f"_t{k}": both, f"_e{k}": F.col("_error") + ((F.col("_total") - (both - back)) + (F.col("_next") - back))})
        total, error = F.col(f"_t{k}"), F.col(f"_e{k}")
    known = F.col("_known_s")
    df = df.withColumn(f"{out}_n", known).withColumn(f"{out}_sum", F.when(known > 0, total + error)).withColumn(f"{out}_mean", F.col(f"{out}_sum") / F.nullif(known, F.lit(0)))
    temporary = [c for k in range(parts) for c in (f"_p{k}", f"_p{k}_s", f"_t{k}", f"_e{k}")]
    return df.drop("_v", "_top", "_room", "_unit", "_rest", "_known_s", "_total", "_error", "_next", *temporary)

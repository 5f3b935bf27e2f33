"""Window and as-of building blocks.  All take and return DataFrames or columns; none leaves the JVM.

Row-offset windows need a grid without gaps: see `densify`.  Ties are broken by explicit keys everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.sources.staging import written

UP, UF = W.unboundedPreceding, W.unboundedFollowing


def densify(values: DataFrame, codes: DataFrame, dates: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """Every code with every date and its values, NULL where there are none; `t` numbers the dates.

    The grid is the product by definition: its size is that of the dense panel.  Dates are few and are broadcast.
    """
    numbered = dates.select(date).distinct().withColumn("t", F.row_number().over(W.orderBy(date)) - 1)
    grid = codes.select(code).distinct().crossJoin(F.broadcast(numbered))
    return grid.join(values, [code, date], "left")


#: Rows of a partition of `by_code`: windows one after the other hold a sort of it each.
ROWS_A_TASK = 100_000


def by_code(rows: DataFrame, tag: str, code: str = "code", most: int = ROWS_A_TASK) -> DataFrame:
    """rows, written once, in as many partitions by code as keep each near `most` rows: windows by code need no other shuffle, and what a
    task holds does not grow with the number of codes."""
    rows = written(rows, tag)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // most)), code)


def average_rank(value: Column | str, *partition: str) -> Column:
    """Rank from 1 within the partition; equal values share the mean of their ranks; NULL has none."""
    v = F.col(value) if isinstance(value, str) else value
    known = v.isNotNull()
    rank = F.rank().over(W.partitionBy(*partition, known).orderBy(v))
    same = F.count(F.lit(1)).over(W.partitionBy(*partition, v))
    return F.when(known, rank + (same - 1) / F.lit(2.0))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: correlation over rows where both are known; NULL without spread, where the built-in one raises."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = lambda c, other: F.when(other.isNotNull(), c)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(both(x, y)) * F.stddev_pop(both(y, x)))


def percent_rank(value: Column | str, *partition: str) -> Column:
    """Average rank over the number of known values."""
    v = F.col(value) if isinstance(value, str) else value
    return average_rank(v, *partition) / F.count(v).over(W.partitionBy(*partition))


def rank_buckets(value: Column | str, n: int, partition: list[str], order: list[str], ascending: bool = False) -> Column:
    """Bucket 0..n-1 by rank (ties by `order`): floor((rank - 1) * n / count); 0 holds the largest unless ascending."""
    v = F.col(value) if isinstance(value, str) else value
    known = v.isNotNull()
    rank = F.row_number().over(W.partitionBy(*partition, known).orderBy(v.asc() if ascending else v.desc(), *order))
    count = F.count(v).over(W.partitionBy(*partition))
    return F.when(known, F.least(F.floor((rank - 1) * F.lit(n) / count), F.lit(n - 1)))


def quantile_buckets(value: Column | str, q: int, partition: list[str], order: list[str]) -> Column:
    """Bucket 1..q of ranks 1..n cut at their linear quantiles, right ends closed."""
    v = F.col(value) if isinstance(value, str) else value
    rank = F.row_number().over(W.partitionBy(*partition).orderBy(v.desc(), *order))
    n = F.count(v).over(W.partitionBy(*partition))
    return F.when(v.isNotNull(), F.greatest(F.lit(1), F.ceil((rank - 1) * F.lit(q) / F.greatest(n - 1, F.lit(1)))))


def global_row_number(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Row numbers 1, 2, ... over all rows, without one task that sees them all.

    Rows are placed by range, sorted within their partitions and written once with their place: the bounds of the ranges come
    from a sample, so a second computation could place them otherwise.  A number is the place within a partition plus the sizes of
    the partitions before (a row a partition, broadcast), both read from what was written.  Rows that `order` does
    not tell apart stand in any order.
    """
    place = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    placed = written(placed, "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(UP, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


def fill_forward(value: Column | str, partition: list[str], order: list[str]) -> Column:
    """Last known value; NaN counts as unknown."""
    v = F.col(value) if isinstance(value, str) else value
    return F.last(F.when(~F.isnan(v.cast("double")), v), ignorenulls=True).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(UP, 0))


def trailing(fn: Column, partition: list[str], order: list[str], n: int, skip: int = 0) -> Column:
    """An aggregate over the last n rows, ending `skip` rows ago."""
    return fn.over(W.partitionBy(*partition).orderBy(*order).rowsBetween(-(n - 1) - skip, -skip))


def long_rolling_sum(value: Column | str, partition: list[str], order: list[str], n: int) -> Column:
    """Sum of the last n rows as a difference of running sums: constant work a row, however long n is."""
    v = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0.0))
    w = W.partitionBy(*partition).orderBy(*order)
    running = F.sum(v).over(w.rowsBetween(UP, 0))
    return running - F.coalesce(F.sum(v).over(w.rowsBetween(UP, -n)), F.lit(0.0))


def trailing_time_sum(value: Column, partition: list[str], time: str, ties: list[str], width: int) -> Column:
    """Sum over rows with time in (time - width, time] that come no later in row order."""
    rows = F.sum(value).over(W.partitionBy(*partition).orderBy(time, *ties).rowsBetween(UP, 0))
    old = F.sum(value).over(W.partitionBy(*partition).orderBy(time).rangeBetween(UP, -width))
    return rows - F.coalesce(old, F.lit(0))


def forward_time_max(value: Column, partition: list[str], time: str, ties: list[str], width: int) -> Column:
    """Largest value after the row in row order, with time in [time, time + width]; whole seconds."""
    later = F.max(value).over(W.partitionBy(*partition).orderBy(time).rangeBetween(1, width))
    same = F.max(value).over(W.partitionBy(*partition, time).orderBy(*ties).rowsBetween(1, UF))
    return F.greatest(later, same)


def forward_extreme(value: Column, partition: list[str], order: str, lo: int, n: int, largest: bool = True) -> Column:
    """Extreme of rows +lo .. +lo+n-1, clipped at the end (a direct frame: for short n)."""
    return (F.max if largest else F.min)(value).over(W.partitionBy(*partition).orderBy(order).rowsBetween(lo, lo + n - 1))


def trailing_extreme_blocks(df: DataFrame, value: str, partition: list[str], index: str, n: int, out: str, largest: bool = True) -> DataFrame:
    """Extreme of the last n rows (of fewer at the beginning) for long n: the end of one block of n and the beginning of the next.

    Rows have the index 0, 1, 2 ... without gaps.
    """
    fn = F.max if largest else F.min
    w = W.partitionBy(*partition, "_block")
    parts = df.withColumn("_block", F.floor(F.col(index) / n)).withColumn("_from", fn(value).over(w.orderBy(F.desc(index)).rowsBetween(UP, 0))).withColumn("_to", fn(value).over(w.orderBy(index).rowsBetween(UP, 0)))
    before = F.lag("_from", n - 1).over(W.partitionBy(*partition).orderBy(index))
    return parts.withColumn(out, (F.greatest if largest else F.least)(before, "_to")).drop("_block", "_from", "_to")


def forward_extreme_blocks(df: DataFrame, value: str, partition: list[str], index: str, lo: int, n: int, out: str, largest: bool = True) -> DataFrame:
    """The same for long n, two running extremes instead of one frame of n rows.

    Rows (index 0, 1, 2 ... without gaps) fall into blocks of n; a window of n rows is the end of one block and the beginning of the next.
    """
    fn = F.max if largest else F.min
    block = F.floor(F.col(index) / n)
    w = W.partitionBy(*partition, "_block")
    parts = df.withColumn("_block", block).withColumn("_from", fn(value).over(w.orderBy(F.desc(index)).rowsBetween(UP, 0))).withColumn("_to", fn(value).over(w.orderBy(index).rowsBetween(UP, 0)))
    ahead = W.partitionBy(*partition).orderBy(index)
    last = F.max(F.col(index)).over(W.partitionBy(*partition))
    begin = F.lead("_from", lo).over(ahead)
    end = F.lead("_to", lo + n - 1).over(ahead)
    # past the last row the end is that of the last block
    tail = F.last("_to").over(W.partitionBy(*partition).orderBy(index).rowsBetween(UP, UF))
    both = (F.greatest if largest else F.least)(begin, F.when(F.col(index) + (lo + n - 1) <= last, end).otherwise(F.when(F.floor((F.col(index) + lo) / n) != F.floor(last / n), tail)))
    both = F.when(F.col(index) + lo <= last, both)
    return parts.withColumn(out, both).drop("_block", "_from", "_to")


#: Weights of rows this many half-lives apart are no longer told apart in one scale: 2**500.
MOST_HALF_LIVES = 500


def trailing_weighted_sums(df: DataFrame, values: dict[str, Column], partition: list[str], index: str, n: int, half_life: float | None = None) -> DataFrame:
    """Adds a column a value: its sum over the last n rows (fewer at the beginning), weighed by 0.5 ** (age / half_life) if one is given.
    NULL counts as 0.

    Rows (index 0, 1, 2 ... without gaps) fall into blocks of n; the last n rows are the end of one block and the beginning of the next.
    Both are running sums, weighed from their own block's edge: no row sums n others, nothing is subtracted, and no weight leaves
    the range of a double while n is at most MOST_HALF_LIVES half-lives.
    """
    if half_life is not None and n > MOST_HALF_LIVES * half_life:
        raise ValueError(f"a window of {n} rows exceeds {MOST_HALF_LIVES} half-lives")
    rate = 0.0 if half_life is None else 1.0 / half_life
    weight = lambda exponent: F.pow(F.lit(2.0), exponent * rate) if rate else F.lit(1.0)
    at = F.col(index)
    df = df.withColumn("_block", F.floor(at / n)).withColumn("_pos", at % n)
    block = W.partitionBy(*partition, "_block")
    heads, tails = block.orderBy(index).rowsBetween(UP, 0), block.orderBy(F.desc(index)).rowsBetween(UP, 0)
    known = {name: F.coalesce(v.cast("double"), F.lit(0.0)) for name, v in values.items()}
    df = df.withColumns({f"_head_{name}": F.sum(v * weight(F.col("_pos"))).over(heads) for name, v in known.items()} | {f"_tail_{name}": F.sum(v * weight(F.col("_pos") - (n - 1))).over(tails) for name, v in known.items()})
    before = W.partitionBy(*partition).orderBy(index)
    df = df.withColumns({f"_old_{name}": F.lag(f"_tail_{name}", n - 1).over(before) for name in values})
    # the row n - 1 ago is of the same block only if that ends here
    old = lambda name: F.when(F.col("_pos") < n - 1, F.coalesce(F.col(f"_old_{name}"), F.lit(0.0)) * weight(-(F.col("_pos") + 1))).otherwise(0.0)
    df = df.withColumns({name: F.col(f"_head_{name}") * weight(-F.col("_pos")) + old(name) for name in values})
    return df.drop("_block", "_pos", *[f"_{x}_{name}" for x in ("head", "tail", "old") for name in values])


def decayed_mean(df: DataFrame, value: Column, partition: list[str], index: str, half_life: float, out: str) -> DataFrame:
    """Adds the mean of the known values so far, weighed by 0.5 ** (age / half_life); NULL before the first.

    Within a block of MOST_HALF_LIVES half-lives it is a ratio of running sums; of the blocks before, the last two that matter are
    carried over in the block's own scale (what is older weighs less than 2**-500 of them).  The span of the index is not bounded.
    """
    span = max(1, int(MOST_HALF_LIVES * half_life))
    df = df.withColumn("_block", F.floor(F.col(index) / span)).withColumn("_v", value)
    grown = F.when(F.col("_v").isNotNull(), F.pow(F.lit(2.0), (F.col(index) % span) / half_life))
    df = df.withColumn("_w", grown)
    w = W.partitionBy(*partition, "_block").orderBy(index).rowsBetween(UP, 0)
    df = df.withColumn("_num", F.sum(F.col("_w") * F.col("_v")).over(w)).withColumn("_den", F.sum("_w").over(w))
    totals = df.groupBy(*partition, "_block").agg(F.sum(F.col("_w") * F.col("_v")).alias("n"), F.sum("_w").alias("d"))
    order = W.partitionBy(*partition).orderBy("_block")
    full = F.when(F.col("d").isNotNull(), F.struct("_block", "n", "d", F.when(F.lag("_block").over(order) == F.col("_block") - 1, F.struct(F.lag("n").over(order).alias("n"), F.lag("d").over(order).alias("d"))).alias("old")))
    totals = totals.withColumn("full", full).select(*partition, "_block", F.last("full", ignorenulls=True).over(order.rowsBetween(UP, -1)).alias("_last"))
    df = df.join(totals, [*partition, "_block"])
    less = F.pow(F.lit(2.0), (F.col("_last._block") - F.col("_block")) * (span / half_life))
    both = lambda x: F.col(f"_{'num' if x == 'n' else 'den'}") + F.coalesce(F.col(f"_last.{x}") * less, F.lit(0.0))
    older = lambda x: F.col(f"_last.{x}") + F.coalesce(F.col(f"_last.old.{x}") * 2.0 ** -(span / half_life), F.lit(0.0))
    return df.withColumn(out, F.when(F.col("_den").isNotNull(), both("n") / both("d")).otherwise(older("n") / older("d"))).drop("_block", "_v", "_w", "_num", "_den", "_last")


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False, ties: list[str] | None = None) -> DataFrame:
    """left with the values of the last right row at or before its time (strict: before).

    One union and one sort by key: no range join, so a hot key costs a longer sort and nothing else.
    `ties` order right rows of one time; the last wins.
    """
    ties = ties or []
    l = left.select(*by, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*values, *ties).alias("v")).schema["v"].dataType).alias("_right"))
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), F.struct(*values, *ties).alias("_right"))
    order = [F.col("_t"), F.col("_side"), *[F.col("_right")[t] for t in ties]]
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(UP, 0)
    merged = l.unionByName(r).withColumn("_found", F.last("_right", ignorenulls=True).over(w))
    return merged.filter("_left is not null").select("_left.*", *[F.col("_found")[v].alias(v) for v in values])


def next_session(dates: DataFrame, column: str, calendar: DataFrame, strict: bool) -> DataFrame:
    """dates with `session`: the first calendar date after `column` (not strict: on or after); NULL beyond the last.

    The calendar becomes half-open intervals and the join an equality on a day number: each interval is spelled out by
    day, so no range join is left; a calendar has one row a day.
    """
    w = W.orderBy("date")
    spans = calendar.select("date", F.lag("date").over(w).alias("prev"))
    days = spans.select(F.col("date").alias("session"), F.explode(F.expr("sequence(coalesce(prev, date_sub(date, 400)), date_sub(date, 1))") if strict else F.expr("sequence(date_add(coalesce(prev, date_sub(date, 400)), 1), date)")).alias("_day"))
    return dates.join(F.broadcast(days), F.col(column).cast("date") == F.col("_day"), "left").drop("_day")

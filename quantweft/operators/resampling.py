"""Bootstraps and matched controls.  Draws come from a counter hash, so they are the same on every engine and retry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.functions.market import HASH32_STEPS, REPLICATE_ADDEND, SEED_ADDEND, SEED_FACTOR, hash32, hash32_of
from quantweft.operators import windows as X
from quantweft.sources.shapes import r6


def seeded(seed: int) -> int:
    return hash32_of(seed * SEED_FACTOR + SEED_ADDEND)


def draw(seed: int, row: Column, k: Column, n: Column) -> Column:
    """A number 0..n-1 for (seed, row, k): the high bits of a hash times n."""
    one = hash32(F.lit(seeded(seed)).bitwiseXOR(hash32(row + F.lit(REPLICATE_ADDEND))))
    u = hash32(one.bitwiseXOR(hash32(k * 3 + 1)))
    # below 2**63 while n is below 2**31
    return F.shiftright(u * n, 32)


#: A count of 0, 1, 2 ... is the number of these that a 32-bit hash reaches: the distribution function of Poisson(1), up to what 32 bits tell.
POISSON = [math.ceil(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]
_LOW = (1 << 32) - 1


def _hashed(df: DataFrame, name: str) -> DataFrame:
    """hash32 of a column in its place.  One projection a step keeps it in generated code."""
    for shift, factor in HASH32_STEPS:
        v = F.col(name)
        df = df.withColumn(name, (v.bitwiseXOR(F.shiftrightunsigned(v, shift)) * F.lit(factor)).bitwiseAND(F.lit(_LOW)))
    return df.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(F.col(name), 16)))


def cluster_key(cluster: Column) -> Column:
    """A number for a cluster: the first 60 bits of the SHA-256 of its text."""
    return F.conv(F.substring(F.sha2(cluster.cast("string").cast("binary"), 256), 1, 15), 16, 10).cast("long")


def resampled(rows: DataFrame, key: Column, replicates: int, seed: int, keep: list[str]) -> DataFrame:
    """(keep, rep, times): how often each row is drawn in each replicate, where it is drawn at all.

    A bootstrap without a draw that rows share: the times are Poisson(1) numbers from a hash of (seed, key, replicate), which is what
    drawing n of n rows with replacement comes to but for the fixed total.  So rows never meet: sums by replicate are taken in the
    tasks first, and what is shuffled is a row a task, group and replicate.
    """
    low = F.lit(_LOW)
    rows = rows.select(*keep, key.alias("_key"))
    one = _hashed(rows.withColumn("_u", (F.col("_key").bitwiseAND(low) + F.lit(REPLICATE_ADDEND)).bitwiseAND(low)), "_u")
    two = _hashed(one.withColumn("_u", F.col("_u").bitwiseXOR(F.lit(seeded(seed))).bitwiseXOR(F.shiftrightunsigned("_key", 32).bitwiseAND(low))), "_u")
    salts = F.expr(f"array({', '.join(f'{hash32_of(k * 3 + 1)}L' for k in range(replicates))})")
    each = two.select(*keep, "_u", F.posexplode(salts).alias("rep", "_salt"))
    drawn = _hashed(each.withColumn("_u", F.col("_u").bitwiseXOR(F.col("_salt"))), "_u").filter(F.col("_u") >= POISSON[0])
    times = F.lit(0)
    for limit in POISSON:
        times = times + (F.col("_u") >= limit).cast("int")
    return drawn.select(*keep, "rep", times.cast("double").alias("times"))


def _ends(stat: str, ci: float) -> list[Column]:
    """Lower and upper end; the values are one a replicate."""
    edge = round((1 - ci) / 2, 9)
    return [F.percentile(stat, F.lit(edge)).alias("lower"), F.percentile(stat, F.lit(round(1 - edge, 9))).alias("upper")]


def block_draws(series: DataFrame, values: list[str], order: str, block: int, replicates: int, seed: int) -> DataFrame:
    """(rep, n, values): moving blocks of a series with as many rows as it has; a row a replicate and place.

    The series is numbered once; replicates x blocks are drawn as rows and joined to it on the number.
    """
    s = X.global_row_number(series.select(*values, order), [F.col(order)], "i").select(*values, (F.col("i") - 1).alias("i"))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    draws = s.sparkSession.range(replicates).select(F.col("id").alias("rep")).crossJoin(F.broadcast(n)).filter(F.col("n") >= block)  # one row
    draws = draws.select("rep", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block) - 1)).alias("blk"))
    draws = draws.withColumn("start", draw(seed, F.col("rep"), F.col("blk"), F.col("n") - (block - 1)))
    at = draws.select("rep", "n", "blk", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o")).filter(F.col("blk") * block + F.col("o") < F.col("n"))
    return at.withColumn("i", F.col("start") + F.col("o")).join(s, "i").select("rep", "n", *values)


def block_bootstrap(series: DataFrame, value: str, order: str, block: int, replicates: int, seed: int, per_year: int = 12) -> DataFrame:
    """(replicates, mean, lower, upper) of moving-block bootstrap means, a year's worth; 5 % and 95 % percentiles."""
    drawn = block_draws(series.select(F.col(value).alias("x"), order), ["x"], order, block, replicates, seed)
    means = drawn.groupBy("rep").agg((F.avg("x") * per_year).alias("m"))
    return means.agg(F.count(F.lit(1)).alias("replicates"), r6(F.avg("m")).alias("mean"), r6(F.percentile("m", F.lit(0.05))).alias("lower"), r6(F.percentile("m", F.lit(0.95))).alias("upper"))


def matched_control(trades: DataFrame, pool: DataFrame, key: str, strata: list[str], value: str, per: int, seed: int) -> DataFrame:
    """(strata, n, trade_mean, control_mean, alpha): each trade against the mean of its matched controls, by stratum."""
    each = matched_pairs(trades, pool, key, strata, value, per, seed).groupBy(*strata, key, "trade").agg(F.avg("control").alias("control"))
    return each.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("trade")).alias("trade_mean"), r6(F.avg("control")).alias("control_mean"), r6(F.avg(F.col("trade") - F.col("control"))).alias("alpha"))


def cluster_difference(a: DataFrame, b: DataFrame, cluster: Column, value: str) -> DataFrame:
    """(cluster, sum_a, n_a, sum_b, n_b): the sums that a joint cluster bootstrap of two samples draws from."""
    sums = lambda df, x: df.groupBy(cluster.alias("cluster")).agg(F.sum(value).alias(f"s_{x}"), F.count(F.lit(1)).alias(f"k_{x}"))
    both = sums(a, "a").join(sums(b, "b"), "cluster", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("cluster", r6(F.coalesce("s_a", F.lit(0.0))).alias("sum_a"), zero("k_a").alias("n_a"), r6(F.coalesce("s_b", F.lit(0.0))).alias("sum_b"), zero("k_b").alias("n_b"))


def cluster_bootstrap(rows: DataFrame, value: Column, cluster: Column, weight: Column | None = None, replicates: int = 2000, seed: int = 0, ci: float = 0.95) -> DataFrame:
    """(n_clusters, mean, lower, upper, positive): weighted mean by whole clusters (dates) drawn with replacement; positive is
    the share of replicates above 0.  Rows are summed by cluster first; no interval for fewer than two clusters."""
    w = F.lit(1.0) if weight is None else weight
    sums = rows.groupBy(cluster.cast("string").alias("cluster")).agg(F.sum(value * w).alias("s"), F.sum(w).alias("w"))
    drawn = resampled(sums, cluster_key(F.col("cluster")), replicates, seed, ["s", "w"]).groupBy("rep")
    means = drawn.agg(F.try_divide(F.sum(F.col("times") * F.col("s")), F.sum(F.col("times") * F.col("w"))).alias("m"))
    boot = means.filter("m is not null").agg(*_ends("m", ci), F.avg((F.col("m") > 0).cast("double")).alias("positive"))
    whole = sums.agg(F.count(F.lit(1)).alias("n_clusters"), F.try_divide(F.sum("s"), F.sum("w")).alias("mean"))
    several = lambda c: F.when(F.col("n_clusters") >= 2, F.col(c)).alias(c)
    return whole.crossJoin(F.broadcast(boot)).select("n_clusters", "mean", several("lower"), several("upper"), several("positive"))  # a row each


def cluster_bootstrap_difference(a: DataFrame, b: DataFrame, cluster: Column, value: str, replicates: int = 2000, seed: int = 0, ci: float = 0.95) -> DataFrame:
    """(n_clusters, difference, lower, upper): mean of a less mean of b; clusters of both are drawn together, so that shocks of a
    date cancel.  NULLs where either is empty."""
    sums = lambda df, x: df.groupBy(cluster.cast("string").alias("cluster")).agg(F.sum(value).alias(f"s{x}"), F.count(value).alias(f"n{x}"))
    both = sums(a, "a").join(sums(b, "b"), "cluster", "full_outer").fillna(0)
    total = lambda c, w=F.lit(1.0): F.sum(w * F.col(c))
    gap = lambda w: F.try_divide(total("sa", w), total("na", w)) - F.try_divide(total("sb", w), total("nb", w))
    drawn = resampled(both, cluster_key(F.col("cluster")), replicates, seed, ["sa", "na", "sb", "nb"])
    boot = drawn.groupBy("rep").agg(gap(F.col("times")).alias("m")).filter("m is not null").agg(*_ends("m", ci))
    whole = both.agg(F.count(F.lit(1)).alias("n_clusters"), gap(F.lit(1.0)).alias("difference"))
    known = lambda c: F.when(F.col("difference").isNotNull(), F.col(c)).alias(c)
    return whole.crossJoin(F.broadcast(boot)).select("n_clusters", "difference", known("lower"), known("upper"))  # a row each


def paired_bootstrap(pairs: DataFrame, order: str, a: str, b: str, block: int = 6, replicates: int = 2000, seed: int = 0, per_year: int = 252) -> DataFrame:
    """(n, sharpe_lower, sharpe_upper, cagr_lower, cagr_upper, prob_better): differences of two return series of the same dates, blocks
    of dates drawn together; 95 % intervals.  No interval for series of a block or less."""
    rows = pairs.select(order, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.filter(finite("a") & finite("b"))
    drawn = block_draws(rows, ["a", "b"], order, block, replicates, seed).filter(F.col("n") >= block + 1)

    def growth(c: str) -> Column:
        """Growth a year from logarithms; -1 where the product of 1 + r is not above 0."""
        factor = 1 + F.col(c)
        dead = F.max((factor == 0).cast("int")) + F.sum((factor < 0).cast("int")) % 2
        rate = F.exp(F.sum(F.when(factor != 0, F.log(F.abs(factor)))) * (per_year / F.max("n"))) - 1
        return F.when(dead > 0, F.lit(-1.0)).otherwise(F.coalesce(rate, F.lit(0.0)))

    def ratio(c: str) -> Column:
        return F.when(F.stddev_pop(c) >= 1e-12, F.avg(c) / F.stddev_pop(c) * math.sqrt(per_year))

    each = drawn.groupBy("rep").agg((ratio("a") - ratio("b")).alias("sharpe"), (growth("a") - growth("b")).alias("cagr"))
    ends = lambda c: [F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for q, name in ((0.025, "lower"), (0.975, "upper"))]
    boot = each.agg(*ends("sharpe"), *ends("cagr"), F.avg((F.col("sharpe") > 0).cast("double")).alias("prob_better"))
    return rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(boot))  # a row each


def matched_pairs(trades: DataFrame, pool: DataFrame, key: str, strata: list[str], value: str, per: int, seed: int, keep: list[str] | None = None) -> DataFrame:
    """(key, strata, keep, trade, k, control): each trade with `per` draws with replacement from the pool rows of its stratum.
    Trades with an unknown stratum or one without a pool drop out."""
    numbered = pool.select(*strata, F.col(value).alias("control"), (F.row_number().over(W.partitionBy(*strata).orderBy(key)) - 1).alias("_rn"))
    sizes = pool.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    draws = trades.select(key, *strata, *(keep or []), F.col(value).alias("trade")).join(sizes, strata).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    draws = draws.withColumn("_rn", draw(seed, F.col(key), F.col("k"), F.col("_n")))
    return draws.join(numbered, [*strata, "_rn"]).drop("_rn", "_n")


def matched_alpha(trades: DataFrame, pool: DataFrame, key: str, strata: list[str], value: str, cluster: str, per: int, seed: int, replicates: int = 2000) -> DataFrame:
    """(n_trades, n_unmatched, n_clusters, alpha, lower, upper, p_greater): trades less their matched controls, each trade as one
    and its controls as one together; the interval draws whole dates."""
    pairs = matched_pairs(trades, pool, key, strata, value, per, seed, [cluster])
    each = pairs.groupBy(key, cluster, "trade").agg(F.avg("control").alias("control"))
    boot = cluster_bootstrap(each, F.col("trade") - F.col("control"), F.col(cluster), None, replicates, seed)
    counts = each.agg(F.count(F.lit(1)).alias("n_trades")).crossJoin(trades.agg(F.count(F.lit(1)).alias("_all")))  # a row each
    out = counts.crossJoin(boot)
    return out.select("n_trades", (F.col("_all") - F.col("n_trades")).alias("n_unmatched"), "n_clusters", F.col("mean").alias("alpha"), "lower", "upper", F.col("positive").alias("p_greater"))


def iid_bootstrap(rows: DataFrame, value: str, key: str, by: list[str], replicates: int, seed: int) -> DataFrame:
    """(by, n, mean, lower, upper): 95 % percentile interval of the mean; `key`, an integer, tells rows of a group apart."""
    known = rows.filter(F.col(value).isNotNull()).select(*by, F.col(key).cast("long").alias("_id"), F.col(value).cast("double").alias("_x"))
    drawn = resampled(known, F.col("_id"), replicates, seed, [*by, "_x"]).groupBy(*by, "rep")
    means = drawn.agg((F.sum(F.col("times") * F.col("_x")) / F.sum("times")).alias("m"))
    whole = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"))
    ends = means.groupBy(*by).agg(*_ends("m", 0.95))
    same = F.lit(True)
    for c in by:
        same = same & whole[c].eqNullSafe(ends[c])
    return whole.join(ends, same, "left").select(*[whole[c] for c in by], "n", "mean", "lower", "upper")


def rolling_ic(series: DataFrame, horizon: int, window: int) -> DataFrame:
    """(date, ic, mean, sd, n): observations at least `horizon` sessions apart, picked greedily, with trailing statistics.

    The pick is a fold over one series (a row a date); the statistics are window functions.
    """
    ordered = series.agg(F.array_sort(F.collect_list(F.struct("t", "date", "ic"))).alias("s"))
    start = F.expr("cast(array() as array<struct<t:bigint,date:date,ic:double>>)")
    kind = F.struct(F.lit(None).cast("bigint").alias("last"), start.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        take = acc["last"].isNull() | (x["t"] - acc["last"] >= horizon)
        return F.struct(F.when(take, x["t"].cast("bigint")).otherwise(acc["last"]).alias("last"), F.when(take, F.concat(acc["out"], F.array(F.struct(x["t"].cast("bigint").alias("t"), x["date"].alias("date"), x["ic"].alias("ic"))))).otherwise(acc["out"]).alias("out"))

    picked = ordered.select(F.explode(F.aggregate("s", kind, step, lambda acc: acc["out"])).alias("p")).select("p.*")
    w = W.orderBy("t").rowsBetween(-(window - 1), 0)
    out = picked.select("date", "ic", F.count("ic").over(w).alias("n"), F.avg("ic").over(w).alias("m"), F.stddev_samp("ic").over(w).alias("s"))
    return out.select("date", "ic", F.when(F.col("n") >= window, r6("m")).alias("mean"), F.when(F.col("n") >= window, r6("s")).alias("sd"), "n")



def random_entries(paths: DataFrame, episodes: DataFrame, hold: int, draws: int, seed: int) -> DataFrame:
    """(key, k, sec, exit_sec, ret): random entries into a path as a control for real ones.

    paths (key, sec, price) hold rows numbered in time; each episode (key, n_th) draws `draws` entries by hash and leaves at
    the first row at or after entry + hold.  The exit is found by one union and a window from the end, not by a range join.
    """
    w = W.partitionBy("key").orderBy("sec")
    rows = paths.withColumn("i", F.row_number().over(w) - 1)
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    pick = episodes.join(n, "key").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = pick.withColumn("i", draw(seed, F.col("n_th"), F.col("k"), F.col("n"))).join(rows, ["key", "i"]).select("key", "n_th", "k", "sec", "price")
    ask = pick.select("key", (F.col("sec") + hold).alias("at"), F.lit(1).alias("side"), F.struct("n_th", "k", "sec", "price").alias("e"), F.lit(None).cast(rows.select(F.struct("sec", "price").alias("x")).schema["x"].dataType).alias("x"))
    bid = rows.select("key", F.col("sec").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(ask.schema["e"].dataType).alias("e"), F.struct("sec", "price").alias("x"))
    back = W.partitionBy("key").orderBy(F.desc("at"), "side").rowsBetween(W.unboundedPreceding, 0)
    found = ask.unionByName(bid).withColumn("x", F.last("x", ignorenulls=True).over(back)).filter("e is not null")
    return found.select("key", "e.n_th", "e.k", "e.sec", F.col("x.sec").alias("exit_sec"), (F.col("x.price") / F.col("e.price") - 1).alias("ret"))

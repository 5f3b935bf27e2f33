"""Return statistics, HAC errors, fragility, validation folds, selection bias; aggregates over long tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.operators import windows as X
from quantweft.operators.windows import UP
from quantweft.sources.shapes import r6


def newey_west(series: DataFrame, value: str, order: str, lag: int, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean, t): mean and its t value with Bartlett-weighted autocovariances up to `lag`; t NULL for n < lag + 2."""
    by = by or []
    w = W.partitionBy(*by)
    rows = series.filter(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(w))
    ahead = w.orderBy(order)
    rows = rows.select("*", *[F.lag("_d", k).over(ahead).alias(f"_l{k}") for k in range(1, lag + 1)])
    parts = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("_g0"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_g{k}") for k in range(1, lag + 1)]]
    out = rows.groupBy(*by).agg(*parts) if by else rows.agg(*parts)
    total = F.col("_g0")
    for k in range(1, lag + 1):
        total = total + F.lit(2.0 * (1 - k / (lag + 1))) * F.coalesce(f"_g{k}", F.lit(0.0))
    se = F.sqrt(F.greatest(total, F.lit(0.0))) / F.col("n")
    return out.select(*by, "n", "mean", F.when(F.col("n") >= lag + 2, F.try_divide(F.col("mean"), se)).alias("t"))


def summarize_periods(periods: DataFrame, horizon: int, value: str = "net") -> DataFrame:
    """One row of statistics of a series of period returns of `horizon` days."""
    x = F.col(value)
    per_year = 252.0 / horizon
    a = periods.filter(x.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("sd"), F.avg((x > 0).cast("double")).alias("hit"), F.sum(x).alias("cum"),
        F.avg("turnover").alias("turnover"), F.avg(F.when(x > 0, x)).alias("avg_win"), F.avg(F.when(x < 0, x)).alias("avg_loss"), F.max(x).alias("best"), F.min(x).alias("worst"),
    )
    year = F.pow(1 + F.col("m"), F.lit(per_year)) - 1
    sharpe = F.when(F.col("sd") > 1e-12, year / (F.col("sd") * math.sqrt(per_year)))
    t = F.when(F.col("sd") > 1e-12, F.col("m") / F.col("sd") * F.sqrt("n"))
    return a.select("n", r6(sharpe).alias("ann_sharpe"), r6(t).alias("t"), r6("hit").alias("hit"), r6("cum").alias("cum"), r6("turnover").alias("turnover"), r6("avg_win").alias("avg_win"), r6("avg_loss").alias("avg_loss"), r6(F.try_divide(F.col("avg_win"), -F.col("avg_loss"))).alias("payoff"), r6("best").alias("best"), r6("worst").alias("worst"))


def drawdown(series: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """(by, max_drawdown, cagr inputs): largest fall of compounded growth below its peak (the start counts as 1)."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(UP, 0)
    rows = series.withColumn("_g", F.sum(F.log1p(F.col(value))).over(w))
    rows = rows.withColumn("_peak", F.greatest(F.max("_g").over(w), F.lit(0.0)))
    return rows.groupBy(*by).agg(r6(F.min(F.exp(F.col("_g") - F.col("_peak")) - 1)).alias("max_drawdown"), r6(F.exp(F.sum(F.log1p(F.col(value)))) - 1).alias("growth"), F.count(F.lit(1)).alias("n"))


def moments(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, sd, skew, kurt): sample deviation, population skewness and (not excess) kurtosis."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))


def expected_max_sharpe(n_trials: int, sd: float) -> float:
    """Expected largest of n independent Sharpe ratios of no skill (Bailey and Lopez de Prado)."""
    if n_trials < 2:
        return 0.0
    z = NormalDist().inv_cdf
    gamma = 0.5772156649015329
    return sd * ((1 - gamma) * z(1 - 1 / n_trials) + gamma * z(1 - 1 / (n_trials * math.e)))


def probabilistic_sharpe(sharpe: float, benchmark: float, n: int, skew: float, kurt: float) -> float:
    """Probability that the true Sharpe ratio exceeds the benchmark."""
    spread = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe
    if n < 2 or spread <= 0:
        return math.nan
    return NormalDist().cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def t_hurdle(n_trials: int, alpha: float = 0.05) -> dict[str, float]:
    """The two-sided t hurdle of one test and, by Bonferroni, of the best of n trials, and their ratio."""
    base = NormalDist().inv_cdf(1 - alpha / 2)
    adjusted = NormalDist().inv_cdf(1 - alpha / (2 * max(int(n_trials), 1)))
    return {"alpha": alpha, "base": base, "adjusted": adjusted, "multiple": adjusted / base}


def deflated_sharpe(rows: DataFrame, value: str, by: list[str], n_trials: int, trial_sd: float) -> DataFrame:
    """(by, n, sharpe, psr, dsr) of per-period returns; the normal distribution runs in an Arrow function over the few groups."""
    benchmark = expected_max_sharpe(n_trials, trial_sd)

    @F.pandas_udf("psr double, dsr double")
    def judged(sharpe: pd.Series, n: pd.Series, skew: pd.Series, kurt: pd.Series) -> pd.DataFrame:
        each = list(zip(sharpe, n, skew, kurt, strict=True))
        return pd.DataFrame({"psr": [probabilistic_sharpe(s, 0.0, int(m), a, k) for s, m, a, k in each], "dsr": [probabilistic_sharpe(s, benchmark, int(m), a, k) for s, m, a, k in each]})

    m = moments(rows, value, by).withColumn("sharpe", F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd")))
    return m.withColumn("j", judged("sharpe", "n", "skew", "kurt")).select(*by, "n", "sharpe", "j.psr", "j.dsr")


def fragility(trades: DataFrame, value: str, key: str, by: list[str], top: int) -> DataFrame:
    """(by, n, total, monster_share, mean_without_top, sum_without_top, median, win_rate, avg_win, avg_loss).

    monster_share: the share of all gains in the `top` largest; a loss is a value of 0 or less.
    """
    x = F.col(value)
    place = F.row_number().over(W.partitionBy(*by).orderBy(x.desc(), key))
    r = trades.filter(x.isNotNull()).withColumn("_p", place)
    rest = F.when(F.col("_p") > top, x)
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(x)).alias("total"), r6(F.try_divide(F.sum(F.when((F.col("_p") <= top) & (x > 0), x).otherwise(0.0)), F.sum(F.when(x > 0, x)))).alias("monster_share"),
        r6(F.avg(rest)).alias("mean_without_top"), r6(F.sum(rest)).alias("sum_without_top"), r6(F.median(x)).alias("median"), r6(F.avg((x > 0).cast("double"))).alias("win_rate"),
        r6(F.avg(F.when(x > 0, x))).alias("avg_win"), r6(F.avg(F.when(x <= 0, x))).alias("avg_loss"),
    )


def loss_streaks(trades: DataFrame, value: str, by: list[str], order: list[str], threshold: float) -> DataFrame:
    """(by, max_streak): most consecutive values at or below the threshold: islands between the others."""
    loss = F.col(value) <= threshold
    island = F.sum((~loss).cast("int")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(UP, 0))
    runs = trades.withColumn("_i", island).filter(loss).groupBy(*by, "_i").agg(F.count(F.lit(1)).alias("run"))
    groups = trades.select(*by).distinct()
    return groups.join(runs.groupBy(*by).agg(F.max("run").alias("max_streak")), by, "left").select(*by, F.coalesce("max_streak", F.lit(0)).alias("max_streak"))


def expected_max_of(values: DataFrame, value: str, m: int) -> DataFrame:
    """(n, expected_max) of the largest of m draws without replacement: order statistics with combinatorial weights.

    The weight C(i, m-1) / C(n, m) of the value above i others is the product of m - 1 ratios, in logarithms.
    """
    r = values.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    # equal values are alike, whichever comes first
    n = r.agg(F.count(F.lit(1)).alias("n"))
    r = X.global_row_number(r, [F.asc("v")], "i").withColumn("i", F.col("i") - 1).crossJoin(F.broadcast(n))  # one row
    return r.withColumn("w", F.when(F.col("i") >= m - 1, F.exp(_weight(m))).otherwise(0.0)).agg(F.max("n").alias("n"), r6(F.sum(F.col("v") * F.col("w"))).alias("expected_max"))


def _weight(m: int) -> Column:
    out = F.log(F.lit(float(m))) - F.log(F.col("n").cast("double"))
    for j in range(1, m):
        out = out + F.log(F.greatest((F.col("i") - (j - 1)).cast("double"), F.lit(1.0))) - F.log((F.col("n") - j).cast("double"))
    return out


def rolling_folds(first: int, last: int, train_years: int, test_years: int) -> list[dict]:
    """Yearly train and test windows; the last test window reaches the end."""
    out, test = [], first + train_years
    while test <= last:
        hi = test + test_years
        end = hi if hi + test_years <= last + 1 else last + 1
        out.append({"fold": len(out), "train_lo": f"{test - train_years}-01-01", "test_lo": f"{test}-01-01", "test_hi": f"{end}-01-01"})
        test = end
    return out


def purge_embargo(trades: DataFrame, folds: DataFrame, entry: str, exit_: str, embargo_days: int) -> DataFrame:
    """trades x folds with in_train and in_test.  A training row goes if it exits in or after the test window's start, or
    enters within the embargo after its end.  Folds are a handful and broadcast."""
    t = trades.crossJoin(F.broadcast(folds))
    d = lambda c: F.col(c).cast("date")
    test = (F.col(entry) >= d("test_lo")) & (F.col(entry) < d("test_hi"))
    train = (F.col(entry) >= d("train_lo")) & (F.col(entry) < d("test_lo")) & (F.col(exit_) < d("test_lo"))
    embargoed = (F.col(entry) >= d("test_hi")) & (F.col(entry) < F.date_add(d("test_hi"), embargo_days))
    return t.withColumn("in_test", test).withColumn("in_train", train & ~embargoed)


def fold_consistency(rows: DataFrame, feature: str, value: str, share: float, least: int) -> DataFrame:
    """(fold, theta, n_train, n_test, test_mean, status): the training quantile of a feature applied to the test window."""
    train = rows.filter("in_train").groupBy("fold").agg(F.percentile(feature, F.lit(1 - share)).alias("theta"), F.count(F.lit(1)).alias("n_train"))
    picked = rows.filter("in_test").join(F.broadcast(train), "fold").filter(F.col(feature) >= F.col("theta"))
    test = picked.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.avg(value).alias("m"))
    out = train.join(test, "fold", "left").withColumn("n_test", F.coalesce("n_test", F.lit(0)))
    status = F.when(F.col("n_train") < least, "train_short").when(F.col("n_test") < least, "sparse").otherwise("ok")
    return out.select("fold", r6("theta").alias("theta"), "n_train", "n_test", r6("m").alias("test_mean"), status.alias("status"))


def performance_metrics(trades: DataFrame, pnl: Column, entry: str, exit_: str, order: list[str], capital: float, by: list[str]) -> DataFrame:
    """Seventeen ledger statistics: returns, annualised; Sharpe and Sortino ratios of the steps of the equity curve (252 a year),
    drawdown, counts, win rate, profit factor (infinite without a loss), means, holding time, extremes.

    Sums are decimal.  Trades without an exit do not count; the equity curve has a point a trade, in the order of `order`.
    """
    closed = trades.filter(F.col(exit_).isNotNull()).withColumn("_p", pnl.cast("decimal(20,4)"))
    w = W.partitionBy(*by).orderBy(*order)
    run = closed.withColumn("_e", F.lit(capital) + F.sum("_p").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("double"))
    run = run.withColumn("_top", F.greatest(F.lit(float(capital)), F.max("_e").over(w.rowsBetween(W.unboundedPreceding, 0)))).withColumn("_d", F.lag("_e").over(w))
    run = run.withColumn("_r", F.when(F.col("_d") > 0, F.col("_e") / F.col("_d") - 1))
    p = F.col("_p")
    win, loss = F.when(p > 0, p), F.when(p < 0, -p)
    hours = (F.unix_timestamp(F.col(exit_).cast("timestamp")) - F.unix_timestamp(F.col(entry).cast("timestamp"))) / 3600
    g = run.groupBy(*by).agg(
        F.sum(p).alias("total"), F.count(F.lit(1)).alias("n"), F.count(win).alias("wins"), F.count(loss).alias("losses"), F.coalesce(F.sum(win), F.lit(0)).alias("won"), F.coalesce(F.sum(loss), F.lit(0)).alias("lost"),
        F.max(1 - F.col("_e") / F.col("_top")).alias("dd"), F.avg(hours).alias("hours"), F.max(p).alias("best"), F.min(p).alias("worst"), F.avg("_r").alias("r"), F.stddev_samp("_r").alias("sd"),
        F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))).alias("down"), F.min(entry).alias("d0"), F.max(exit_).alias("d1"),
    )
    dbl = lambda c: F.col(c).cast("double")
    share = dbl("total") / capital
    years = F.datediff("d1", "d0") / 365.25
    ratio = lambda sd: F.coalesce(F.try_divide(F.col("r") * 252, F.col(sd) * 252**0.5), F.lit(0.0))
    return g.select(
        *by, dbl("total").alias("total_return"), r6(share).alias("total_return_pct"), r6(F.when((years > 0) & (share > -1), F.pow(1 + share, 1 / years) - 1).otherwise(0.0)).alias("annualized_return"),
        r6(ratio("sd")).alias("sharpe_ratio"), r6(ratio("down")).alias("sortino_ratio"), r6(F.col("dd") * capital).alias("max_drawdown"), r6("dd").alias("max_drawdown_pct"), r6(F.col("wins") / F.col("n")).alias("win_rate"),
        r6(F.when(F.col("lost") > 0, dbl("won") / dbl("lost")).otherwise(F.lit(float("inf")))).alias("profit_factor"), F.col("n").alias("total_trades"), F.col("wins").alias("winning_trades"), F.col("losses").alias("losing_trades"),
        r6(F.coalesce(F.try_divide(dbl("won"), F.col("wins")), F.lit(0.0))).alias("avg_win"), r6(F.coalesce(F.try_divide(dbl("lost"), F.col("losses")), F.lit(0.0))).alias("avg_loss"), r6("hours").alias("avg_trade_duration_hours"),
        dbl("best").alias("best_trade"), dbl("worst").alias("worst_trade"),
    )


def monthly_sums(rows: DataFrame, by: list[str], month: str, order: str, value: str) -> DataFrame:
    """(by, month, n, total): sums by month of values in the order of time; months that fall back in that order raise.

    The order is checked on a row a month (its first and last time), not on the values.  NULL values count as 0, rows without
    a month are one group before all others.
    """
    g = rows.groupBy(*by, month).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    before = F.max("_hi").over(W.partitionBy(*by).orderBy(F.asc_nulls_first(month)).rowsBetween(UP, -1))
    checked = F.when(before > F.col("_lo"), F.raise_error(F.lit("months are not in the order of time")).cast("double")).otherwise(F.col("total"))
    return g.withColumn("total", checked).select(*by, month, "n", "total")


def r_distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, expectancy, tail3, payoff): single trades in units of risk; payoff is unknown without both wins and losses."""
    x = F.col(value)
    return rows.groupBy(*by).agg(F.count(x).alias("n"), r6(F.avg(x)).alias("expectancy"), r6(F.avg((x >= 3).cast("double"))).alias("tail3"), r6(F.avg(F.when(x > 0, x)) / -F.avg(F.when(x < 0, x))).alias("payoff"))


def selection_pool(rows: DataFrame, key: str, size: str, least: int) -> DataFrame:
    """Pool statistics of candidate results: n, mean, best, premium of the best over the mean, quartile means by size."""
    ok = rows.filter((F.col(size) >= least) & F.col(key).isNotNull())
    n = ok.agg(F.count(F.lit(1)).alias("_n"))
    placed = X.global_row_number(ok, [F.asc(size), F.asc(key)], "_i").crossJoin(F.broadcast(n))  # one row
    q = F.floor((F.col("_i") - 1) * 4 / F.col("_n"))
    return placed.withColumn("quartile", q.cast("int")).groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(key)).alias("mean"), r6(F.max(key)).alias("best"), r6(F.max(key) - F.avg(key)).alias("premium"), r6(F.stddev_samp(key)).alias("sd"))

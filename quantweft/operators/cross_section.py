"""Cross-sectional back-tests and information coefficients over long panels (code, date, t, close, trade_value, signal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.operators import windows as X
from quantweft.sources.shapes import r6


def _by_code() -> W:
    return W.partitionBy("code").orderBy("t")



def trailing_adv(window: int, value: str = "trade_value") -> Column:
    """Mean of the `window` days before today, unknown days left out; NULL until there are so many days."""
    w = _by_code().rowsBetween(-window, -1)
    return F.when(F.count(F.lit(1)).over(w) == window, F.avg(value).over(w))


def adv(window: int, value: str = "trade_value") -> Column:
    """Mean of the last `window` days with today; NULL unless all are known."""
    w = _by_code().rowsBetween(-(window - 1), 0)
    return F.when(F.count(value).over(w) == window, F.avg(F.abs(F.col(value))).over(w))


def forward_return(horizon: int, delay: int = 1, price: str = "close") -> Column:
    """Return from the close `delay` days ahead over `horizon` days."""
    return F.try_divide(F.lead(price, delay + horizon).over(_by_code()), F.lead(price, delay).over(_by_code())) - 1


def momentum(near: int, far: int, price: str = "close") -> Column:
    return F.ln(F.lag(price, near).over(_by_code())) - F.ln(F.lag(price, far).over(_by_code()))


def eligible(panel: DataFrame, horizon: int, adv_floor: float, adv_window: int, start_index: int, min_names: int, every: int = 1) -> DataFrame:
    """Rows with a signal, a forward return and enough turnover, on dates with enough of them; columns ret, n."""
    last = panel.agg(F.max("t").alias("last"))
    rows = panel.withColumn("ret", forward_return(horizon)).withColumn("_adv", trailing_adv(adv_window))
    rows = rows.crossJoin(F.broadcast(last))  # one row
    rows = rows.filter((F.col("t") >= start_index) & (F.col("t") < F.col("last") - horizon) & ((F.col("t") - start_index) % every == 0))
    ok = F.col("signal").isNotNull() & F.col("ret").isNotNull()
    if adv_floor > 0:
        ok = ok & F.coalesce(F.col("_adv") >= adv_floor, F.lit(False))
    rows = rows.filter(ok).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("t")))
    return rows.filter(F.col("n") >= min_names).drop("_adv", "last")


def rank_ic(panel: DataFrame, horizon: int, adv_floor: float = 0.0, adv_window: int = 20, start_index: int = 130, min_names: int = 20) -> DataFrame:
    """(date, t, n, ic): rank correlation of signal and forward return by date; dates without spread are left out."""
    rows = eligible(panel, horizon, adv_floor, adv_window, start_index, min_names)
    rows = rows.withColumn("ra", X.average_rank("signal", "t")).withColumn("rb", X.average_rank("ret", "t"))
    out = rows.groupBy("date", "t").agg(F.count(F.lit(1)).alias("n"), X.correlation("ra", "rb").alias("ic"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"))
    return out.filter((F.col("sa") > 0) & (F.col("sb") > 0)).select("date", "t", "n", r6("ic").alias("ic"))


def rank_tilt(panel: DataFrame, horizon: int, cost: float = 0.0023, adv_floor: float = 0.0, adv_window: int = 20, min_names: int = 30, start_index: int = 130, long_only: bool = False, top_n: int = 0, borrow: float = 0.0) -> DataFrame:
    """(date, t, gross, turnover, net) of rank-weighted books, rebalanced every `horizon` days, entered a day later."""
    rows = eligible(panel, horizon, adv_floor, adv_window, start_index, min_names, horizon)
    by_t = W.partitionBy("t")
    pct = X.percent_rank("signal", "t")
    if not long_only:
        tilt = F.col("pct") - 0.5
        rows = rows.withColumn("pct", pct).withColumn("w", F.try_divide(tilt, F.sum(F.abs(tilt)).over(by_t)))
    elif top_n:
        place = F.row_number().over(by_t.orderBy(F.desc("signal"), "code"))
        rows = rows.withColumn("w", F.when(place <= top_n, F.lit(1.0) / F.least(F.lit(top_n), F.col("n"))).otherwise(0.0))
    else:
        tilt = F.greatest(F.col("pct") - 0.5, F.lit(0.0))
        rows = rows.withColumn("pct", pct).withColumn("w", F.coalesce(F.try_divide(tilt, F.sum(tilt).over(by_t)), F.lit(0.0)))
    kept = rows.select("t").distinct().withColumn("next_t", F.lead("t").over(W.orderBy("t")))  # one row a rebalance
    now = rows.select("t", "date", "code", "w", "ret")
    # the weights before: those of the rebalance that precedes this one
    before = rows.select("t", "code", F.col("w").alias("w0")).join(F.broadcast(kept), "t").select(F.col("next_t").alias("t"), "code", "w0").filter("t is not null")
    both = now.join(before, ["t", "code"], "full_outer")
    out = both.groupBy("t").agg(
        F.max("date").alias("date"), F.sum(F.col("w") * F.col("ret")).alias("gross"), F.avg("ret").alias("bench"),
        F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))).alias("turnover"), F.sum(F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0)).alias("short"),
    )
    gross = F.col("gross") - F.col("bench") if long_only else F.col("gross")
    carry = F.lit(0.0) if long_only else F.lit(borrow * horizon / 252.0) * F.col("short")
    return out.select("date", "t", r6(gross).alias("gross"), r6("turnover").alias("turnover"), r6(gross - F.col("turnover") * F.lit(cost) - carry).alias("net"))


def staggered_tranches(panel: DataFrame, horizon: int = 60, step: int = 20, top_n: int = 40, adv_floor: float = 0.0, adv_window: int = 20, start_index: int = 130, min_names: int = 20) -> DataFrame:
    """(date, t, gross, turnover, net, book, bench, n_universe) of horizon // step overlapping top-n books.

    A book chosen before the first date does not exist (no wrap-around to the end of the panel).
    """
    tranches = max(1, horizon // step)
    last = panel.agg(F.max("t").alias("last"))
    rows = panel.withColumn("ret", F.try_divide(F.lead("close", step).over(_by_code()), F.col("close")) - 1).withColumn("_adv", trailing_adv(adv_window))
    ok = F.col("signal").isNotNull() & F.coalesce(F.col("_adv") >= adv_floor, F.lit(False))
    rows = rows.withColumn("ok", ok).withColumn("n", F.sum(F.col("ok").cast("int")).over(W.partitionBy("t")))
    rows = rows.filter((F.col("t") - start_index) % step == 0)
    place = F.row_number().over(W.partitionBy("t", "ok").orderBy(F.desc("signal"), "code"))
    books = rows.withColumn("place", place).filter(F.col("ok") & (F.col("n") >= min_names) & (F.col("place") <= top_n)).select("code", F.explode(F.sequence(F.lit(0), F.lit(tranches - 1))).alias("k"), (F.col("t") + F.col("k") * step).alias("t"))
    bench = rows.filter(F.col("ok") & (F.col("n") >= min_names)).crossJoin(F.broadcast(last)).filter((F.col("t") >= start_index) & (F.col("t") < F.col("last") - step))
    bench = bench.groupBy("t", "date").agg(F.avg("ret").alias("bench"), F.max("n").cast("long").alias("n_universe"))
    held = books.join(rows.select("t", "code", "ret"), ["t", "code"]).groupBy("t", "k").agg(F.avg("ret").alias("book"))
    out = held.groupBy("t").agg(F.avg("book").alias("book")).join(bench, "t")
    gross = r6(F.col("book") - F.col("bench"))
    return out.select("date", "t", gross.alias("gross"), F.lit(1.0 / tranches).alias("turnover"), gross.alias("net"), r6("book").alias("book"), r6("bench").alias("bench"), "n_universe")


def signal_turnover(panel: DataFrame, top_q: float) -> DataFrame:
    """(date, t, turnover): 1 - share of the former top names that stay in the top max(1, floor(q n))."""
    known = panel.filter("signal is not null").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("t")))
    place = F.row_number().over(W.partitionBy("t").orderBy(F.desc("signal"), "code"))
    top = known.withColumn("place", place).filter(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * top_q))).select("code", "date", "t")
    kept = top.select("code", "date", "t").join(top.select("code", (F.col("t") + 1).alias("t"), F.lit(1).alias("was")), ["code", "t"], "left")
    sizes = top.groupBy((F.col("t") + 1).alias("t")).agg(F.count(F.lit(1)).alias("size"))
    out = kept.groupBy("t", "date").agg(F.count("was").alias("stay")).join(sizes, "t")
    return out.select("date", "t", r6(1 - F.col("stay") / F.col("size")).alias("turnover"))


def intraday_overnight(bars: DataFrame) -> DataFrame:
    """Adds intraday_bp, overnight_bp, close_to_close_bp; prices that are not positive are unknown."""
    w = W.partitionBy("code").orderBy("date")
    good = lambda c: F.when(F.col(c) > 0, F.col(c))
    rows = bars.withColumn("_o", good("open")).withColumn("_c", good("close")).withColumn("_p", F.lag("_c").over(w))
    bp = lambda a, b: (F.try_divide(F.col(a), F.col(b)) - 1) * 1e4
    return rows.select(*bars.columns, bp("_c", "_o").alias("intraday_bp"), bp("_o", "_p").alias("overnight_bp"), bp("_c", "_p").alias("close_to_close_bp"))


def quantile_summary(rows: DataFrame, quantiles: int) -> DataFrame:
    """(bucket, n, mean, hit) of `ret` by quantile bucket of `signal` over all rows (bucket 1: largest)."""
    known = rows.filter("signal is not null")
    total = known.agg(F.count(F.lit(1)).alias("_n"))
    ranked = X.global_row_number(known, [F.desc("signal"), F.col("code"), F.col("date")], "_rank").crossJoin(F.broadcast(total))  # one row
    bucket = F.greatest(F.lit(1), F.ceil((F.col("_rank") - 1) * F.lit(quantiles) / F.greatest(F.col("_n") - 1, F.lit(1))))
    return ranked.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ret")).alias("mean"), r6(F.avg((F.col("ret") > 0).cast("double"))).alias("hit"))


def cap_tier(panel: DataFrame, cap: str, lo: int, hi: int, ok: Column) -> DataFrame:
    """Adds in_tier: whether an eligible row (ok) with a known capitalisation is among places lo .. hi-1 of its date, largest first
    (ties by code)."""
    has = ok & F.col(cap).isNotNull()
    place = F.row_number().over(W.partitionBy("date", has).orderBy(F.desc(cap), "code")) - 1
    return panel.withColumn("in_tier", F.coalesce(has & (place >= lo) & (place < hi), F.lit(False)))


def capitalisation(panel: DataFrame, shares: str, prices: list[str]) -> Column:
    """Shares times the first known price of the day, else the last known first price of the days before."""
    today = F.coalesce(*prices)
    return F.col(shares) * F.coalesce(today, F.last(today, ignorenulls=True).over(_by_code().rowsBetween(X.UP, -1)))


def earnings_known(earnings: DataFrame, filings: DataFrame, cutoff: str) -> DataFrame:
    """(code, period, known, netinc, netinc_prior): the later of the available date and the first periodic filing, up to the cutoff.
    NaN incomes are unknown; without a filing the available date holds."""
    first = filings.filter("kind = 'periodic'").groupBy("code", "period").agg(F.min("rcept_dt").alias("filed"))
    rows = earnings.join(first, ["code", "period"], "left").withColumn("known", F.greatest("avail_date", "filed")).filter(F.col("known") <= F.lit(cutoff).cast("date"))
    clean = [F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) for c in ("netinc", "netinc_prior")]
    return rows.select("code", "period", "known", *clean)

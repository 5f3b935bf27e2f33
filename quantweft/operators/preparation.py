"""Point-in-time preparation: trailing earnings, session repair, ratio snapping, session arithmetic, styles, risk decomposition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.operators import risk as R
from quantweft.operators import windows as X
from quantweft.sources.shapes import r6


def trailing_year(earnings: DataFrame) -> DataFrame:
    """(code, year, q, ttm) of reports (code, year, q, netinc, netinc_prior): the annual figure in quarter 4; else the annual
    before plus what this year's quarters gained on last year's; with a quarter missing the annual alone; NULL without one.

    One window over the year's quarters and one equality join to the annual of the year before.
    """
    w = W.partitionBy("code", "year").orderBy("q").rowsBetween(X.UP, 0)
    e = earnings.withColumn("_gain", F.sum(F.col("netinc") - F.col("netinc_prior")).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    annual = earnings.filter("q = 4").select("code", (F.col("year") + 1).alias("year"), F.col("netinc").alias("_annual"))
    e = e.join(annual, ["code", "year"], "left")
    ttm = F.when(F.col("q") == 4, F.col("netinc")).when(F.col("_n") == F.col("q"), F.col("_annual") + F.col("_gain")).otherwise(F.col("_annual"))
    return e.select("code", "year", "q", ttm.alias("ttm"))


def repair_sessions(daily: DataFrame, session: DataFrame, since: str) -> DataFrame:
    """Daily bars with prices and volumes of the regular session from a date on; regular_ok: the session is known, or was not needed."""
    s = session.select("code", "date", *[F.col(c).alias(f"_{c}") for c in ("open", "high", "low", "close", "volume")])
    late = F.col("date") >= F.lit(since).cast("date")
    j = daily.join(s, ["code", "date"], "left")
    return j.select("code", "date", *[F.when(late & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")], (~late | F.col("_close").isNotNull()).alias("regular_ok"))


def snap_ratio(ratio: Column, candidates: Column, tolerance: float = 0.002) -> Column:
    """The candidate nearest to the ratio in logarithms, if within the tolerance; else the ratio."""
    off = F.transform(candidates, lambda c: F.struct(F.abs(F.ln(ratio / c)).alias("e"), c.alias("c")))
    best = F.array_min(F.filter(off, lambda x: x["e"].isNotNull()))
    return F.when(best["e"] <= tolerance, best["c"]).otherwise(ratio)


def align_to_sessions(items: DataFrame, column: str, calendar: DataFrame) -> DataFrame:
    """Items on the first session on or after their date (`session`); items beyond the last session are dropped."""
    return X.next_session(items, column, calendar, strict=False).filter("session is not null")


def session_offset(dates: DataFrame, column: str, calendar: DataFrame, n: int, strict: bool = True) -> DataFrame:
    """dates with `offset`: the session n sessions away; a date that is no session raises, or gives NULL if not strict."""
    cal = F.broadcast(calendar.select(F.col("date").alias("_d"), "idx"))  # a row a session
    to = F.broadcast(calendar.select((F.col("idx") - n).alias("idx"), F.col("date").alias("offset")))
    out = dates.join(cal, F.col(column) == F.col("_d"), "left").join(to, "idx", "left")
    if strict:
        out = out.withColumn("offset", F.when(F.col("idx").isNull(), F.raise_error(F.lit("not a session"))).otherwise(F.col("offset")))
    return out.drop("_d", "idx")


def resolve_exits(trades: DataFrame, max_hold: int | None = None) -> DataFrame:
    """exit_date: the given one, or entry + max_hold calendar days, or entry."""
    late = F.date_add("entry_date", max_hold) if max_hold is not None else F.col("entry_date")
    return trades.withColumn("exit_date", F.coalesce("exit_date", late))


def sweep_vwap(levels: Column, notional: float) -> Column:
    """Average price of walking (px, qty) levels until the notional is spent; NULL if the book is too thin."""
    zero = F.struct(F.lit(float(notional)).alias("rest"), F.lit(0.0).alias("shares"))

    def step(acc: Column, x: Column) -> Column:
        spent = F.least(acc["rest"], x["px"] * x["qty"])
        return F.struct((acc["rest"] - spent).alias("rest"), (acc["shares"] + spent / x["px"]).alias("shares"))

    return F.aggregate(levels, zero, step, lambda acc: F.when(acc["rest"] <= 1e-9, F.lit(float(notional)) / acc["shares"]))


def style_panels(panel: DataFrame, cap: Column) -> DataFrame:
    """(code, date, t, size, momentum, liquidity): logarithm of capitalisation, return without the last step, turnover against capitalisation."""
    w = W.partitionBy("code").orderBy("t")
    mean = F.avg("trade_value").over(w.rowsBetween(-11, 0))
    known = F.count("trade_value").over(w.rowsBetween(-11, 0))
    momentum = F.ln(F.lag("close", 1).over(w)) - F.ln(F.lag("close", 13).over(w))
    return panel.select("code", "date", "t", F.when(cap > 0, F.ln(cap)).alias("size"), momentum.alias("momentum"), F.when((known >= 6) & (cap > 0), F.ln(mean / cap)).alias("liquidity"))


def risk_styles(panel: DataFrame, beta_window: int = 252, half_life: float = 63, least: int = 126, resid_window: int = 63, far: int = 252, near: int = 21, liquidity: tuple = ((21, 0.35), (63, 0.35), (252, 0.30)), turns: float = 21.0) -> DataFrame:
    """(code, t, size, beta, momentum, resid_vol, liquidity, value): raw styles of every row with what was known at its close.

    panel: a row for every code and t = 0, 1, 2 ... with close, cap, trade_value, ttm (net income of the last four quarters), m (the market's
    return).  liquidity: (sessions, weight) of logarithms of mean turnover, each with half of its window known.
    """
    w = W.partitionBy("code").orderBy("t")
    p = panel.withColumn("_close", F.when(F.col("close") > 0, F.col("close"))).withColumn("_cap", F.when(F.col("cap") > 0, F.col("cap")))
    p = p.withColumn("r", F.col("_close") / F.lag("_close").over(w) - 1).withColumn("_turn", F.col("trade_value") / F.col("_cap"))
    momentum = F.ln(F.lag("_close", near).over(w)) - F.ln(F.lag("_close", far).over(w))
    p = p.withColumn("momentum", momentum)
    level = F.lit(0.0)
    for sessions, weight in liquidity:
        p = X.trailing_weighted_sums(p, {f"_s{sessions}": F.col("_turn"), f"_n{sessions}": F.when(F.col("_turn").isNotNull(), 1.0)}, ["code"], "t", sessions)
        mean = F.col(f"_s{sessions}") / F.col(f"_n{sessions}")
        level = level + weight * F.when((F.col(f"_n{sessions}") >= sessions // 2) & (mean > 0), F.ln(turns * mean))
    p = p.withColumn("liquidity", level)
    own = p.select("code", "t", "r", "m", F.ln("_cap").alias("size"), "momentum", "liquidity", (F.col("ttm") / F.col("_cap")).alias("value"))
    both = R.with_rolling_beta(own, beta_window, half_life, least, resid_window)
    return both.select("code", "t", "size", "beta", "momentum", F.col("resid_sd").alias("resid_vol"), "liquidity", "value")


def factor_returns(exposures: DataFrame, returns: DataFrame) -> DataFrame:
    """returns (code, t, r) joined to exposures of the session before: what a regression of session t may know."""
    return returns.join(exposures.withColumn("t", F.col("t") + 1), ["code", "t"])


def decompose(weights: DataFrame, exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> DataFrame:
    """(date, factor_var, specific_var, total_var) of weights (date, code, w): y'Fy with y = X'w, plus the sum of w^2 d."""
    y = weights.join(exposures, ["date", "code"]).groupBy("date", "k").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
    f = F.broadcast(factor_cov)  # K x K rows
    yy = y.select("date", F.col("k").alias("a"), F.col("y").alias("ya")).join(f, "a").join(y.select("date", F.col("k").alias("b"), F.col("y").alias("yb")), ["date", "b"])
    factor = yy.groupBy("date").agg(F.sum(F.col("ya") * F.col("cov") * F.col("yb")).alias("fv"))
    own = weights.join(specific, "code").groupBy("date").agg(F.sum(F.col("w") * F.col("w") * F.col("var")).alias("sv"))
    return factor.join(own, "date").select("date", r6("fv").alias("factor_var"), r6("sv").alias("specific_var"), r6(F.col("fv") + F.col("sv")).alias("total_var"))


def walk_forward(rows: DataFrame, folds: list[dict], date: str, fit: Callable[[DataFrame], dict], apply: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
    """fit on each fold's training rows, apply to its test rows; all test results with their fold."""
    out = None
    for f in folds:
        train = rows.filter((F.col(date) >= f["train_lo"]) & (F.col(date) < f["test_lo"]))
        test = rows.filter((F.col(date) >= f["test_lo"]) & (F.col(date) < f["test_hi"]))
        one = apply(test, fit(train)).withColumn("fold", F.lit(f["fold"]))
        out = one if out is None else out.unionByName(one)
    return out

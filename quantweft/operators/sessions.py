"""Regular sessions in data that later trading and later corporate actions have changed: scales, restored closes, base prices.

All dates at once.  Tables are joined by (code, date), so they share one partitioning; corporate actions are an array a code with at
most one entry a date, sent once to the rows of that code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.functions import market as M
from quantweft.operators import windows as X

#: Largest distance of a ratio from a scale, in logarithms; grids of prices behind a change, in the order of trial, and how
#: many basis points they may miss it by.
SCALE_TOLERANCE = 0.002
CHANGE_GRIDS, CHANGE_TOLERANCE = (1000.0, 500.0, 100.0, 50.0, 10.0, 5.0, 1.0), 0.5001
#: Where a base price may come from; the first that has one wins.
BASE_SOURCES = ("identity", "session", "changes", "raw", "daily")
PRICES = ("open", "high", "low", "close")


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once: rules below name their price many times, and nested ones would multiply."""
    return F.transform(F.array(value), use)[0]


def _tick(price: Column, fund: Column | bool) -> Column:
    if isinstance(fund, Column):
        return F.when(fund, M.tick_size(price, fund=True)).otherwise(M.tick_size(price))
    return M.tick_size(price, fund)


def nearest_tick(price: Column, fund: Column | bool = False) -> Column:
    """The multiple of the price's own tick nearest to it, half to even; NULL for prices that are not positive."""
    return _bound(price, lambda p: _bound(_tick(p, fund), lambda tick: F.rint(p / tick) * tick))


def base_of_change(close: Column, change_bp: Column) -> Column:
    """The price that a close (its sign is ignored) and its change in rounded basis points start from: on the coarsest grid that
    gives the change back; NULL where none does or the close is 0."""
    close = F.abs(close.cast("double"))
    grids = F.transform(F.array(*map(F.lit, CHANGE_GRIDS)), lambda g: F.rint(close / (1 + change_bp / 1e4) / g) * g)
    fits = lambda v: (close > 0) & (v > 0) & (F.abs((F.try_divide(close, v) - 1) * 1e4 - change_bp) <= CHANGE_TOLERANCE)
    return F.get(F.filter(grids, fits), F.lit(0))


def actions_by_code(actions: DataFrame) -> DataFrame:
    """(code, events): the actions of a code as an array of (date, factor) by date; factors of one date are multiplied, those of 1 or
    NULL left out."""
    daily = actions.filter("factor <> 1").groupBy("code", "date").agg(F.product("factor").alias("factor"))
    return daily.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("date", "factor"))).alias("events"))


def _factors(events: Column, keep) -> Column:
    return F.transform(F.filter(F.coalesce(events, F.array().cast("array<struct<date:date,factor:double>>")), keep), lambda e: e["factor"])


def action_factor(events: Column, after: Column, until: Column | None = None) -> Column:
    """Product of the factors later than `after`, up to and with `until`; 1 without any."""
    inside = lambda e: (e["date"] > after) if until is None else (e["date"] > after) & (e["date"] <= until)
    return F.aggregate(_factors(events, inside), F.lit(1.0), lambda done, f: done * f)


def retro_scale(ratio: Column, date: Column, events: Column) -> Column:
    """The scale behind an observed ratio: 1, or the product of the first few factors later than the date (nobody knows when the
    source was read again); the nearest in logarithms, if it is within SCALE_TOLERANCE, else NULL."""
    log = F.when(ratio > 0, F.ln(ratio))
    state = lambda scale, error, best: F.struct(scale.alias("scale"), error.alias("error"), best.alias("best"))

    def step(s: Column, f: Column) -> Column:
        scale = s["scale"] * f
        error = F.abs(log - F.ln(scale))
        return state(scale, F.least(s["error"], error), F.when(error < s["error"], scale).otherwise(s["best"]))

    found = F.aggregate(_factors(events, lambda e: e["date"] > date), state(F.lit(1.0), F.abs(log), F.lit(1.0)), step)
    return _bound(found, lambda s: F.when(s["error"] <= SCALE_TOLERANCE, s["best"]))


def unscale(value: Column, scale: Column, fund: Column | bool = False) -> Column:
    """The price on the tick grid that, scaled and rounded, gave the value, if its neighbours would not give it as well; else NULL."""

    def only(scale: Column) -> Column:
        fits = lambda p: F.abs(p * scale - value) <= 0.5 + 1e-4 * F.abs(value) + 1e-9
        alone = lambda p, tick: F.when(fits(p) & ~fits(p - tick) & ~fits(p + tick), p)
        price = _bound(nearest_tick(value / scale, fund), lambda p: _bound(_tick(p, fund), lambda tick: alone(p, tick)))
        return F.when(scale == 1, value).otherwise(price)

    return _bound(scale, only)


def previous_sessions(days: DataFrame, **tables: DataFrame) -> DataFrame:
    """(date, prev, missing) for each of the days: the last date before it in any of the tables, and the names of those that lack
    it (a load that failed).  NULL before the first date.

    Only distinct dates meet: a row a date and table, in one ordered task.
    """
    seen = reduce(DataFrame.unionByName, [t.select("date").distinct().withColumn("table", F.lit(name)) for name, t in tables.items()])
    seen = seen.groupBy("date").agg(F.collect_set("table").alias("have")).withColumn("seen", F.struct(F.col("date").alias("prev"), "have"))
    asked = days.select("date").distinct().withColumn("asked", F.lit(True))
    line = asked.join(seen, "date", "full").withColumn("last", F.last("seen", ignorenulls=True).over(W.orderBy("date").rowsBetween(X.UP, -1)))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(name) for name in tables]), F.col("last.have")))
    return line.filter("asked").select("date", F.col("last.prev").alias("prev"), missing.alias("missing"))


def _profiles(actions: DataFrame, equity: DataFrame) -> DataFrame:
    """(code, events, share): a row for each code that has actions or is a share."""
    return actions_by_code(actions).join(equity.select("code").distinct().withColumn("share", F.lit(True)), "code", "full")


def regular_bars(daily: DataFrame, session: DataFrame, raw: DataFrame, changes: DataFrame, actions: DataFrame, equity: DataFrame, since: str, whole: bool) -> DataFrame:
    """Daily bars (code, date, prices, volume, trade_value) with the regular session's high, low, close, volume and value from a date on,
    for the codes in `equity`; regular_ok: all of them are known (or were not needed), close_ok: the close is.

    session: bars of the regular session; raw: opens as traded; changes: closes and their changes in basis points from the base price;
    actions: factors that make prices before their date comparable with those after; whole: prices of scaled rows are whole numbers.

    The scale of a daily bar is its open over the raw one.  A session whose open is not the raw one (scaled since, or its first bar
    is missing) or whose close is off the tick grid is not used; such rows get the close that the next session's change starts from,
    times close over the same day's close in `changes`, unless an action falls on the next session or the step exceeds the
    daily limit both ways.  Rows that find nothing stay as they are, both flags false.  A code and date has one row in each table.
    """
    named = lambda df, prefix, columns: df.select("code", "date", *[F.col(c).cast("double").alias(f"_{prefix}_{c}") for c in columns])
    line = W.orderBy("date")
    sessions = changes.select("date").distinct().withColumn("_date", F.lag("date").over(line))  # a row a session
    after = changes.join(F.broadcast(sessions), "date").filter("_date is not null").select("code", F.col("_date").alias("date"), F.col("date").alias("_next"), base_of_change(F.col("close"), F.col("change_bp")).alias("_base"))
    j = daily.join(named(session, "s", [*PRICES, "volume", "trade_value"]), ["code", "date"], "left").join(named(raw, "r", ["open"]), ["code", "date"], "left")
    j = j.join(named(changes.filter("close is not null and change_bp is not null"), "c", ["close"]), ["code", "date"], "left").join(after, ["code", "date"], "left")
    j = j.join(_profiles(actions, equity), "code", "left")
    late = (F.col("date") >= F.lit(since).cast("date")) & F.coalesce("share", F.lit(False))
    opened = F.abs(F.col("_r_open"))
    scale = F.when((F.abs("open") > 0) & (opened > 0), F.abs("open") / opened)
    j = j.withColumn("_scale", scale).withColumn("_retro", retro_scale(F.try_divide("_s_open", opened), F.col("date"), F.col("events")))
    hit = F.coalesce((F.col("_retro") == 1) & (F.col("_s_close") == nearest_tick(F.col("_s_close"))) & F.col("_scale").isNotNull(), F.lit(False))
    restored = F.col("_base") * F.try_divide(F.abs("close"), F.abs("_c_close"))
    step, limit = F.try_divide(restored, F.abs("close")), M.LIMIT_RATE
    reset = F.exists(F.coalesce("events", F.array().cast("array<struct<date:date,factor:double>>")), lambda e: e["date"] == F.col("_next"))
    restored = F.when((restored > 0) & step.between((1 - limit) / (1 + limit), (1 + limit) / (1 - limit)) & ~reset, F.rint(restored) if whole else restored)
    j = j.withColumn("_late", late).withColumn("_hit", hit).withColumn("_restored", restored)
    tidy = lambda c: F.when(F.col("_scale") != 1, F.rint(c)).otherwise(c) if whole else c
    value = {c: tidy(F.col(f"_s_{c}") * F.col("_scale")) for c in ("high", "low", "close")}
    value |= {"volume": tidy(F.col("_s_volume") / F.col("_scale")), "trade_value": F.col("_s_trade_value")}
    old = {c: F.col(c).cast("double") for c in value} | {"close": F.when(F.col("_late"), F.coalesce("_restored", "close")).otherwise(F.col("close"))}
    new = [F.when(F.col("_late") & F.col("_hit"), v).otherwise(old[c]).alias(c) for c, v in value.items()]
    flags = [(~F.col("_late") | F.col("_hit")).alias("regular_ok"), (~F.col("_late") | F.col("_hit") | F.col("_restored").isNotNull()).alias("close_ok")]
    return j.select("code", "date", F.col("open").cast("double").alias("open"), *new, *flags)


def base_prices(days: DataFrame, daily: DataFrame, session: DataFrame, raw: DataFrame, changes: DataFrame, actions: DataFrame, equity: DataFrame, since: str, reform: str, closing_sec: int = 15 * 3600 + 30 * 60, sources: tuple[str, ...] = BASE_SOURCES) -> DataFrame:
    """(code, date, base, source, prev, adj): the price that the limits of a date start from, for each of the days and each code with one.

    Sources in their order: what the day's own change starts from; the close of the previous session's bars if its last bar (last_sec) is
    the closing auction, brought back by its open over the raw one (retro_scale, unscale) and on the tick grid; the previous close in
    `changes`, `raw`, `daily`, which from the date `since` on hold later trading and serve only codes outside `equity`.
    Actions after the previous session up to the day multiply a previous close (adj), to the nearest tick; not before `reform`, when other ticks
    were in force, and not for `daily`, which may hold them already: such rows have no base.

    Each source is a narrow table joined by date with the few sessions; one union, one join by code, one aggregation keeps the first.
    """
    if unknown := set(sources) - set(BASE_SOURCES):
        raise ValueError(f"unknown sources {sorted(unknown)}")
    prev = previous_sessions(days, daily=daily, changes=changes, session=session).drop("missing")
    ahead = F.broadcast(prev.filter("prev is not null").select(F.col("date").alias("_day"), F.col("prev").alias("_prev")))  # a row a session
    nothing = F.lit(None).cast("double")
    part = lambda df, name, price, ratio=nothing: df.select("code", "_day", "_prev", F.lit(BASE_SOURCES.index(name)).alias("_at"), price.cast("double").alias("_price"), ratio.alias("_ratio"))
    before = lambda df: df.join(ahead, df.date == F.col("_prev"))
    own = changes.join(F.broadcast(prev.withColumnRenamed("prev", "_prev")), "date").withColumn("_day", F.col("date"))
    closing = before(session.filter(F.col("last_sec") >= closing_sec)).join(raw.select("code", "date", F.abs("open").alias("_open")), ["code", "date"], "left")
    parts = {"identity": part(own, "identity", base_of_change(F.col("close"), F.col("change_bp"))), "session": part(closing, "session", F.col("close"), F.coalesce(F.try_divide(F.col("open").cast("double"), F.col("_open")), F.lit(0.0)))}
    parts |= {name: part(before(df), name, F.abs("close")) for name, df in (("changes", changes), ("raw", raw), ("daily", daily))}
    rows = reduce(DataFrame.unionByName, [parts[name] for name in BASE_SOURCES if name in sources]).join(_profiles(actions, equity), "code", "left")
    is_ = lambda *names: F.col("_at").isin(*[BASE_SOURCES.index(n) for n in names])
    day = lambda text: F.lit(text).cast("date")
    fund = ~F.coalesce("share", F.lit(False))
    rows = rows.withColumn("_fund", fund).filter(is_("identity", "session") | F.col("_fund") | (F.col("_prev") < day(since)))
    closed = unscale(F.col("_price"), retro_scale(F.col("_ratio"), F.col("_prev"), F.col("events")), F.col("_fund"))
    rows = rows.withColumn("_base", F.when(is_("session"), closed).otherwise(F.col("_price")))
    rows = rows.filter(~is_("session") | (F.col("_prev") < day(reform)) | (F.col("_base") == nearest_tick(F.col("_base"), F.col("_fund"))))
    rows = rows.withColumn("adj", F.when(is_("identity"), F.lit(1.0)).otherwise(action_factor(F.col("events"), F.col("_prev"), F.col("_day"))))
    moved = F.when((F.col("_day") >= day(reform)) & ~is_("daily"), nearest_tick(F.col("_base") * F.col("adj"), F.col("_fund")))
    rows = rows.withColumn("_base", F.when(F.col("adj") == 1, F.col("_base")).otherwise(moved)).filter("_base > 0")
    first = rows.groupBy("code", F.col("_day").alias("date")).agg(F.min(F.struct("_at", "_base", "_prev", "adj")).alias("f"))
    return first.select("code", "date", F.col("f._base").alias("base"), F.array(*[F.lit(s) for s in BASE_SOURCES])[F.col("f._at")].alias("source"), F.col("f._prev").alias("prev"), F.col("f.adj").alias("adj"))

"""Session repair and base prices on cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantweft.operators import sessions as O

MON, TUE, THU, FRI = (dt.date(2031, 3, d) for d in (3, 4, 6, 7))  # Wednesday is no session
OLD, OLDER = dt.date(2030, 6, 4), dt.date(2030, 6, 3)
SINCE, REFORM = "2031-01-01", "2030-01-01"
BAR = "code string, date date, open double, high double, low double, close double, volume double, trade_value double"


@pytest.fixture(scope="module")
def tables(spark):
    def bar(code, date, o, h, l, c, v=100.0):
        return code, date, float(o), float(h), float(l), float(c), v, c * v / 1e6

    daily = [
        bar("plain", OLD, 70000, 71000, 69000, 70500), bar("plain", TUE, 41000, 42500, 40500, 42000), bar("blank", TUE, 31000, 33000, 30900, 32500), bar("blank", THU, 32000, 33500, 31900, 33000),
        bar("retro", TUE, 3000, 3100, 2990, 3060), bar("gap", TUE, 8000, 8100, 7900, 8020), bar("scaled", TUE, 1984600 * 0.5, 2000000 * 0.5, 1960000 * 0.5, 1990000 * 0.5), bar("fund", TUE, 10500, 10600, 10400, 10455),
        bar("merged", TUE, 1000, 1000, 1000, 1000), bar("reset", TUE, 6000, 6000, 6000, 6000), bar("twin", TUE, 1500, 1500, 1500, 1500),
    ]
    session = [
        (*bar("plain", TUE, 41000, 42000, 40800, 41500), 55860), (*bar("retro", TUE, 2400, 2460, 2392, 2436), 55800), (*bar("gap", TUE, 7850, 8050, 7840, 8010), 55800),
        (*bar("scaled", TUE, 1984600, 1996000, 1970000, 1980000), 55800), (*bar("early", TUE, 5000, 5050, 4990, 5020), 55100), (*bar("reset", TUE, 6000, 6000, 6000, 6000), 55800), (*bar("twin", TUE, 750, 750, 750, 753), 55800),
    ]
    raw = [(c, TUE, float(o), float(o)) for c, o in (("plain", 41000), ("retro", 3000), ("gap", 8000), ("scaled", 1984600), ("early", 5000), ("fund", 10455), ("reset", 6000), ("twin", 1500))]
    changes = [
        ("plain", OLDER, 70000, 0), ("plain", OLD, 70500, 71), ("blank", TUE, 32500, 0), ("blank", THU, 33000, 280), ("retro", TUE, 3060, 0), ("retro", THU, 3100, 164), ("gap", TUE, 8020, 0), ("gap", THU, -8000, -12),
        ("merged", TUE, 1000, 0), ("merged", THU, 9000, 0), ("reset", TUE, 6000, 0),
    ]
    actions = [("retro", FRI, 0.8), ("scaled", FRI, 0.5), ("reset", THU, 0.9), ("twin", FRI, 0.5), ("gap", FRI, None), ("gap", FRI, 1.0)]
    equity = [(c,) for c in ("plain", "blank", "retro", "gap", "scaled", "early", "merged", "reset", "twin", "plain")]
    make = spark.createDataFrame
    return {
        "daily": make(daily, BAR), "session": make(session, BAR + ", last_sec int"), "raw": make(raw, "code string, date date, open double, close double"),
        "changes": make(changes, "code string, date date, close long, change_bp long"), "actions": make(actions, "code string, date date, factor double"), "equity": make(equity, "code string"),
    }


def repaired(tables, **other):
    t = tables | other
    return {(r.code, r.date): r for r in O.regular_bars(t["daily"], t["session"], t["raw"], t["changes"], t["actions"], t["equity"], SINCE, whole=True).collect()}


def test_regular_bars(tables):
    rows = repaired(tables)
    assert len(rows) == tables["daily"].count()
    r = rows["plain", OLD]
    assert (r.close, r.high, r.regular_ok, r.close_ok) == (70500, 71000, True, True)
    r = rows["plain", TUE]
    assert (r.open, r.high, r.low, r.close, r.regular_ok) == (41000, 42000, 40800, 41500, True)
    # no session: the close that the next day's change starts from, over a day without a session
    r = rows["blank", TUE]
    assert (r.close, r.high, r.regular_ok, r.close_ok) == (32100, 33000, False, True)
    r = rows["blank", THU]
    assert (r.close, r.regular_ok, r.close_ok) == (33000, False, False)
    # a session that a later action has scaled, and one without its first bar
    assert (rows["retro", TUE].close, rows["retro", TUE].high, rows["retro", TUE].regular_ok) == (3050, 3100, False)
    assert (rows["gap", TUE].close, rows["gap", TUE].regular_ok, rows["gap", TUE].close_ok) == (8010, False, True)
    # a scaled daily bar: whole numbers, the volume the other way
    r = rows["scaled", TUE]
    assert (r.high, r.close, r.volume, r.regular_ok) == (998000, 990000, 200, True)
    # not subject to later trading; a step beyond the daily limit
    assert rows["fund", TUE].close == 10455 and rows["fund", TUE].regular_ok
    assert (rows["merged", TUE].close, rows["merged", TUE].close_ok) == (1000, False)


def test_action_on_the_next_session_forbids_restoring(tables, spark):
    more = tables["changes"].unionByName(spark.createDataFrame([("reset", THU, 6000, 0)], "code string, date date, close long, change_bp long"))
    none = tables["session"].filter("code <> 'reset'")
    assert not repaired(tables, changes=more, session=none)["reset", TUE].close_ok
    assert repaired(tables, changes=more, session=none, actions=tables["actions"].filter("code <> 'reset'"))["reset", TUE].close_ok


def prices(tables, day, **other):
    t = tables | other
    days = t["daily"].sparkSession.createDataFrame([(day,)], "date date")
    keys = {k: other[k] for k in ("sources", "reform") if k in other}
    out = O.base_prices(days, t["daily"], t["session"], t["raw"], t["changes"], t["actions"], t["equity"], SINCE, keys.pop("reform", REFORM), **keys)
    return {r.code: r for r in out.collect()}


def test_base_prices(tables):
    rows = prices(tables, THU)
    assert {r.prev for r in rows.values()} == {TUE}
    assert (rows["blank"].base, rows["blank"].source) == (32100, "identity")
    assert (rows["plain"].base, rows["plain"].source) == (41500, "session")
    assert (rows["fund"].base, rows["fund"].source) == (10455, "raw")
    assert "early" not in rows  # its last bar is no auction
    # an action on the day: the close times the factor
    assert (rows["reset"].base, rows["reset"].source, rows["reset"].adj) == (5400, "session", 0.9)
    assert "reset" not in prices(tables, THU, reform="2032-01-01")


def test_base_prices_before_the_day_has_changes(tables):
    rows = prices(tables, THU, sources=O.BASE_SOURCES[1:])
    assert rows["retro"].base == 3045  # 2436 / 0.8, its neighbours give other values
    assert "gap" not in rows and "blank" not in rows
    assert "twin" not in rows  # 1505 and 1507 give 753 as well, within the slack of the factor
    off = tables["session"].withColumn("close", F.when(F.col("code") == "plain", 41520.0).otherwise(F.col("close")))
    assert "plain" not in prices(tables, THU, sources=O.BASE_SOURCES[1:], session=off)
    with pytest.raises(ValueError):
        prices(tables, THU, sources=("nobody",))


def test_base_prices_before_later_trading(tables):
    rows = prices(tables, OLD)
    assert (rows["plain"].base, rows["plain"].source) == (70000, "identity")
    rows = prices(tables, OLD, sources=("changes",))
    assert (rows["plain"].base, rows["plain"].source) == (70000, "changes")


def test_previous_session_of_a_table_that_failed(tables, spark):
    days = spark.createDataFrame([(THU,), (OLDER,), (THU,)], "date date")
    t = tables
    rows = {r.date: r for r in O.previous_sessions(days, daily=t["daily"].filter(F.col("date") != F.lit(TUE)), changes=t["changes"], session=t["session"]).collect()}
    assert (rows[THU].prev, rows[THU].missing) == (TUE, ["daily"])
    assert rows[OLDER].prev is None and len(rows) == 2


def test_scales(spark):
    events = F.array(*[F.struct(F.lit(d).alias("date"), F.lit(f).alias("factor")) for d, f in ((TUE, 0.9), (THU, 0.5), (FRI, 1.1))])
    ratios = {"none": 1.001, "one": 0.5, "two": 0.5 * 1.1, "own": 0.9, "odd": 0.7, "bad": -1.0, "zero": 0.0}
    got = spark.range(1).select(*[O.retro_scale(F.lit(v), F.lit(TUE), events).alias(k) for k, v in ratios.items()], O.retro_scale(F.lit(None).cast("double"), F.lit(TUE), events).alias("null"), O.retro_scale(F.lit(1.0), F.lit(TUE), F.lit(None).cast("array<struct<date:date,factor:double>>")).alias("free")).first()
    assert (got.none, got.one, got.free) == (1.0, 0.5, 1.0)
    assert got.two == pytest.approx(0.55)
    assert got.own is None and got.odd is None and got.bad is None and got.zero is None and got.null is None


def test_base_of_change_round_trip(spark):
    rows = [(p, int(p * (1 + m / 1000))) for p in (1200, 2500, 8800, 29050, 119900, 254500) for m in (-280, -33, 0, 41, 290)]
    df = spark.createDataFrame(rows, "base long, close long").withColumn("bp", F.floor((F.col("close") / F.col("base") - 1) * 1e4 + 0.5))
    assert not df.filter(~F.coalesce(O.base_of_change(F.col("close"), F.col("bp")) == F.col("base"), F.lit(False))).count()
    got = spark.range(1).select(O.base_of_change(F.lit(0), F.lit(5)).alias("a"), O.base_of_change(F.lit(None).cast("double"), F.lit(5)).alias("b")).first()
    assert got.a is None and got.b is None


def test_empty_tables(tables):
    empty = {k: v.limit(0) for k, v in tables.items()}
    assert not repaired(empty) and not prices(empty, THU)
    kept = repaired(tables | {k: empty[k] for k in ("session", "raw", "changes", "actions")})
    assert len(kept) == tables["daily"].count() and not kept["plain", TUE].close_ok and kept["plain", OLD].close_ok

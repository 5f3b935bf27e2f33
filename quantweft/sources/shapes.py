"""Market-shaped views of the star-schema tables: weekly bars, ticks, trades, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to six digits in the one way that does not depend on the engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def rollup_bars(lineitem: DataFrame, unit: str = "week") -> DataFrame:
    """bars(code, date, open, high, low, close, volume, trade_value): one aggregation, first and last by ordered structs."""
    day = F.date_trunc(unit, "l_shipdate").cast("date")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return lineitem.groupBy(F.col("l_suppkey").alias("code"), day.alias("date")).agg(
        F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, order).alias("close"),
        r6(F.sum("l_quantity")).alias("volume"), r6(F.sum("l_extendedprice")).alias("trade_value"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_bars(table(spark, sf_dir, "lineitem"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticks(code, day, sec, seq, price, side)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 10).cast("int").alias("code"), F.col("ts").cast("date").alias("day"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("int").alias("sec"),
        F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.when(F.col("event_type").isin("purchase", "click"), 1).when(F.col("event_type") == "error", -1).otherwise(0).alias("side"),
    )


def _lob_events(e: DataFrame, *more: str) -> DataFrame:
    return e.select(
        *more,
        (F.col("user_id") % 10).cast("int").alias("code"), F.col("ts").cast("date").alias("day"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("int").alias("sec"),
        F.col("event_id").alias("seq"), (F.floor(F.col("value") * 100).cast("int") + 1).alias("px"), F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"), "event_type",
    )


def lob_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with quantity, strength and the best quotes they saw: purchases, clicks (buys) and errors (sells)."""
    return ticks_of(table(spark, sf_dir, "events"))


def ticks_of(events: DataFrame, *more: str) -> DataFrame:
    """The same of any table or stream of events, with more of its columns."""
    e = _lob_events(events, *more).filter("event_type in ('purchase', 'click', 'error')")
    return e.select(
        *more, "code", "day", "sec", "seq", F.col("px").alias("price"), F.col("k").alias("volume"), F.when(F.col("k") % 9 == 0, 0).when(F.col("event_type") == "error", -1).otherwise(1).alias("side"),
        F.when(F.col("k") % 10 != 0, F.col("k") * 1.5).alias("strength"), (F.col("px") - 5).alias("best_bid"), (F.col("px") + 5).alias("best_ask"),
    )


def lob_quotes(spark: SparkSession, sf_dir: str, levels: int = 3) -> DataFrame:
    """Book snapshots of several levels from all other events; some have no bid, some a level without a quantity."""
    return quotes_of(table(spark, sf_dir, "events"), levels)


def quotes_of(events: DataFrame, levels: int = 3, *more: str) -> DataFrame:
    """The same of any table or stream of events, with more of its columns."""
    e = _lob_events(events, *more).filter("event_type not in ('purchase', 'click', 'error')")
    out = e.select(*more, "code", "day", "sec", "seq")
    ask = F.col("px") + 5 * (1 + F.col("k") % 3)
    columns = []
    for n in range(levels):
        columns += [F.when(F.col("k") % 13 == 0, 0).otherwise(F.col("px") - 5 * n).alias(f"bid{n + 1}"), F.when(F.lit(n == 1) & (F.col("k") % 17 == 0), None).otherwise((F.col("k") + 3 * n) % 50 + 1).alias(f"bidqty{n + 1}")]
        columns += [(ask + 5 * n).alias(f"ask{n + 1}"), ((F.col("k") * 2 + n) % 50 + 1).alias(f"askqty{n + 1}")]
    return e.select(*out.columns, *columns)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trades(trade_id, entry_date, code, stratum, r): orders as closed trades, r their standardised size."""
    o = table(spark, sf_dir, "orders")
    stat = o.agg(F.avg("o_totalprice").alias("mu"), F.stddev_pop("o_totalprice").alias("sd"))
    return o.crossJoin(F.broadcast(stat)).select(  # one row of moments
        F.col("o_orderkey").alias("trade_id"), F.col("o_orderdate").cast("date").alias("entry_date"), (F.col("o_custkey") % 50).cast("int").alias("code"),
        F.col("o_orderpriority").alias("stratum"), r6((F.col("o_totalprice") - F.col("mu")) / F.col("sd")).alias("r"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calendar(date, idx): the observed sessions."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return days.withColumn("idx", F.row_number().over(W.orderBy("date")) - 1)  # one row a session: small by nature


#: The same shapes in SQL, for the statements that the queries are held against.
BARS_SQL = """bars as (select code, date,
  max(case when rn = 1 then px end) as open, max(px) as high, min(px) as low, max(case when rn = n then px end) as close,
  floor(sum(qty) * 1e6 + 0.5) / 1e6 as volume, floor(sum(val) * 1e6 + 0.5) / 1e6 as trade_value
  from (select l_suppkey as code, cast(date_trunc('week', l_shipdate) as date) as date, l_extendedprice / l_quantity as px, l_quantity as qty, l_extendedprice as val,
    row_number() over (partition by l_suppkey, date_trunc('week', l_shipdate) order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as rn,
    count(*) over (partition by l_suppkey, date_trunc('week', l_shipdate)) as n from lineitem) group by code, date)"""
TICKS_SQL = """ticks as (select cast(user_id % 10 as int) as code, cast(ts as date) as day,
  cast(extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)) as int) as sec, event_id as seq, value as price,
  case when event_type in ('purchase', 'click') then 1 when event_type = 'error' then -1 else 0 end as side from events)"""
LOB_SQL = """lob as (select cast(user_id % 10 as int) as code, cast(ts as date) as day, cast(extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)) as int) as sec,
  event_id as seq, cast(floor(value * 100) as int) + 1 as px, cast(regexp_extract(props, '[0-9]+') as int) as k, event_type from events),
lt as (select code, day, sec, seq, px as price, k as volume, case when k % 9 = 0 then 0 when event_type = 'error' then -1 else 1 end as side, case when k % 10 <> 0 then k * 1.5::double end as strength, px - 5 as best_bid, px + 5 as best_ask
  from lob where event_type in ('purchase', 'click', 'error')),
lq as (select code, day, sec, seq, """ + ", ".join(f"case when k % 13 = 0 then 0 else px - {5 * n} end as bid{n + 1}, {'case when k % 17 <> 0 then ' if n == 1 else ''}(k + {3 * n}) % 50 + 1{' end' if n == 1 else ''} as bidqty{n + 1}, px + 5 * (1 + k % 3) + {5 * n} as ask{n + 1}, (k * 2 + {n}) % 50 + 1 as askqty{n + 1}" for n in range(3)) + """
  from lob where event_type not in ('purchase', 'click', 'error'))"""
TRADES_SQL = """trades as (select o_orderkey as trade_id, cast(o_orderdate as date) as entry_date, cast(o_custkey % 50 as int) as code, o_orderpriority as stratum,
  floor((o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over () * 1e6 + 0.5) / 1e6 as r from orders)"""
CALENDAR_SQL = """calendar as (select date, row_number() over (order by date) - 1 as idx from (select distinct cast(o_orderdate as date) as date from orders))"""

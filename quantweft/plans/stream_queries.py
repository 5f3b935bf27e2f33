"""Streaming operators run over a table as a stream: file source, stateful operator, file sink, all of it processed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.operators import lob as L
from quantweft.plans import book_queries as K
from quantweft.sources import shapes as S
from quantweft.sources.shapes import r6
from quantweft.streaming import feature_streams as Y
from quantweft.streaming import second_features as X


def _shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on one machine (tests) a temporary one where the session has none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors and the driver share")
    return at or tempfile.mkdtemp(prefix="quantweft-stream-")


def _drained(spark: SparkSession, rows: DataFrame, build: Callable[[DataFrame], DataFrame], ends: DataFrame | None = None, mode: str = "append") -> DataFrame:
    """All that build(rows), a stream, gives for the rows there are now, as a table.

    ends: one row (ts), later than all rows.  It follows them in a second source of the stream and moves the watermark on, so that what
    is still open then closes: windows, seconds, keys.
    """
    run = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    if ends is not None:
        ends.limit(0).write.parquet(f"{run}/ends")
        rows = rows.unionByName(spark.readStream.schema(ends.schema).parquet(f"{run}/ends"), allowMissingColumns=True)
    stream = build(rows)

    def drain() -> None:
        stream.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/mark").outputMode(mode).trigger(availableNow=True).start().awaitTermination()

    drain()
    if ends is not None:
        ends.coalesce(1).write.mode("append").parquet(f"{run}/ends")
        drain()
    return spark.read.schema(stream.schema).parquet(f"{run}/out")


def _source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = S.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _tick_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = _source(spark, sf, "events")
    side = F.when(F.col("event_type").isin("purchase", "click"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return e.select((F.col("user_id") % 10).cast("int").alias("code"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), side.alias("side"))


def _end(spark: SparkSession, sf: str) -> DataFrame:
    """A day after the last event."""
    return S.table(spark, sf, "events").agg((F.max("ts").cast("timestamp") + F.expr("interval 1 day")).alias("ts"))


def stream_minute_bars(spark, sf):
    out = _drained(spark, _tick_stream(spark, sf), X.minute_bars, _end(spark, sf))
    return out.filter("code is not null").select("code", F.col("minute").cast("string").alias("minute"), "open", "high", "low", "close", "n")


MINUTES_SQL = """select cast(user_id % 10 as int) as code, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, count(*) as n from events group by 1, 2"""


def stream_second_features(spark, sf):
    out = _drained(spark, _tick_stream(spark, sf), lambda rows: X.second_features(rows, empty=False), _end(spark, sf))
    return out.filter("cnt > 0 and code is not null").select("code", F.col("day").cast("string").alias("day"), "sec", r6("buy").alias("buy"), r6("sell").alias("sell"), "cnt", r6("buy_10").alias("buy_10"), "cnt_60")


SECONDS_SQL = f"""with {S.TICKS_SQL}, s as (select code, day, sec, coalesce(sum(price) filter (side > 0), 0) as buy, coalesce(sum(price) filter (side < 0), 0) as sell, count(*) as cnt from ticks group by 1, 2, 3)
select code, day::varchar as day, sec, floor(buy * 1e6 + 0.5) / 1e6 as buy, floor(sell * 1e6 + 0.5) / 1e6 as sell, cnt, floor(sum(buy) over (partition by code, day order by sec range between 9 preceding and current row) * 1e6 + 0.5) / 1e6 as buy_10,
  sum(cnt) over (partition by code, day order by sec range between 59 preceding and current row)::bigint as cnt_60 from s"""


def stream_incremental_fills(spark, sf):
    e = _source(spark, sf, "events").select(F.col("ts").cast("date").alias("day"), F.col("user_id").cast("long").alias("ord_no"), F.col("event_id").cast("long").alias("seq"), (F.col("event_id") * 7 % 1000).cast("long").alias("cum_qty"))
    return _drained(spark, e, X.cumulative_to_new).withColumn("day", F.col("day").cast("string"))


STREAM_FILLS_SQL = """with c as (select ts::date as day, user_id::bigint as ord_no, event_id::bigint as seq, (event_id * 7 % 1000)::bigint as cum from events),
d as (select *, cum - coalesce(max(cum) over (partition by day, ord_no order by seq rows between unbounded preceding and 1 preceding), 0) as new_qty from c) select day::varchar as day, ord_no, seq, new_qty from d where new_qty > 0"""

def lob_events(events, ts: str = "ts"):
    """Ticks and quotes of a table or stream of events in one shape, with their times."""
    e = events.select(*[c for c in events.columns if c != "ts"], F.col("ts").cast("timestamp").alias("ts"))
    depth = lambda p: sum(F.coalesce(f"{p}qty{i}", F.lit(0)) for i in (1, 2, 3)) * F.col(f"{p}1")
    quotes = S.quotes_of(e, 3, "ts").withColumns({"bid_depth3": depth("bid"), "ask_depth3": depth("ask"), "quote": F.lit(True)})
    both = S.ticks_of(e, "ts").withColumn("quote", F.lit(False)).unionByName(quotes, allowMissingColumns=True)
    kinds = dict(x.split() for x in Y.EVENT.split(", "))
    return both.select("code", "day", "ts", *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def _features(spark, sf, second: bool):
    rocks = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(rocks, None)
    spark.conf.set(rocks, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = _drained(spark, lob_events(_source(spark, sf, "events")), lambda rows: Y.feature_stream(rows, second, K.SLOTS, K.UNIT), _end(spark, sf))
    finally:
        spark.conf.set(rocks, before) if before else spark.conf.unset(rocks)
    # a session without a trade has no grid
    traded = S.lob_ticks(spark, sf).select("code", "day").distinct()
    out = out.join(traded, ["code", "day"], "left_semi")
    known = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in (L.V2 if second else L.V1)]
    return out.filter("code is not null").select("code", F.col("day").cast("string").alias("day"), "slot", *known)


def stream_features_v1(spark, sf):
    """All columns of the first feature set, slot by slot as the watermark passes."""
    return K._rounded(_features(spark, sf, False).filter("acc is not null and ret30 is not null"), L.V1)


def stream_features_v2(spark, sf):
    """All columns of the second."""
    return K._rounded(_features(spark, sf, True).filter("dist_hi300 is not null"), L.V2)


STREAM_V1_SQL, STREAM_V2_SQL = (f"select * replace (cast(day as varchar) as day) from ({x}) q" for x in (K.V1_SQL, K.V2_SQL))


QUERIES = {
    "stream_minute_bars": (stream_minute_bars, MINUTES_SQL),
    "stream_second_features": (stream_second_features, SECONDS_SQL),
    "stream_incremental_fills": (stream_incremental_fills, STREAM_FILLS_SQL),
    "stream_features_v1": (stream_features_v1, STREAM_V1_SQL),
    "stream_features_v2": (stream_features_v2, STREAM_V2_SQL),
}

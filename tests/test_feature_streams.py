"""Feature streams that start within a session, from its history, and streams in several batches, against the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantweft.operators import lob as L
from quantweft.plans import stream_queries as Z
from quantweft.sources import shapes as S
from quantweft.streaming import feature_streams as Y

DATA, CUT = "/root/testdata/sf0.001", 700


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def drained(spark, rows, end, second, path, history, files):
    """The stream of `files` parts of rows, one after the other, then of a row that is a day later."""
    at = f"{path}/in"
    parts = [rows.filter(F.col("ts") < files[0])] + [rows.filter((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(files, files[1:], strict=False)] + [rows.filter(F.col("ts") >= files[-1])]
    rows.limit(0).write.parquet(at)
    stream = spark.readStream.schema(rows.schema).parquet(at)
    for part in [*parts, end]:
        part.coalesce(1).write.mode("append").parquet(at)
        out = Y.feature_stream(stream, second, 1440, 60, history=history)
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/mark").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out").filter("code is not null").toPandas()


@pytest.mark.parametrize("second", [False, True])
def test_restart_from_history_and_batches(spark, rocks, tmp_path, second):
    table = S.table(spark, DATA, "events").filter("ts < timestamp'2024-01-03'")
    events = Z.lob_events(table)
    early = (F.col("sec") < CUT * 60) & (F.col("day") == "2024-01-01")
    history = events.filter(early).drop("ts").withColumn("resume", F.lit(CUT))
    end = events.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in events.dtypes]).withColumn("ts", F.lit("2024-01-05 00:00:00").cast("timestamp")).select(*events.columns)
    rows = events.filter(~early)
    got = drained(spark, rows, end, second, str(tmp_path), history, ["2024-01-01 15:00:00", "2024-01-02 09:30:10", "2024-01-02 16:00:00"])
    inputs = L.slot_inputs(S.ticks_of(table), S.quotes_of(table), 1440, 60)
    want = (L.features_v2(inputs, S.ticks_of(table), 60) if second else L.features_v1(inputs)).toPandas()
    resumed = set(map(tuple, history.select("code").distinct().collect()))
    names = L.V2 if second else L.V1
    got = got.set_index(["code", "day", "slot"])
    assert got.index.is_unique
    first = want["day"].astype(str) == "2024-01-01"
    want = want[~(first & want["code"].map(lambda c: (c,) in resumed) & (want["slot"] < CUT))].set_index(["code", "day", "slot"])
    assert len(want) > 5000 and set(want.index) <= set(got.index)
    a, b = got.loc[want.index, names].to_numpy(float), want[names].to_numpy(float)
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    assert not [k for k in got.index if str(k[1]) == "2024-01-01" and (k[0],) in resumed and k[2] < CUT]

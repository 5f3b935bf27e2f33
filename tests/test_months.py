"""Month sums in the order of time; weekdays."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from quantweft.functions import market as M
from quantweft.operators import statistics as T


def test_monthly_sums(spark):
    rows = [("a", 1, 1, 2.0), ("a", 1, 2, None), ("a", 3, 2, 5.0), ("a", 3, 9, -1.0), ("b", 2, 1, None), (None, 1, 1, 4.0)]
    df = spark.createDataFrame(rows, "code string, month int, time int, v double")
    got = {(r.code, r.month): (r.n, r.total) for r in T.monthly_sums(df, ["code"], "month", "time", "v").collect()}
    assert got == {("a", 1): (2, 2.0), ("a", 3): (2, 4.0), ("b", 2): (1, 0.0), (None, 1): (1, 4.0)}
    assert not T.monthly_sums(df.limit(0), ["code"], "month", "time", "v").collect()
    back = df.unionByName(spark.createDataFrame([("a", 1, 5, 1.0)], df.schema))
    with pytest.raises(PySparkException, match="order of time"):
        T.monthly_sums(back, ["code"], "month", "time", "v").collect()


def test_previous_weekday(spark):
    days = [dt.date(2024, 2, 24) + dt.timedelta(n) for n in range(16)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "d date").select("d", M.previous_weekday("d").alias("p"), M.is_closed_day("d", "2024-03-01").alias("c"))
    for d, p, c in df.collect():
        if d is None:
            assert p is None and c is False
            continue
        want = d - dt.timedelta(1)
        while want.weekday() >= 5:
            want -= dt.timedelta(1)
        assert (p, c) == (want, d < dt.date(2024, 3, 1))

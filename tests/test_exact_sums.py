"""Rolling sums against exact rationals."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quantweft.operators import exact_sums as E


def expected(values, n):
    out = []
    for i in range(len(values)):
        known = [Fraction(v) for v in values[max(0, i - n + 1) : i + 1] if v is not None and math.isfinite(v)]
        out.append((len(known), float(sum(known)) if known else None, float(sum(known)) / len(known) if known else None))
    return out


def series(kind, m=700):
    r = random.Random(kind)
    if kind == "spikes":
        return [r.choice([1e17, -1e17, 3e16]) if i % 50 == 7 else r.uniform(-1, 1) for i in range(m)]
    if kind == "cancel":
        return [s * (2.0**60 + 2.0**10 * i) if s else 0.1 * i for i in range(m // 3) for s in (1, 0, -1)]
    if kind == "unknown":
        return [r.choice([None, math.nan, math.inf, -math.inf, 0.1, 1e9]) for _ in range(m)]
    if kind == "zeros":
        return [0.0, -0.0, None] * 20
    if kind == "small":
        return [r.uniform(-1, 1) * 2.0**-900 for _ in range(m)]
    if kind == "single":
        return [0.1]
    return [r.gauss(0, 1) * 10 ** r.randint(-3, 6) for _ in range(m)]


KINDS = ["spikes", "cancel", "unknown", "zeros", "small", "single", "mixed"]


@pytest.mark.parametrize("n", [1, 60])
def test_equal_to_rationals(spark, n):
    rows = [(k, i, v) for k in KINDS for i, v in enumerate(series(k))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, i int, v double")
    got = {(r.kind, r.i): (r.x_n, r.x_sum, r.x_mean) for r in E.exact_rolling(df, F.col("v"), ["kind"], ["i"], n, "x").collect()}
    assert len(got) == len(rows)
    for k in KINDS:
        assert [got[k, i] for i in range(len(series(k)))] == expected(series(k), n)


def test_empty_and_columns(spark):
    df = spark.createDataFrame([], "kind string, i int, v double, extra string")
    out = E.exact_rolling(df, F.col("v"), ["kind"], ["i"], 5, "x")
    assert out.columns == ["kind", "i", "v", "extra", "x_n", "x_sum", "x_mean"] and not out.collect()

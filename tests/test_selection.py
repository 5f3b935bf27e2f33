"""Quantiles by narrowing against numpy, for values of all shapes."""

import math
import random

import numpy as np
import pytest

from quantweft.operators import selection

QS = [0.0, 0.05, 0.5, 0.9, 0.999, 1.0]


def groups():
    rng = random.Random(3)
    big = [rng.gauss(0, 1) for _ in range(2000)]
    return {
        "normal": big, "skewed": [math.exp(40 * rng.gauss(0, 1)) for _ in range(1000)], "negative": [-math.exp(60 * rng.random()) for _ in range(1000)],
        "one": [2.5], "two": [1.0, 2.0], "equal": [7.0] * 1000, "few values": [float(rng.randint(0, 3)) for _ in range(1000)], "tiny": [rng.random() * 1e-300 for _ in range(1000)],
        "both signs": [s * 10 ** rng.uniform(-200, 200) for s in (1, -1) for _ in range(800)] + [0.0] * 500, "next to each other": [1.0 + k * 2**-52 for k in range(1000)], None: [3.0, None, 4.0, float("nan")],
    }


def test_quantiles_like_numpy(spark):
    data = groups()
    rows = [(g, v) for g, values in data.items() for v in values] + [("none", None)]
    random.Random(1).shuffle(rows)
    got = {(r.g, r.quantile): (r.n, r.value) for r in selection.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", QS, 200).collect()}
    assert len(got) == len(data) * len(QS)
    for g, values in data.items():
        known = np.sort([v for v in values if v is not None and v == v])
        for q in QS:
            at = q * (len(known) - 1)
            lo, hi = known[math.floor(at)], known[min(math.floor(at) + 1, len(known) - 1)]
            assert got[g, q] == (len(known), lo + (hi - lo) * (at - math.floor(at))), (g, q)
            assert got[g, q][1] == pytest.approx(np.percentile(known, 100 * q), rel=1e-9)


def test_all_rows_as_one_group_and_none(spark):
    df = spark.range(10_001).withColumnRenamed("id", "v")
    assert [r.value for r in selection.exact_quantiles(df, [], "v", [0.25], 50).collect()] == [2500.0]
    assert selection.exact_quantiles(df.limit(0), [], "v", [0.25]).count() == 0

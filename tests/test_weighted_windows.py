"""Weighted trailing sums in blocks, decayed means over any span, betas and styles against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantweft.operators import risk, windows
from quantweft.operators.preparation import risk_styles


@pytest.mark.parametrize(("n", "half_life"), [(1, None), (5, None), (5, 2.0), (37, 0.5), (64, 30.0), (200, 3.0)])
def test_weighted_sums_like_a_loop(spark, n, half_life):
    rng = random.Random(n)
    rows = [(g, i, None if rng.random() < 0.2 else rng.gauss(0, 1)) for g, size in (("a", 150), ("b", 3), ("c", n)) for i in range(size)]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    got = {(r.g, r.i): (r.s, r.k) for r in windows.trailing_weighted_sums(df, {"s": F.col("x"), "k": F.when(F.col("x").isNotNull(), 1)}, ["g"], "i", n, half_life).collect()}
    x = {(g, i): v for g, i, v in rows}
    for g, i, _ in rows:
        known = [(x[g, j], 0.5 ** ((i - j) / half_life) if half_life else 1.0) for j in range(max(0, i - n + 1), i + 1) if x[g, j] is not None]
        assert got[g, i] == (pytest.approx(sum(v * w for v, w in known), abs=1e-12), pytest.approx(sum(w for _, w in known), abs=1e-12))


def test_a_window_of_too_many_half_lives(spark):
    with pytest.raises(ValueError, match="half-lives"):
        windows.trailing_weighted_sums(spark.range(1), {"s": F.col("id")}, [], "id", 600, 1.0)


@pytest.mark.parametrize(("half_life", "gap"), [(0.02, 0), (0.02, 35), (0.1, 120), (25.0, 0)])
def test_decayed_mean_over_thousands_of_half_lives(spark, half_life, gap):
    """The weights run in logarithms, so that none is lost."""
    rng = random.Random(1)
    x = [None if rng.random() < 0.4 or 60 <= i < 60 + gap else rng.random() for i in range(260)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "g int, t int, x double")
    got = {r.t: r.v for r in windows.decayed_mean(df, F.col("x"), ["g"], "t", half_life, "v").collect()}
    for t in range(260):
        known = [(i, v) for i, v in enumerate(x[: t + 1]) if v is not None]
        if not known:
            assert got[t] is None
            continue
        last = known[-1][0]
        w = [math.exp(-math.log(2) * min((last - i) / half_life, 2000)) for i, _ in known]
        assert got[t] == pytest.approx(sum(a * v for a, (_, v) in zip(w, known, strict=True)) / sum(w), rel=1e-9)


def test_rolling_beta_like_two_passes(spark):
    rng = np.random.default_rng(2)
    t_len, window, half_life, least, tail = 160, 40, 12.0, 20, 10
    m = rng.normal(0, 0.01, t_len)
    m[[0, 50]] = np.nan
    r = np.stack([b * np.nan_to_num(m) + rng.normal(0, 0.02, t_len) for b in (0.5, 1.5)])
    r[:, 0] = np.nan
    r[rng.random(r.shape) < 0.2] = np.nan
    r[1, 60:100] = np.nan
    rows = spark.createDataFrame([(c, t, float(r[c, t]), float(m[t])) for c in (0, 1) for t in range(t_len)], "code int, t int, r double, m double")
    got = {(x.code, x.t): (x.beta, x.resid_sd) for x in risk.rolling_beta(rows, window, half_life, least, tail).collect()}
    weights = 0.5 ** (np.arange(window - 1, -1, -1) / half_life)
    n = 0
    for c in (0, 1):
        for t in range(window, t_len):
            at = slice(t - window + 1, t + 1)
            ok = np.isfinite(r[c, at]) & np.isfinite(m[at])
            if ok.sum() < least:
                assert (c, t) not in got
                continue
            w, x, y = weights[ok], m[at][ok], r[c, at][ok]
            mx, my = np.average(x, weights=w), np.average(y, weights=w)
            beta = np.sum(w * (x - mx) * (y - my)) / np.sum(w * (x - mx) ** 2)
            late = ok[-tail:]
            resid = (r[c, at][-tail:] - beta * m[at][-tail:])[late]
            sd = np.std(resid, ddof=1) if late.sum() >= tail // 2 else None
            assert got[c, t][0] == pytest.approx(beta, rel=1e-9)
            assert got[c, t][1] == (None if sd is None else pytest.approx(sd, rel=1e-9))
            n += 1
    assert len(got) == n > 100


def test_styles_need_half_of_each_window(spark):
    rows = [(1, t, 10.0 + t, None if t < 3 else 100.0, 50.0 if t != 5 else None, 7.0, 0.01) for t in range(12)]
    panel = spark.createDataFrame(rows, "code int, t int, close double, cap double, trade_value double, ttm double, m double")
    got = {r.t: r for r in risk_styles(panel, 4, 2.0, 2, 2, 3, 1, ((2, 0.5), (4, 0.5)), 21.0).collect()}
    assert got[2].liquidity is None and got[2].size is None and got[3].size == pytest.approx(math.log(100))
    assert got[3].liquidity is None  # one of four known
    assert got[4].liquidity == pytest.approx(math.log(21 * 0.5)) and got[4].value == pytest.approx(0.07)
    assert got[5].momentum == pytest.approx(math.log(14 / 12)) and got[2].momentum is None
    assert got[9].beta is None  # the market does not move

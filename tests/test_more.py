"""Operators without SQL against plain Python: makers, bootstraps, the hash, streams of seconds, connections."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantweft.functions import market as M
from quantweft.operators import order_book as O
from quantweft.operators import resampling as R
from quantweft.operators import risk
from quantweft.operators import statistics as T
from quantweft.sources import jdbc
from quantweft.streaming.second_features import SecondState


def plain_hash(x):
    x &= 0xFFFFFFFF
    x ^= x >> 16
    x = x * 0x7FEB352D & 0xFFFFFFFF
    x ^= x >> 15
    x = x * 0x5BD1E995 & 0xFFFFFFFF
    return x ^ x >> 16


def test_hash(spark):
    xs = [0, 1, 2, 12345, 0xFFFFFFFF, 1 << 31, 0x1B873593 + 11 * 0x2545F491]
    got = [r.h for r in spark.createDataFrame([(x,) for x in xs], "x long").select(M.hash32("x").alias("h")).collect()]
    assert got == [plain_hash(x) for x in xs] == [M.hash32_of(x) for x in xs]


def test_block_bootstrap_like_a_loop(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=37)
    seed, block, reps = 11, 4, 50
    hs = plain_hash(seed * 0x2545F491 + 0x1B873593)
    means = []
    for b in range(reps):
        hb = plain_hash(hs ^ plain_hash(b + 0x27D4EB2F))
        taken = []
        for k in range(-(-len(x) // block)):
            at = plain_hash(hb ^ plain_hash(k * 3 + 1)) * (len(x) - block + 1) >> 32
            taken += list(x[at : at + block])
        means.append(sum(taken[: len(x)]) / len(x) * 12)
    got = R.block_bootstrap(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, v double"), "v", "t", block, reps, seed).first()
    assert got["mean"] == pytest.approx(np.mean(means), abs=1e-6) and got["lower"] == pytest.approx(np.percentile(means, 5), abs=1e-6)


def times_of(seed, key, replicate):
    """Poisson(1) from the hash of (seed, key, replicate)."""
    y = plain_hash((key & 0xFFFFFFFF) + 0x27D4EB2F)
    y = plain_hash(y ^ plain_hash(seed * 0x2545F491 + 0x1B873593) ^ key >> 32 & 0xFFFFFFFF)
    u = plain_hash(y ^ plain_hash(replicate * 3 + 1))
    return sum(u >= t for t in R.POISSON)


def cluster_number(text):
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def test_times_are_poisson():
    n = np.array([times_of(3, k, r) for k in [*range(400), *range(1 << 40, (1 << 40) + 100)] for r in range(40)])
    assert n.mean() == pytest.approx(1, abs=0.03) and n.var() == pytest.approx(1, abs=0.05)
    assert np.mean(n == 0) == pytest.approx(math.exp(-1), abs=0.01)


def test_cluster_bootstraps_like_a_loop_and_near_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"d": [f"2024-01-{1 + i % 20:02d}" for i in range(300)], "v": rng.normal(size=300), "side": rng.integers(0, 2, 300)})
    df = spark.createDataFrame(pdf)
    days = sorted(pdf.d.unique())
    w = np.array([[times_of(5, cluster_number(d), r) for d in days] for r in range(400)], float)
    s, n = (pdf.groupby("d")["v"].agg(f).to_numpy(float) for f in ("sum", "count"))
    means = (w @ s) / (w @ n)
    got = R.cluster_bootstrap(df, F.col("v"), F.col("d"), replicates=400, seed=5).first()
    assert (got.n_clusters, got["mean"], got.lower, got.upper, got.positive) == (20, pytest.approx(pdf.v.mean()), pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)), np.mean(means > 0))
    drawn = np.random.default_rng(5).integers(0, 20, size=(4000, 20))
    plain = s[drawn].sum(1) / n[drawn].sum(1)
    assert means.mean() == pytest.approx(plain.mean(), abs=0.02) and means.std() == pytest.approx(plain.std(), rel=0.15)
    one = R.cluster_bootstrap(df.filter("d = '2024-01-01'"), F.col("v"), F.col("d")).first()
    assert one.n_clusters == 1 and one.lower is None
    assert R.cluster_bootstrap(df.limit(0), F.col("v"), F.col("d")).first().n_clusters == 0
    part = lambda k, f: pdf[pdf.side == k].groupby("d")["v"].agg(f).reindex(days, fill_value=0).to_numpy(float)
    boot = (w @ part(0, "sum")) / (w @ part(0, "count")) - (w @ part(1, "sum")) / (w @ part(1, "count"))
    got = R.cluster_bootstrap_difference(df.filter("side = 0"), df.filter("side = 1"), F.col("d"), "v", 400, 5).first()
    assert got.lower == pytest.approx(np.percentile(boot, 2.5)) and got.difference == pytest.approx(pdf[pdf.side == 0].v.mean() - pdf[pdf.side == 1].v.mean())
    assert R.cluster_bootstrap_difference(df.limit(0), df, F.col("d"), "v").first().lower is None


def test_iid_bootstrap_like_a_loop_and_near_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(size=200)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", 5, 1.5), ("b", 6, None), (None, 1 << 35, 2.0)]
    got = {r.g: r for r in R.iid_bootstrap(spark.createDataFrame(rows, "g string, id long, x double"), "x", "id", ["g"], 300, 9).collect()}
    w = np.array([[times_of(9, i, r) for i in range(200)] for r in range(300)], float)
    means = (w @ x) / w.sum(1)
    assert (got["a"].n, got["a"]["mean"], got["a"].lower, got["a"].upper) == (200, pytest.approx(x.mean()), pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))
    plain = np.array([rng.choice(x, 200).mean() for _ in range(3000)])
    assert means.std() == pytest.approx(plain.std(), rel=0.15) and means.mean() == pytest.approx(plain.mean(), abs=0.02)
    assert (got["b"].n, got["b"].lower, got[None].upper) == (1, 1.5, 2.0)


def test_paired_bootstrap_like_a_loop(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 2)) / 100
    x[7] = [np.nan, 0.01]
    known = x[np.isfinite(x).all(axis=1)]
    n, block, hs = len(known), 6, plain_hash(2 * 0x2545F491 + 0x1B873593)
    sharpe, cagr = [], []
    for b in range(100):
        hb = plain_hash(hs ^ plain_hash(b + 0x27D4EB2F))
        at = [(plain_hash(hb ^ plain_hash(k * 3 + 1)) * (n - block + 1) >> 32) + o for k in range(-(-n // block)) for o in range(block)][:n]
        sharpe.append(np.subtract(*(known[at, i].mean() / known[at, i].std() * np.sqrt(252) for i in (0, 1))))
        cagr.append(np.subtract(*(np.prod(1 + known[at, i]) ** (252 / n) - 1 for i in (0, 1))))
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "t int, a double, b double")
    got = R.paired_bootstrap(rows, "t", "a", "b", replicates=100, seed=2).first()
    assert (got.n, got.sharpe_lower, got.prob_better) == (49, pytest.approx(np.percentile(sharpe, 2.5)), np.mean(np.array(sharpe) > 0))
    assert (got.cagr_lower, got.cagr_upper) == (pytest.approx(np.percentile(cagr, 2.5)), pytest.approx(np.percentile(cagr, 97.5)))
    short = R.paired_bootstrap(rows.limit(6), "t", "a", "b", replicates=10).first()
    assert short.n == 6 and short.sharpe_lower is None and short.prob_better is None
    for n, growth in ((20, 0.0), (21, -1.0)):  # a product of -1s is above 0 if there is an even number
        ruined = R.paired_bootstrap(spark.createDataFrame([(i, -2.0, 0.0) for i in range(n)], "t int, a double, b double"), "t", "a", "b", replicates=10).first()
        assert ruined.cagr_upper == pytest.approx(growth)


def test_maker_like_a_loop(spark):
    rng = np.random.default_rng(3)
    bid = np.where(rng.random(80) < 0.1, np.nan, rng.integers(95, 105, 80)).astype(float)
    ask = bid + 1
    within, horizon, cost = 4, 6, 0.001
    rows = [(1, "2024-01-01", i, None if math.isnan(b) else float(b), None if math.isnan(b) else float(b) + 1) for i, b in enumerate(bid)]
    book = spark.createDataFrame(rows, "code int, day string, slot int, bid double, ask double").withColumn("day", F.col("day").cast("date"))
    got = {r.slot: r.maker for r in O.maker_pessimistic(book, within, horizon, cost).collect()}
    for t in range(80):
        want = None
        if t + 1 < 80:
            fill = next((f for f in range(t + 2, min(80, t + 2 + within)) if bid[f] > 0 and bid[f] < bid[t + 1]), None)
            if fill is not None and fill + horizon < 80 and not np.isnan(ask[fill + 1 : fill + 1 + horizon]).all():
                want = np.nanmax(ask[fill + 1 : fill + 1 + horizon]) / bid[t + 1] - 1 - cost
        assert got[t] == (None if want is None else pytest.approx(want)), t


def test_optimizer_takes_a_large_universe():
    rng = np.random.default_rng(1)
    n, k = 2500, 35
    x, f, d = rng.normal(size=(n, k)), np.diag(rng.uniform(0.001, 0.01, k)), rng.uniform(0.01, 0.1, n)
    alpha, before = rng.normal(size=n) * 0.02, np.full(n, 1 / n)
    w, status = risk.optimize(alpha, x, f, d, before, 5.0, 0.001, 0.1, impact=0.01)
    assert status == "optimal" and w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= 0.1
    value = lambda u: alpha @ u - 2.5 * (u @ (x @ (f @ (x.T @ u))) + u @ (d * u)) - 0.001 * np.abs(u - before).sum() - 0.01 * (np.abs(u - before) ** 1.5).sum()
    assert all(value(risk.project(w + rng.normal(size=n) * s, 0.1, 1.0)) <= value(w) + 1e-9 for s in (1e-2, 1e-3, 1e-4, 1e-5) for _ in range(10))


def test_seconds_in_batches_are_those_of_one():
    rng = np.random.default_rng(4)
    sec = np.sort(rng.integers(100, 900, 120))
    price, side = rng.random(120) * 10, rng.integers(-1, 2, 120)
    whole = SecondState()
    one = pd.concat([whole.add(sec, price, side), whole.close()])
    many, parts = SecondState(), []
    for at in np.array_split(np.arange(120), 7):
        parts.append(many.add(sec[at], price[at], side[at]))
        many = SecondState(many.dump())
    several = pd.concat([*parts, many.close()])
    pd.testing.assert_frame_equal(one.reset_index(drop=True), several.reset_index(drop=True))
    assert one["sec"].tolist() == list(range(int(sec[0]), int(sec[-1]) + 1)) and one["cnt"].sum() == 120
    at = one.set_index("sec").loc[int(sec[60])]
    assert at.cnt_60 == ((sec > sec[60] - 60) & (sec <= sec[60])).sum()


def test_connections():
    got = jdbc.options("postgresql://me:p%40ss@db.example:5433/market", "bars", "date", "2020-01-01", "2024-01-01", 8)
    assert got["url"] == "jdbc:postgresql://db.example:5433/market" and got["password"] == "p@ss" and got["numPartitions"] == "8"
    assert jdbc.resolve(None, {"DATABASE_URL": "postgres://h/d"}) == {"url": "jdbc:postgresql://h/d"}
    for bad in (lambda: jdbc.resolve(None, {}), lambda: jdbc.resolve("postgres://h"), lambda: jdbc.options("postgres://h/d", "t", "x")):
        with pytest.raises(ValueError):
            bad()


def test_hurdle():
    got = T.t_hurdle(20)
    assert got["base"] == pytest.approx(1.959964, abs=1e-6) and 2.9 < got["adjusted"] < 3.1

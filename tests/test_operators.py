"""Operators against plain Python on small inputs."""

import math
import random
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.functions import costs, market
from quantweft.operators import execution, order_book, risk, search, statistics, windows
from quantweft.sources import ledgers


def test_tick_bands(spark):
    prices = [0, 1, 1999, 2000, 4999, 5000, 19990, 20000, 49950, 50000, 199900, 200000, 499500, 500000, 1000000]
    ticks = [None, 1, 1, 5, 5, 10, 10, 50, 50, 100, 100, 500, 500, 1000, 1000]
    out = spark.createDataFrame([(float(p),) for p in prices], "p double").select(market.tick_size("p").alias("t")).collect()
    assert [r.t for r in out] == ticks


def test_shift_ticks_steps(spark):
    def step(p, n):
        tick = lambda x: next((t for b, t in market.STOCK_BANDS if x < b), market.STOCK_TOP)
        for _ in range(abs(n)):
            if n < 0 and p <= 1:
                return None
            p = p + tick(p) if n > 0 else p - tick(p - 1)
        return p

    rng = random.Random(1)
    cases = [(p, n) for p in (1, 3, 1999, 2000, 4995, 5000, 19990, 20000, 49950, 199900, 500000) for n in (rng.randint(-8, 8), -2, 5)]
    out = spark.createDataFrame(cases, "p long, n int").select("p", "n", market.shift_ticks("p", F.col("n")).alias("q")).collect()
    for r in out:
        assert r.q == step(r.p, r.n), r


def test_limits(spark):
    r = spark.createDataFrame([(239000.0,), (24250.0,), (10000.0,)], "p double").select(market.limit_up("p").alias("up"), market.limit_down("p").alias("down")).collect()
    assert [x.down for x in r] == [167500.0, 17000.0, 7000.0]
    assert r[2].up == 13000.0


def test_codes_and_titles(spark):
    codes = spark.createDataFrame([("A041830",), ("0155E0",), ("41830",), (None,), (" 5930 ",)], "c string").select(market.normalize_code("c").alias("c")).collect()
    assert [r.c for r in codes] == ["041830", "0155E0", "041830", "", "005930"]
    titles = ["매매거래정지 (주식분할)", "매매거래정지", "매매거래정지 (횡령)", "배임", None, "분기보고서"]
    out = spark.createDataFrame([(t,) for t in titles], "t string").select(market.title_severity("t").alias("s")).collect()
    assert [r.s for r in out] == ["UNCLASSIFIED", "HARD", "HARD", "HARD", "UNCLASSIFIED", "UNCLASSIFIED"]


def test_costs_guard(spark):
    one = spark.range(1)
    with pytest.raises(Exception, match="won"):
        one.select(costs.participation(F.lit(1.0), F.lit(10.0))).collect()
    with pytest.raises(Exception, match="fraction"):
        one.select(costs.sqrt_impact_bp(F.lit(1.0), F.lit(1e9), F.lit(2.0))).collect()
    with pytest.raises(ValueError):
        costs.limit_filled("BUY", F.lit(1.0), F.lit(1.0), "near")
    assert one.select(costs.sqrt_impact_bp(F.lit(1e6), F.lit(None).cast("double"), F.lit(0.1)).alias("x")).first().x is None


def test_ranks_like_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"d": rng.integers(0, 3, 60), "k": range(60), "v": np.where(rng.random(60) < 0.2, np.nan, rng.integers(0, 6, 60))})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    out = df.select("k", windows.average_rank("v", "d").alias("r")).toPandas().set_index("k").r
    want = pdf.groupby("d").v.rank()
    pd.testing.assert_series_equal(out.sort_index().astype(float), want, check_names=False)


def test_forward_extremes_agree(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i, float(rng.integers(0, 50))) for i in range(103)] + [("b", i, float(rng.integers(0, 50))) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    for lo, n in ((0, 1), (1, 4), (2, 20), (3, 200)):
        out = windows.forward_extreme_blocks(df, "v", ["g"], "i", lo, n, "x").withColumn("y", windows.forward_extreme(F.col("v"), ["g"], "i", lo, n))
        for r in out.collect():
            assert r.x == r.y, (lo, n, r)


def test_global_row_number(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 20)) for i in range(500)]
    out = windows.global_row_number(spark.createDataFrame(rows, "i int, v int").repartition(7), [F.desc("v"), F.col("i")], "n").collect()
    want = {i: n for n, (i, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r.i: r.n for r in out} == want


def test_global_row_number_of_rows_that_come_in_another_order_each_time(spark):
    """Distinct, without gaps, in order and the same again, for rows after an aggregation and a join."""
    base = spark.range(1_000_000).withColumn("k", F.xxhash64("id") % 1_000_003)
    rows = base.groupBy("k").agg(F.count(F.lit(1)).alias("c")).join(base.groupBy("k").agg(F.max("id").alias("m")), "k")

    def numbered():
        out = windows.global_row_number(rows, [F.asc("k")], "n")
        checks = out.withColumn("same", F.row_number().over(W.orderBy("k")) == F.col("n"))
        return tuple(checks.agg(F.count(F.lit(1)), F.count_distinct("n"), F.min("n"), F.max("n"), F.min("same"), F.sum(F.xxhash64("k", "n").cast("decimal(38,0)"))).first())

    first = numbered()
    assert first[0] == first[1] == first[3] and first[2] == 1 and first[4]
    assert numbered() == first


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), ("a", 7)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 2.0), ("a", 6, 3.0)], "k string, t int, v double")
    got = lambda strict: {(r.k, r.t): r.v for r in windows.as_of(left, right, ["k"], "t", "t", ["v"], strict).collect()}
    assert got(False) == {("a", 5): 2.0, ("a", 1): None, ("b", 9): None, ("a", 7): 3.0}
    assert got(True) == {("a", 5): None, ("a", 1): None, ("b", 9): None, ("a", 7): 3.0}


def test_position_fold(spark):
    fills = spark.createDataFrame([("x", 1, "buy", 2, 100), ("x", 2, "buy", 1, 130), ("x", 3, "sell", 2, 150)], "code string, seq long, side string, qty long, price long")
    r = {x.seq: x for x in execution.position_fold(fills).collect()}
    assert r[2].avg_price == 110.0 and r[3].qty == 1
    want = (Decimal(150) - 110) * 2 - Decimal(220) * Decimal("0.00015") - 300 * (Decimal("0.00015") + Decimal("0.0020"))
    assert r[3].realized == pytest.approx(float(want))
    with pytest.raises(Exception, match="with 0 held"):
        execution.position_fold(fills.filter("seq = 3")).collect()


def test_kill_switch_like_a_loop(spark):
    rng = random.Random(3)
    rows = [(1, date(2024, 1, 1 + d), i, float(rng.choice([-30, -10, 0, 20, 40]))) for d in range(12) for i in range(25)]
    out = execution.kill_switch(spark.createDataFrame(rows, "account int, day date, seq int, pnl double"), 80, 3, 0.5, 50)
    got = {(r.day, r.seq): r.reason for r in out.collect()}
    day = None
    for _, d, i, p in rows:
        if d != day:
            day, total, peak, run, why = d, 0.0, 0.0, 0, None
        total += p
        run = run + 1 if p < -1e-9 else 0
        peak = max(peak, total)
        if why is None:
            why = "profit_giveback" if peak >= 50 and total <= peak * 0.5 else "consecutive_losses" if run >= 3 else "daily_loss" if total <= -80 else None
        assert got[d, i] == why


def test_statistics(spark):
    x = np.random.default_rng(5).normal(0.1, 1, 60)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
    r = statistics.newey_west(df, "v", "i", 3).first()
    d = x - x.mean()
    s = d @ d + 2 * sum((1 - k / 4) * (d[k:] @ d[:-k]) for k in (1, 2, 3))
    assert r.t == pytest.approx(x.mean() / (math.sqrt(s) / len(x)))
    assert statistics.newey_west(df.limit(4), "v", "i", 3).first().t is None
    e = statistics.expected_max_of(df, "v", 3).first().expected_max
    v = np.sort(x)
    assert e == pytest.approx(sum(v[i] * math.comb(i, 2) / math.comb(60, 3) for i in range(60)), abs=1e-5)
    assert statistics.probabilistic_sharpe(0.1, 0.0, 100, 0.0, 3.0) == pytest.approx(0.8398, abs=1e-3)


def test_regression_recovers_factors(spark):
    rng = np.random.default_rng(2)
    n = 300
    style, ind, cap = rng.normal(size=n), rng.integers(0, 3, n), rng.uniform(1, 9, n)
    share = np.array([cap[ind == i].sum() for i in range(3)])
    f_ind = np.array([0.01, -0.02, 0.0])
    f_ind -= (share @ f_ind) / share.sum()
    ret = 0.003 + 0.02 * style + f_ind[ind]
    pdf = pd.DataFrame({"date": date(2024, 1, 1), "s": style, "ind": ind.astype(str), "ret": ret, "cap": cap})
    out = {r.factor: r.f for r in risk.cross_section_regression(spark.createDataFrame(pdf), ["s"], "ind", "ret", "cap").collect()}
    assert out["market"] == pytest.approx(0.003) and out["s"] == pytest.approx(0.02)
    assert [out[f"ind_{i}"] for i in range(3)] == pytest.approx(list(f_ind))


def test_optimizer():
    rng = np.random.default_rng(4)
    n = 60
    x, f, d, alpha = rng.normal(size=(n, 3)), np.diag([0.04, 0.02, 0.01]), np.full(n, 0.05), rng.normal(size=n) * 0.05
    w, status = risk.optimize(alpha, x, f, d, np.full(n, 1 / n), 4.0, 0.0, 0.1)
    assert status == "optimal" and w.sum() == pytest.approx(1) and w.min() >= -1e-9 and w.max() <= 0.1 + 1e-9
    value = lambda u: alpha @ u - 2 * (u @ (x @ (f @ (x.T @ u))) + u @ (d * u))
    for _ in range(200):
        other = risk.project(w + rng.normal(size=n) * 0.02, 0.1, 1.0)
        assert value(other) <= value(w) + 1e-9
    assert risk.optimize(alpha, x, f, d, np.full(n, 1 / n), 4.0, 0.0, 0.001)[1] == "infeasible"


def test_search(spark):
    def objective(c):
        if c["a"] == 2:
            raise ValueError("no")
        return {"v": float(c["a"] * c["b"])}

    out = search.run_sweep(spark, objective, search.grid(a=[1, 2, 3], b=[10, 20]), "a int, b int", "v double")
    rows = out.collect()
    assert [(r.a, r.b) for r in rows] == [(1, 10), (1, 20), (2, 10), (2, 20), (3, 10), (3, 20)]
    assert rows[2].error == "ValueError: no" and search.best(out, "v")["v"] == 60.0
    x, v, used = search.evolve(lambda p: -((p - 0.3) ** 2).sum(axis=1), 4, 3000, 1)
    assert v > -1e-6 and used >= 3000 and x == pytest.approx([0.3] * 4, abs=1e-3)
    rng = random.Random(0)
    left = search.race([0.0, 1.0, 1.05], list(range(30)), lambda pairs: [c + rng.gauss(0, 0.3) for c, _ in pairs])
    assert 0 not in left and 2 in left


def test_queue_statuses(spark):
    path = pd.DataFrame({"code": 1, "day": date(2024, 1, 1), "slot": range(6), "bid": [10.0, 10, 10, 10, 9, 9], "ask": [11.0, 11, 11, 11, 10, 10], "bid_qty": [5.0, 5, 5, 5, 5, 5], "sell_at": [0.0, 2, 2, 2, 2, 2]})
    orders = [(1, date(2024, 1, 1), 1, 0, 10.0, 5), (1, date(2024, 1, 1), 2, 0, 11.0, 5), (1, date(2024, 1, 1), 3, 0, 8.0, 5), (1, date(2024, 1, 1), 4, 9, 8.0, 5)]
    out = order_book.queue_fills(spark.createDataFrame(orders, "code int, day date, order_id long, slot int, limit_price double, wait int"), spark.createDataFrame(path))
    got = {r.order_id: (r.status, r.fill_slot) for r in out.collect()}
    assert got == {1: (2, 3), 2: (1, 0), 3: (3, None), 4: (0, None)}


def test_ledgers(spark, tmp_path):
    p = str(tmp_path / "runs.jsonl")
    ledgers.append_row(p, {"run_id": "a", "event": "start", "label": "x", "ts": "1"})
    with open(p, "a") as f:
        f.write("{broken\n")
    ledgers.append_row(p, {"run_id": "a", "event": "end", "status": "ok", "ts": "2"}, durable=True)
    schema = "run_id string, event string, label string, status string, ts string"
    r = ledgers.merge_runs(ledgers.read_ledger(spark, p, schema)).first()
    assert (r.label, r.status, r.ended) == ("x", "ok", "2")
    with pytest.raises(Exception, match="corrupt"):
        ledgers.read_ledger(spark, p, schema, strict=True).collect()
    assert ledgers.record_trials(spark, str(tmp_path / "t.jsonl"), [{"a": 1}, {"a": 1}, {"a": 2}], search.fingerprint) == 2
    assert ledgers.record_trials(spark, str(tmp_path / "t.jsonl"), [{"a": 2}], search.fingerprint) == 2


def test_day_cache_and_generations(spark, tmp_path):
    from pyspark.sql import types as T

    ds = ledgers.Dataset("ticks", T.StructType([T.StructField("code", T.StringType(), False), T.StructField("qty", T.IntegerType(), False)]), ("code",))
    calls = []

    def fetch(day):
        calls.append(day)
        return spark.createDataFrame([("a", 1.0), ("b", 2.0)], "code string, qty double")

    for _ in range(2):
        out = ledgers.load_day(spark, ds, date(2024, 1, 2), fetch, str(tmp_path), date(2024, 1, 3), codes=["b"], columns=["qty"])
        assert [r.qty for r in out.collect()] == [2]
    assert len(calls) == 1
    ledgers.load_day(spark, ds, date(2024, 1, 3), fetch, str(tmp_path), date(2024, 1, 3)).collect()
    assert len(calls) == 2  # an open day is not cached
    with pytest.raises(TypeError):
        ledgers.load_day(spark, ds, date(2024, 1, 2), fetch, str(tmp_path), date(2024, 1, 3), codes="b")
    with pytest.raises(Exception, match="fraction"):
        ds.compact(spark.createDataFrame([("a", 1.5)], "code string, qty double")).collect()
    store = ledgers.GenerationStore(spark, str(tmp_path / "store"))
    for n in (1, 2, 3):
        assert store.write("panel/x", spark.range(n).toDF("v")) == n
    assert store.read("panel/x", ["v"]).count() == 3 and not (tmp_path / "store/panel/x/g1").exists()
    with pytest.raises(ValueError):
        store.write("../x", spark.range(1))


def test_hold_out(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 2, 1),)], "d date")
    assert df.filter(ledgers.outside((date(2024, 1, 15), date(2024, 3, 1)), F.col("d"))).count() == 1
    with pytest.raises(Exception, match="hold-out"):
        ledgers.checked_outside(df, (date(2024, 2, 1), date(2024, 3, 1)), "d").collect()


def test_latest_severe(spark):
    rows = [("1", "x", date(2024, 1, 5), "배임"), ("2", "x", date(2024, 1, 5), "횡령"), ("3", "x", date(2024, 1, 6), "분기보고서"), ("0", "x", date(2023, 12, 1), "배임")]
    df = spark.createDataFrame(rows, "filing_no string, code string, filed date, title string")
    assert ledgers.latest_severe(df, market.title_severity("title"), "x", datetime(2024, 1, 8)).first().filing_no == "2"

"""Weights under many limits from their multipliers: optimal, few steps for any number of names, infeasible limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_allocation import ALL, certified, problem

from quantweft.operators import allocation as A
from quantweft.plans.risk_queries import BOOK_LIMITS

FREE = A.Limits(**{**ALL.__dict__, "sector_band": None, "max_turnover": None, "max_participation": None})


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("limits", [ALL, FREE, A.Limits(budget=0.8, allow_cash=True, max_turnover=0.3), A.Limits(budget=None, long_only=False, beta_bounds=(None, 0.5))])
def test_same_weights_as_by_splitting(limits, seed):
    p = problem(100, 5, seed)
    if seed == 3:
        p.impact, p.linear = np.zeros(100), 0.0
    s = A.by_multipliers(p, limits, 5.0)
    assert s.status == A.OPTIMAL and s.primal <= 1e-8
    certified(p, limits, s, 5.0)
    assert s.w == pytest.approx(A.solve(p, limits, 5.0, steps=100_000, tol=1e-10).w, abs=1e-7)


def crowd(n, copies):
    """n different names so often: each weight is tiny, and nearly all are at one of their bounds."""
    r, code = np.random.default_rng(7), np.arange(n * copies)
    value, alpha = np.tile(r.lognormal(10, 0.8, n), copies), np.tile(r.normal(0, 0.01, n), copies)
    share, size = value / value.sum(), (np.log(value) - np.log(value).mean()) / np.log(value).std()
    return A.Problem(
        alpha, np.c_[np.ones(len(code)), size], np.array([[0.04, 0], [0, 0.01]]), 0.02 + code % 7 / 100, np.full(len(code), 1 / len(code)), ["mkt", "size"], linear=np.full(len(code), 0.001),
        tilt=np.full(len(code), -0.0005), impact=np.full(len(code), 0.002), sector=code % 5, benchmark=share, capacity=share * 2, no_buy=code % 11 == 3, no_trade=code % 17 == 5,
    )


@pytest.mark.parametrize("copies", [1, 60, 360])
def test_steps_do_not_grow_with_the_names(copies):
    p = crowd(540, copies)
    s = A.by_multipliers(p, BOOK_LIMITS, 5.0)
    assert s.status == A.OPTIMAL and s.steps <= 30
    certified(p, BOOK_LIMITS, s, 5.0, tol=1e-9)


@pytest.mark.parametrize("limits", [A.Limits(max_weight=0.005), A.Limits(style_bounds={"f1": (50.0, 60.0)}), A.Limits(max_turnover=1e-4, max_weight=0.009), A.Limits(sector_band=0.001, max_turnover=0.001), A.Limits(budget=1.5, max_participation=0.01)])
def test_infeasible_limits(limits):
    p = problem(100, 5, 1)
    s = A.by_multipliers(p, limits, 5.0)
    assert s.status == A.INFEASIBLE and (s.w == p.w_prev).all() and s.steps <= 20


def test_left_to_splitting():
    p = problem(50, 3, 1)
    p.d = np.r_[0.0, p.d[1:]]
    assert A.by_multipliers(p, ALL, 5.0) is None
    assert A.by_multipliers(problem(100, 5, 1), ALL, 5.0, steps=2) is None
    unknown = problem(50, 3, 1)
    unknown.capacity = np.r_[np.nan, unknown.capacity[1:]]
    assert A.by_multipliers(unknown, ALL, 5.0) is None


def test_dates_of_a_panel_take_the_short_way(spark):
    p = problem(40, 2, 3)
    columns = {"alpha": p.alpha, "d": p.d, "w_prev": p.w_prev, "f0": p.x[:, 0], "f1": p.x[:, 1], "linear": p.linear, "impact": p.impact, "capacity": p.capacity}
    data = [(int(i), *(float(v[i]) for v in columns.values())) for i in range(40)]
    rows = spark.createDataFrame(data, ["code", *columns]).withColumn("date", F.lit("2024-01-02").cast("date"))
    limits = A.Limits(max_weight=0.2, max_turnover=0.4, max_participation=0.5)
    got = A.optimize_panel(rows, ["f0", "f1"], p.f, limits, 5.0).orderBy("code").toPandas()
    bare = A.Problem(p.alpha, p.x, p.f, p.d, p.w_prev, ["f0", "f1"], linear=p.linear, impact=p.impact, capacity=p.capacity)
    assert set(got.status) == {"optimal"} and (got.w.to_numpy() == A.by_multipliers(bare, limits, 5.0).w).all()

"""Weights under many limits: optimality conditions, known solutions, infeasible and unfinished problems, every date of a panel."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantweft.operators import allocation as A
from quantweft.operators import risk
from quantweft.plans import risk_queries as K

ALL = A.Limits(max_weight=0.2, sector_band=0.06, beta_bounds=(0.9, 1.1), style_bounds={"f1": (-0.2, 0.2), "f2": (None, 0.1)}, max_turnover=0.5, max_participation=0.5)


def problem(n, k, seed):
    r = np.random.default_rng(seed)
    x = np.c_[np.ones(n), r.normal(size=(n, k - 1))]
    g = r.normal(size=(k, k)) * 0.003
    b = r.uniform(0.5, 1.5, n)
    return A.Problem(
        r.normal(0, 1e-3, n), x, g @ g.T + np.eye(k) * 1e-6, r.uniform(1e-4, 9e-4, n), np.full(n, 1 / n), [f"f{i}" for i in range(k)], linear=np.full(n, 1e-3), tilt=np.full(n, -5e-4),
        impact=r.uniform(0, 2e-3, n), sector=r.integers(0, 8, n), benchmark=b / b.sum(), capacity=r.uniform(0.02, 0.5, n), no_buy=r.random(n) < 0.05, no_trade=r.random(n) < 0.05,
    )


def certified(p, limits, s, aversion, tol=1e-6):
    """Feasible, stationary, and each multiplier in the normal cone of its limit: then the weights are optimal."""
    lo, hi = A.by_name(p, limits)
    rows, low, high = A.totals(p, limits)
    name, total, traded = s.y
    got = rows @ s.w
    assert (s.w >= lo - tol).all() and (s.w <= hi + tol).all()
    assert (got >= low - tol).all() and (got <= high + tol).all()
    scale = aversion * np.mean(np.sum((p.x @ p.f) * p.x, 1) + p.d)
    assert np.abs(aversion * p.covariance_times(s.w) - p.alpha + name + rows.T @ total + traded).max() <= 1e-4 * scale
    big = np.abs(total).max(initial=1e-12)
    assert not (total > 1e-3 * big)[got < high - 1e-5].any() and not (total < -1e-3 * big)[got > low + 1e-5].any()
    # weights that the costs and bounds leave alone under this multiplier
    assert np.abs(A.settled(s.w + name / scale, A.Problem(p.alpha, p.x, p.f, p.d, p.w_prev, p.names, p.linear / scale, p.tilt / scale, p.impact / scale), lo, hi, 1.0) - s.w).max() <= 1e-4
    if limits.max_turnover is not None:
        dw = s.w - p.w_prev
        size = np.abs(dw).sum()
        assert size <= limits.max_turnover + tol * len(dw)
        if size < limits.max_turnover - 1e-4:
            assert np.abs(traded).max() <= 1e-3 * scale
        else:
            assert traded @ dw == pytest.approx(np.abs(traded).max() * size, abs=1e-4 * scale)


@pytest.mark.parametrize(("n", "k", "seed"), [(60, 5, 1), (60, 5, 2), (200, 10, 3), (200, 10, 4)])
def test_optimality_conditions(n, k, seed):
    p = problem(n, k, seed)
    free = {f: None for f in ("sector_band", "max_turnover", "max_participation")}
    for limits in (ALL, A.Limits(**{**ALL.__dict__, **free}), A.Limits(budget=0.8, allow_cash=True, max_turnover=0.3), A.Limits(budget=None, long_only=False, beta_bounds=(None, 0.5))):
        s = A.solve(p, limits, 5.0)
        assert s.status == A.OPTIMAL
        certified(p, limits, s, 5.0)


def test_known_solutions():
    n = 5
    p = A.Problem(np.array([3.0, 1, 2, 0, 0]) / 100, np.zeros((n, 1)), np.zeros((1, 1)), np.full(n, 0.01), np.full(n, 0.2), ["f"])
    free = A.solve(p, A.Limits(budget=None, long_only=False), 2.0)
    assert free.w == pytest.approx(p.alpha / (2 * p.d), abs=1e-6)
    # no trade pays for its cost
    dear = A.Problem(**{**p.__dict__, "linear": np.full(n, 1.0)})
    assert A.solve(dear, A.Limits(), 2.0).w == pytest.approx(p.w_prev, abs=1e-7)
    kept = A.Problem(**{**p.__dict__, "no_trade": np.array([0, 1, 0, 0, 0], bool), "no_buy": np.array([1, 0, 0, 0, 0], bool)})
    s = A.solve(kept, A.Limits(), 2.0)
    assert s.w[1] == pytest.approx(0.2) and s.w[0] <= 0.2 + 1e-8 and s.w.sum() == pytest.approx(1, abs=1e-6)
    turned = A.solve(p, A.Limits(max_turnover=0.1), 2.0)
    assert np.abs(turned.w - 0.2).sum() == pytest.approx(0.1, abs=1e-6) and turned.w[0] > 0.2


def test_same_as_the_proximal_solver():
    p = problem(80, 4, 7)
    plain = A.Problem(p.alpha, p.x, p.f, p.d, p.w_prev, p.names, linear=0.001, impact=0.01)
    w, status = risk.optimize(p.alpha, p.x, p.f, p.d, p.w_prev, 5.0, 0.001, 0.1, impact=0.01)
    assert status == "optimal" and A.solve(plain, A.Limits(max_weight=0.1), 5.0).w == pytest.approx(w, abs=2e-6)


@pytest.mark.parametrize("limits", [A.Limits(max_weight=0.005), A.Limits(style_bounds={"f1": (50.0, 60.0)}), A.Limits(max_turnover=1e-4, max_weight=0.009), A.Limits(sector_band=0.001, max_turnover=0.001), A.Limits(budget=1.5, max_participation=0.01)])
def test_infeasible_limits(limits):
    p = problem(100, 5, 1)
    s = A.solve(p, limits, 5.0)
    assert s.status == A.INFEASIBLE and (s.w == p.w_prev).all()


def test_unfinished_and_wrong_inputs():
    p = problem(100, 5, 1)
    s = A.solve(p, ALL, 5.0, steps=20)
    assert s.status == A.INACCURATE and (s.w == p.w_prev).all() and s.primal > 1e-8
    for limits, what in ((A.Limits(style_bounds={"none": (0, 1)}), "unknown factor"), (A.Limits(beta_bounds=(2, 1)), "empty bounds")):
        with pytest.raises(ValueError, match=what):
            A.solve(p, limits)
    with pytest.raises(ValueError, match="needs capacity"):
        A.solve(A.Problem(p.alpha, p.x, p.f, p.d, p.w_prev, p.names), A.Limits(max_participation=0.1))
    with pytest.raises(ValueError, match="unknown values"):
        A.solve(A.Problem(p.alpha * np.nan, p.x, p.f, p.d, p.w_prev, p.names), A.Limits())


def test_a_large_universe_in_time():
    p = problem(2500, 35, 3)
    began = time.time()
    s = A.solve(p, A.Limits(max_weight=0.02, sector_band=0.05, beta_bounds=(0.9, 1.1), style_bounds={"f1": (-0.2, 0.2)}, max_turnover=0.6, max_participation=0.5), 5.0)
    assert s.status == A.OPTIMAL and time.time() - began < 20


def test_every_date_of_a_panel(spark):
    out = K.optimize_limits(spark, "/root/testdata/sf0.001").cache()
    books = out.groupBy("date", "status").agg(F.sum("w").alias("w"), F.min("w").alias("least"), F.max("w").alias("most"), F.count(F.lit(1)).alias("n"), F.max("turnover").alias("turnover")).toPandas()
    done = books[books.status == "optimal"]
    assert len(done) > 0 and set(books.status) <= {"optimal", "infeasible"}
    assert np.abs(done.w - 1).max() < 1e-5 and done.least.min() > -1e-9 and done.most.max() < 0.15 + 1e-6 and done.turnover.max() < 0.8 + 1e-4

"""The steps of the constrained optimiser hardly grow with the names."""

import numpy as np

from quantweft.operators import allocation as A
from quantweft.plans.risk_queries import BOOK_LIMITS


def test_thirty_thousand_names():
    n = 30_000
    r, code = np.random.default_rng(2), np.arange(n)
    value = r.lognormal(10, 0.8, n)
    share, size = value / value.sum(), (np.log(value) - np.log(value).mean()) / np.log(value).std()
    p = A.Problem(
        r.normal(0, 0.003, n), np.c_[np.ones(n), size], np.array([[0.04, 0], [0, 0.01]]), 0.02 + code % 7 / 100, np.full(n, 1 / n), ["mkt", "size"], linear=np.full(n, 0.001), tilt=np.full(n, -0.0005),
        impact=np.full(n, 0.002), sector=code % 5, benchmark=share, capacity=share * 2, no_buy=code % 11 == 3, no_trade=code % 17 == 5,
    )
    s = A.solve(p, BOOK_LIMITS, 5.0)
    assert s.status == A.OPTIMAL and s.steps <= 800
    lo, hi = A.by_name(p, BOOK_LIMITS)
    assert (s.w >= lo - 1e-8).all() and (s.w <= hi + 1e-8).all() and abs(s.w.sum() - 1) < 1e-4

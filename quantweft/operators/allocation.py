"""Mean-variance weights under many limits, one cross-section a date as an Arrow group.

    maximise alpha'w - risk/2 w'(X F X' + D)w - sum(linear |dw| + tilt dw + impact |dw|^(3/2)),   dw = w - w_prev

under bounds by name (long only, largest weight, share of a day's trade, no buying, no trading), bounds of linear totals (budget, sector
bands, beta, factor exposures) and a bound of turnover.  The limits are split: one copy of the weights takes bounds and costs by
name, one takes the linear totals, one the turnover, and each projects in closed form (alternating directions of multipliers).  The step
that makes the copies agree solves a diagonal plus a few columns: work in proportion to names x (factors + totals).

Where each name has a variance of its own, a date takes the shorter way of `by_multipliers`: given a multiplier for each factor and total and
one for the turnover, every weight has a closed form, and Newton steps find these few numbers.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Bounds = tuple[float | None, float | None]
OPTIMAL, INFEASIBLE, INACCURATE = "optimal", "infeasible", "inaccurate"


@dataclass(frozen=True)
class Limits:
    """None switches a limit off.  sector_band: distance of each sector's weight from the benchmark's; max_participation: of a day's
    trade value; the rest by their names."""

    budget: float | None = 1.0
    allow_cash: bool = False
    long_only: bool = True
    max_weight: float | None = None
    sector_band: float | None = None
    beta_bounds: Bounds | None = None
    style_bounds: Mapping[str, Bounds] = field(default_factory=dict)
    max_turnover: float | None = None
    max_participation: float | None = None


@dataclass
class Problem:
    """One cross-section.  Arrays by name but for f (factors x factors); names: those of the columns of x."""

    alpha: np.ndarray
    x: np.ndarray
    f: np.ndarray
    d: np.ndarray
    w_prev: np.ndarray
    names: list[str]
    linear: np.ndarray | float = 0.0
    tilt: np.ndarray | float = 0.0
    impact: np.ndarray | float = 0.0
    sector: np.ndarray | None = None
    benchmark: np.ndarray | None = None
    beta: np.ndarray | None = None
    capacity: np.ndarray | None = None  # a day's trade value over the assets
    no_buy: np.ndarray | None = None
    no_trade: np.ndarray | None = None

    def covariance_times(self, v: np.ndarray) -> np.ndarray:
        return self.x @ (self.f @ (self.x.T @ v)) + self.d * v

    def cost(self, dw: np.ndarray) -> float:
        return float(np.sum(self.linear * np.abs(dw) + self.tilt * dw + self.impact * np.abs(dw) ** 1.5))


@dataclass
class Solution:
    w: np.ndarray
    status: str
    primal: float
    dual: float
    steps: int
    #: multipliers of the bounds and costs by name, of the totals (rows of `totals`) and of the turnover
    y: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _need(value: np.ndarray | None, what: str) -> np.ndarray:
    if value is None:
        raise ValueError(f"this limit needs {what}")
    return value


def by_name(p: Problem, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) weight of each name."""
    n = len(p.alpha)
    lo = np.zeros(n) if limits.long_only else np.full(n, -np.inf)
    hi = np.full(n, np.inf if limits.max_weight is None else limits.max_weight)
    if limits.max_participation is not None:
        most = limits.max_participation * _need(p.capacity, "capacity")
        lo, hi = np.maximum(lo, p.w_prev - most), np.minimum(hi, p.w_prev + most)
    if p.no_buy is not None:
        hi = np.where(p.no_buy, np.minimum(hi, p.w_prev), hi)
    if p.no_trade is not None:
        # out of bounds and not traded: there is no solution
        lo, hi = np.where(p.no_trade, np.maximum(lo, p.w_prev), lo), np.where(p.no_trade, np.minimum(hi, p.w_prev), hi)
    return lo, hi


def totals(p: Problem, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lowest, highest) of the bounded linear totals."""
    rows: list[np.ndarray] = []
    lo: list[float] = []
    hi: list[float] = []

    def add(row: np.ndarray, bounds: Bounds) -> None:
        low, high = (-np.inf if bounds[0] is None else bounds[0]), (np.inf if bounds[1] is None else bounds[1])
        if low > high:
            raise ValueError(f"empty bounds: {bounds}")
        rows.append(row)
        lo.append(low)
        hi.append(high)

    if limits.budget is not None:
        add(np.ones(len(p.alpha)), (None if limits.allow_cash else limits.budget, limits.budget))
    if limits.sector_band is not None:
        sector, benchmark = _need(p.sector, "sector"), _need(p.benchmark, "benchmark")
        for s in pd.unique(pd.Series(sector)):
            row = (sector == s).astype(float)
            add(row, (row @ benchmark - limits.sector_band, row @ benchmark + limits.sector_band))
    if limits.beta_bounds is not None:
        beta = p.beta
        if beta is None:
            b = _need(p.benchmark, "benchmark, or beta")
            beta = p.covariance_times(b) / float(b @ p.covariance_times(b))
        add(beta, limits.beta_bounds)
    for name, bounds in limits.style_bounds.items():
        if name not in p.names:
            raise ValueError(f"unknown factor: {name}")
        add(p.x[:, p.names.index(name)], bounds)
    return np.array(rows).reshape(len(rows), len(p.alpha)), np.array(lo), np.array(hi)


def in_l1_ball(v: np.ndarray, radius: float) -> np.ndarray:
    """The nearest point whose absolute values sum to the radius at most."""
    a = np.abs(v)
    if a.sum() <= radius:
        return v
    s = np.sort(a)[::-1]
    over = (np.cumsum(s) - radius) / np.arange(1, len(s) + 1)
    k = np.flatnonzero(s > over)[-1]
    return np.sign(v) * np.maximum(a - over[k], 0)


def settled(v: np.ndarray, p: Problem, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray | float) -> np.ndarray:
    """argmin weight/2 (w - v)^2 + costs, within the bounds, name by name."""
    u = v - p.w_prev - p.tilt * weight
    rest = np.maximum(np.abs(u) - p.linear * weight, 0)
    half = 0.75 * p.impact * weight
    return np.clip(p.w_prev + np.sign(u) * (np.sqrt(half * half + rest) - half) ** 2, lo, hi)


def _infeasible(dy: tuple[np.ndarray, ...], p: Problem, rows: np.ndarray, bounds: tuple, turnover: float | None, tol: float) -> bool:
    """Whether the change of the multipliers separates the limits: rows'dy is 0 and no point of the limits reaches 0 along dy."""
    size = max(np.abs(x).max(initial=0.0) for x in dy)
    if size < 1e-12:
        return False
    name, total, traded = (x / size for x in dy)
    if np.abs(name + rows.T @ total + traded).max() > tol:
        return False

    def support(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> float:
        y = np.where(np.abs(y) <= tol, 0, y)
        ends = np.where(y > 0, hi, lo)
        return float(np.sum(np.where(y == 0, 0, y * np.where(y == 0, 0, ends))))

    reach = support(name, *bounds[:2]) + support(total, *bounds[2:])
    if turnover is not None:
        reach += float(traded @ p.w_prev) + turnover * float(np.abs(traded).max())
    return reach < -tol


def solve(p: Problem, limits: Limits, risk_aversion: float = 1.0, steps: int = 8000, tol: float = 1e-8) -> Solution:
    """The weights.  Unless the status is optimal they are w_prev: infeasible limits, or residuals still above tol (primal, in weights) and
    1000 tol (dual, with the mean variance as unit) after so many steps."""
    for label, v in (("alpha", p.alpha), ("x", p.x), ("d", p.d), ("w_prev", p.w_prev)):
        if not np.isfinite(v).all():
            raise ValueError(f"{label} has unknown values")
    n = len(p.alpha)
    lo, hi = by_name(p, limits)
    rows, low, high = totals(p, limits)
    if (lo > hi + 1e-12).any():
        return Solution(p.w_prev.copy(), INFEASIBLE, np.inf, np.inf, 0)
    norm = np.sqrt((rows * rows).sum(1))
    norm[norm == 0] = 1.0
    rows, low, high = rows / norm[:, None], low / norm, high / norm
    vals, vecs = np.linalg.eigh((p.f + p.f.T) / 2)
    root = p.x @ (vecs * np.sqrt(np.clip(vals, 0, None)))
    mean = float(np.mean((root * root).sum(1) + p.d))
    unit = 1.0 / (risk_aversion * mean) if mean > 0 else 1.0
    q = Problem(p.alpha * unit, p.x, p.f, p.d, p.w_prev, p.names, p.linear * unit, p.tilt * unit, p.impact * unit)
    root, diag = root * np.sqrt(risk_aversion * unit), p.d * risk_aversion * unit
    turnover = limits.max_turnover
    rho = 1.0
    stiff = np.where(low == high, 100.0, 1.0)

    def factored(rho: float):
        base = diag + rho * (1 if turnover is None else 2)
        u = np.concatenate([root, rows.T * np.sqrt(rho * stiff)], axis=1)
        inner = np.linalg.inv(np.eye(u.shape[1]) + u.T @ (u / base[:, None]))
        return lambda b: (b - u @ (inner @ (u.T @ (b / base)))) / base

    invert = factored(rho)
    a = np.clip(p.w_prev, lo, hi)
    b, c = np.clip(rows @ a, low, high), a - p.w_prev
    ya, yb, yc = np.zeros(n), np.zeros(len(rows)), np.zeros(n)
    primal = dual = np.inf
    relax = 1.6
    for step in range(1, steps + 1):
        rhs = q.alpha + rho * a - ya + rows.T @ (rho * stiff * b - yb)
        if turnover is not None:
            rhs = rhs + rho * (c + p.w_prev) - yc
        w = invert(rhs)
        total = rows @ w
        wa, wb = relax * w + (1 - relax) * a, relax * total + (1 - relax) * b
        was = a, b, c, ya, yb, yc
        a = settled(wa + ya / rho, q, lo, hi, 1 / rho)
        b = np.clip(wb + yb / (rho * stiff), low, high)
        ya, yb = ya + rho * (wa - a), yb + rho * stiff * (wb - b)
        if turnover is not None:
            wc = relax * (w - p.w_prev) + (1 - relax) * c
            c = in_l1_ball(wc + yc / rho, turnover)
            yc = yc + rho * (wc - c)
        if step % 10:
            continue
        primal = max(np.abs(w - a).max(), np.abs((total - b) * norm).max(initial=0.0), 0.0 if turnover is None else np.abs(w - p.w_prev - c).max())
        grad = diag * w + root @ (root.T @ w) - q.alpha + ya + rows.T @ yb + yc
        dual = np.abs(grad).max()
        if primal <= tol and dual <= 1e3 * tol:
            scale = 1 / unit
            return Solution(a, OPTIMAL, float(primal), float(dual), step, (ya * scale, yb * scale / norm, yc * scale))
        if step % 50 == 0:
            changed = (ya - was[3], yb - was[4], yc - was[5])
            if primal > 100 * tol and _infeasible(changed, p, rows, (lo, hi, low, high), turnover, 1e-6):
                return Solution(p.w_prev.copy(), INFEASIBLE, float(primal), float(dual), step)
            big = max(np.abs(w).max(), 1e-12), max(np.abs(q.alpha).max(), np.abs(ya).max(), 1e-12)
            ratio = np.sqrt((primal / big[0]) / max(dual / big[1], 1e-16))
            # more names need it sooner; later seldom, so that the steps settle
            if (step <= 2000 and not 0.5 < ratio < 2) or (step % 100 == 0 and not 0.2 < ratio < 5):
                rho = float(np.clip(rho * ratio, 1e-6, 1e6))
                invert = factored(rho)
    return Solution(p.w_prev.copy(), INACCURATE, float(primal), float(dual), steps)


def _nearest_end(hess: np.ndarray, slope: np.ndarray, start: np.ndarray, bounded: np.ndarray) -> np.ndarray:
    """argmin z'hess z / 2 - slope'z with z >= 0 where bounded: active sets from that of `start` (hess positive definite, start >= 0 there)."""
    z, held = start.copy(), ~bounded | (start > 0)
    for _ in range(20 * len(z)):
        want = np.zeros_like(z)
        want[held] = np.linalg.solve(hess[np.ix_(held, held)], slope[held])
        below = held & bounded & (want < 0)
        if below.any():
            part = z[below] / (z[below] - want[below])
            z = np.where(held, z + part.min() * (want - z), 0.0)
            held[np.flatnonzero(below)[part == part.min()]] = False
            z[~held] = 0.0
            continue
        z = want
        gain = np.where(held, 0.0, (slope - hess @ z) / np.sqrt(np.diag(hess)))
        if gain.max(initial=0.0) <= 1e-13 * np.abs(slope / np.sqrt(np.diag(hess))).max():
            break
        held[np.argmax(gain)] = True
    return z


def _box(p: Problem, limits: Limits, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds by name that turnover and budget imply."""
    if limits.max_turnover is not None:
        lo, hi = np.maximum(lo, p.w_prev - limits.max_turnover), np.minimum(hi, p.w_prev + limits.max_turnover)
    if limits.budget is not None and np.isfinite(lo).all():
        hi = np.minimum(hi, lo + (limits.budget - lo.sum()))
    return lo, hi


def _unreachable(a: np.ndarray, tau: float, reach: float, p: Problem, lo: np.ndarray, hi: np.ndarray) -> bool:
    """Whether no weights within these bounds have a'w + tau |dw| as low as `reach`, which all that keep the totals and the turnover have."""
    size = max(float(np.abs(a).max(initial=0.0)), tau)
    if size == 0:
        return False
    a, tau = a / size, tau / size
    w = np.where(np.abs(a) <= tau + 1e-12, np.clip(p.w_prev, lo, hi), np.where(a > 0, lo, hi))
    return bool(np.isfinite(w).all() and float(a @ w) + tau * float(np.abs(w - p.w_prev).sum()) > reach / size + 1e-7)


def by_multipliers(p: Problem, limits: Limits, risk_aversion: float = 1.0, steps: int = 200, tol: float = 1e-8) -> Solution | None:
    """The weights of `solve` where all d > 0, or None if they are not found so.

    The dual function of the multipliers (factors, totals with a bound above or below, turnover) is concave and smooth, those of inequalities
    are not negative: each step finds the best end of a quadratic model under these signs, and is halved until the function rises.  A step
    costs names x (factors + totals)^2; their number hardly grows with the names.
    """
    if not (p.d > 0).all() or not all(np.isfinite(v).all() for v in (p.alpha, p.x, p.d, p.w_prev)):
        return None
    lo, hi = by_name(p, limits)
    rows, low, high = totals(p, limits)
    if (lo > hi + 1e-12).any():
        return Solution(p.w_prev.copy(), INFEASIBLE, np.inf, np.inf, 0)
    hi = np.maximum(lo, hi)
    norm = np.sqrt((rows * rows).sum(1))
    norm[norm == 0] = 1.0
    rows, low, high = rows / norm[:, None], low / norm, high / norm
    vals, vecs = np.linalg.eigh((p.f + p.f.T) / 2)
    g = np.concatenate([p.x @ (vecs * np.sqrt(np.clip(vals, 0, None))), rows.T], axis=1)
    k, m = p.x.shape[1], len(rows)
    # multipliers: factors, totals held at one value, above, below, turnover
    fixed, above, below = np.flatnonzero(low == high), np.flatnonzero((low < high) & np.isfinite(high)), np.flatnonzero((low < high) & np.isfinite(low))
    turned = int(limits.max_turnover is not None)
    unit = np.eye(k + m + turned)
    to = np.concatenate([unit[:, :k], unit[:, k + fixed], unit[:, k + above], -unit[:, k + below], unit[:, k + m :]], axis=1)
    price = np.concatenate([np.zeros(k), low[fixed], high[above], -low[below], [limits.max_turnover] * turned])
    bounded = np.arange(len(price)) >= k + len(fixed)
    curve = np.where(np.arange(len(price)) < k, 1 / risk_aversion, 0.0)
    own = risk_aversion * p.d
    half = 1.5 * np.broadcast_to(p.impact, own.shape)
    gain = p.alpha - p.tilt

    def moves(over: np.ndarray) -> np.ndarray:
        """How far a name trades for a gain of `over` above its proportional costs."""
        over = np.maximum(over, 0)
        r = 2 * over / np.maximum(half + np.sqrt(half * half + 4 * own * over), 1e-300)
        return r * r

    def at(z: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Minus the dual function, its gradient, the weights, and the gains above the costs of buying and of selling."""
        x = to @ z
        c = gain - g @ x[: k + m]
        e, paid = c - own * p.w_prev, p.linear + (x[-1] if turned else 0.0)
        w = np.clip(p.w_prev + np.sign(e) * moves(np.abs(e) - paid), lo, hi)
        moved = np.abs(w - p.w_prev)
        value = float(np.sum((0.5 * own * w - c) * w + paid * moved + half / 1.5 * moved**1.5)) - 0.5 * float(curve @ (z * z)) - float(price @ z)
        grad = to.T @ np.r_[g.T @ w, [moved.sum()] * turned] - curve * z - price
        return -value, -grad, w, e - paid, -e - paid

    def slopes(buy: np.ndarray, sell: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """How much more is bought and less sold a unit of price, on average within `width` of it."""
        bought = np.clip(p.w_prev + moves(buy + width), lo, hi) - np.clip(p.w_prev + moves(buy - width), lo, hi)
        sold = np.clip(p.w_prev - moves(sell - width), lo, hi) - np.clip(p.w_prev - moves(sell + width), lo, hi)
        return bought / (2 * width), sold / (2 * width)

    def left(z: np.ndarray, grad: np.ndarray) -> float:
        """Largest residual: of a bounded multiplier at 0 only what would raise it."""
        return float(np.abs(np.where(bounded & (z <= 0), np.minimum(grad, 0), grad)).max(initial=0.0))

    most = to.T**2 @ np.r_[(g * g).T @ (1 / own), [np.sum(1 / own)] * turned] + curve
    most[most == 0] = 1.0
    z = np.zeros(len(price))
    value, grad, w, buy, sell = at(z)
    box = _box(p, limits, lo, hi)
    # a few names are between their bounds at one price, many within a step of it: their slopes are averaged over the last one
    widest = float(np.abs(buy).max(initial=0.0)) or 1.0
    width = widest
    damp = 1e-9
    step = 0
    for step in range(1, steps + 1):
        residual = left(z, grad)
        if residual <= 1e-3 * tol:
            break
        if step % 4 == 0:
            x = to @ z
            if _unreachable(rows.T @ x[k : k + m], float(x[-1]) if turned else 0.0, float(price @ z), p, *box):
                return Solution(p.w_prev.copy(), INFEASIBLE, np.inf, np.inf, step)
        more, less = slopes(buy, sell, width)
        both = more + less
        loose = np.flatnonzero(both)
        hess = (g[loose] * both[loose, None]).T @ g[loose]
        if turned:
            side = g[loose].T @ (more - less)[loose]
            hess = np.block([[hess, side[:, None]], [side[None], both.sum()]])
        hess = to.T @ hess @ to + np.diag(curve)
        if not np.isfinite(hess).all():
            return None
        for _ in range(30 if residual > tol else 1):
            model = hess + np.diag(damp * most)
            move = _nearest_end(model, model @ z - grad, z, bounded) - z
            fall, size = float(grad @ move), 1.0
            for _ in range(8):
                new = at(np.where(bounded, np.maximum(z + size * move, 0), z + size * move))
                if new[0] <= value + 1e-4 * size * fall or (new[0] <= value + 1e-13 * abs(value) and left(z + size * move, new[1]) < 0.5 * residual):
                    break
                size /= 2
            else:
                damp = min(max(damp * 30, 1e-9), 1e6)
                continue
            break
        else:
            break
        z = np.where(bounded, np.maximum(z + size * move, 0), z + size * move)
        width = max(float(np.mean(np.abs(new[3] - buy))) / 2, 1e-11 * widest)
        value, grad, w, buy, sell = new
        damp = max(damp / 10, 1e-12) if size == 1 else min(damp * 3, 1e6)
    residual = left(z, grad)
    if not residual <= tol:  # an unknown one neither
        return None
    x = to @ z
    tau = float(x[-1]) if turned else 0.0
    total = x[k : k + m]
    # of what a weight that stays is pushed by, its cost and the turnover take their shares
    pushed = np.where(w == p.w_prev, np.clip((buy - sell) / 2 / np.maximum(p.linear + tau, 1e-300), -1, 1), np.sign(w - p.w_prev))
    traded = tau * pushed
    name = p.alpha - risk_aversion * p.covariance_times(w) - rows.T @ total - traded
    return Solution(w, OPTIMAL, residual, residual, step, (name, total / norm, traded))


OPTIONAL = ("linear", "tilt", "impact", "sector", "benchmark", "beta", "capacity", "no_buy", "no_trade")


def optimize_panel(rows: DataFrame, factors: list[str], factor_cov: np.ndarray, limits: Limits, risk_aversion: float) -> DataFrame:
    """(date, code, w, status, alpha, risk, cost, turnover): the weights of each date, with the figures of its book.

    rows: date, code, alpha, d, w_prev, the factors and those of OPTIONAL that the limits need; a date is a group, as large as a
    cross-section.  Where the status is not optimal nothing is traded.
    """
    extra = [c for c in OPTIONAL if c in rows.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code")
        number = lambda c: pdf[c].to_numpy(float)
        given = {c: pdf[c].to_numpy() if c == "sector" else pdf[c].to_numpy(bool) if c.startswith("no_") else number(c) for c in extra}
        p = Problem(number("alpha"), pdf[factors].to_numpy(float), factor_cov, number("d"), number("w_prev"), list(factors), **given)
        s = by_multipliers(p, limits, risk_aversion) or solve(p, limits, risk_aversion)
        dw = s.w - p.w_prev
        risk = float(np.sqrt(max(s.w @ p.covariance_times(s.w), 0.0)))
        return pd.DataFrame({"date": pdf["date"], "code": pdf["code"], "w": s.w, "status": s.status, "alpha": float(p.alpha @ s.w), "risk": risk, "cost": p.cost(dw), "turnover": float(np.abs(dw).sum())})

    kind = rows.schema["code"].dataType.simpleString()
    columns = ["date", "code", "alpha", "d", "w_prev", *factors, *extra]
    return rows.select(*dict.fromkeys(columns)).groupBy("date").applyInPandas(run, f"date date, code {kind}, w double, status string, alpha double, risk double, cost double, turnover double")

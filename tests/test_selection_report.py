"""Selection reports against pandas, pool by pool."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from quantweft.operators import selection_report as P
from quantweft.operators import windows as X


@pytest.fixture(scope="module")
def pools(spark):
    r = random.Random(3)
    rows = []
    for pool, m in (("many", 240), ("few", 7), (None, 30), ("one", 1), ("thin", 5)):
        for i in range(m):
            score = r.choice([None, math.nan]) if pool == "many" and i % 17 == 3 else round(r.gauss(0, 5) * 4) / 4
            pooled = None if pool == "few" and i % 2 else round(r.gauss(0, 3) * 4) / 4
            rows.append((pool, i, score, pooled, r.randint(1, 8) if pool == "thin" else r.randint(5, 90), "x"))
    rows += [("same", i, 2.0, 2.0, 50, "y") for i in range(4)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "pool string, rule long, score double, pooled double, n long, _score string")


ARGS = (["pool"], "rule", "score", "pooled", "n", 10)


def close(a, b):
    b = None if b is None or (isinstance(b, float) and math.isnan(b)) else b
    return a is b is None or (a is not None and b is not None and a == pytest.approx(b, abs=1e-9))


def test_report(pools):
    got = {r.pool: r.asDict() for r in P.selection_report(pools, *ARGS).collect()}
    frame = pools.toPandas()
    frame["pool"] = frame["pool"].where(frame["pool"].notna(), None)
    assert set(got) == {"many", "few", None, "one", "thin", "same"}
    for pool, r in got.items():
        rows = frame[frame["pool"].isna()] if pool is None else frame[frame["pool"] == pool]
        el = rows[(rows["n"] >= 10) & rows["score"].notna()].sort_values("rule")
        assert (r["n_rows"], r["n_eligible"]) == (len(rows), len(el))
        if len(el) < 2:
            assert all(v is None for k, v in r.items() if k not in ("pool", "n_rows", "n_eligible"))
            continue
        gap, rank = el["score"] - el["pooled"], lambda x: x.rank()
        a = el.loc[el["score"].idxmax()]
        b = el.loc[el["pooled"].idxmax()]
        assert (r["selected"], r["selected_by_pooled"], r["same_selection"]) == (a["rule"], b["rule"], a["rule"] == b["rule"])
        med = el["score"].median()
        with np.errstate(all="ignore"):
            rho = lambda x: rank(el["n"]).corr(rank(x))
            want = {
                "score_mean": el["score"].mean(), "score_median": med, "score_sd": el["score"].std(), "score_max": el["score"].max(), "pooled_mean": el["pooled"].mean(), "pooled_median": el["pooled"].median(), "gap_median": gap.median(), "gap_p90": gap.quantile(0.9),
                "premium_vs_random": a["score"] - el["score"].mean(), "premium_vs_median": a["score"] - med, "selected_gap": a["score"] - a["pooled"], "selected_gap_pctile": (gap.dropna() <= a["score"] - a["pooled"]).mean() if a["pooled"] == a["pooled"] else None,
                "rho_n_vs_score": rho(el["score"]), "rho_n_vs_absdev": rho((el["score"] - med).abs()), "rho_n_vs_absgap": rho(gap.abs()) if gap.notna().all() else None,
                "delta_score": b["score"] - a["score"], "delta_pooled": b["pooled"] - a["pooled"], "delta_size": float(b["n"] - a["n"]),
            }
        for k, v in want.items():
            assert close(r[k], v), (pool, k, r[k], v)


def test_quartiles(pools):
    got = {(r.pool, r.quartile): r for r in P.size_quartiles(pools, *ARGS).collect()}
    frame = pools.toPandas()
    count = 0
    for pool in ("many", "few", None, "same"):
        rows = frame[frame["pool"].isna()] if pool is None else frame[frame["pool"] == pool]
        el = rows[(rows["n"] >= 10) & rows["score"].notna()]
        cuts = np.quantile(el["n"], [0.25, 0.5, 0.75])
        place = 1 + sum((el["n"] > c).astype(int) for c in cuts)
        for q, part in el.groupby(place):
            r = got[pool, q]
            count += 1
            assert (r.n_lo, r.n_hi, r.k, r.score_max) == (part["n"].min(), part["n"].max(), len(part), part["score"].max())
            assert close(r.score_mean, part["score"].mean()) and close(r.score_sd, part["score"].std()) and close(r.absgap_median, (part["score"] - part["pooled"]).abs().median())
    assert len(got) == count + len([k for k in got if k[0] in ("one", "thin")])
    assert all(k[0] != "one" for k in got)


def test_empty(pools):
    assert not P.selection_report(pools.limit(0), *ARGS).collect() and not P.size_quartiles(pools.limit(0), *ARGS).collect()


def test_correlation_without_spread(spark):
    """A group whose values are all equal has no correlation; it must not end the job."""
    rows = [(d, c, 1.0 if d == 1 else float(c), float((c * 7 + d) % 11)) for d in (1, 2, 3) for c in range(30)]
    df = spark.createDataFrame(rows, "date int, code int, a double, b double")
    got = {r.date: r.c for r in df.groupBy("date").agg(X.correlation("a", "b").alias("c")).collect()}
    assert got[1] is None
    for d in (2, 3):
        assert got[d] == pytest.approx(np.corrcoef([float(c) for c in range(30)], [float((c * 7 + d) % 11) for c in range(30)])[0, 1])
    # pairs with one side unknown do not count
    holes = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, 100.0), (100.0, None)], "a double, b double")
    assert holes.agg(X.correlation("a", "b").alias("c")).first().c == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1])

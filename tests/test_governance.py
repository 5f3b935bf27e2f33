import json
import random
from datetime import date

import numpy as np
import pandas as pd
import pytest

from quantweft.operators import resampling, risk
from quantweft.sources import governance as G


def test_hold_out_opens_once(tmp_path):
    h = G.HoldOut(tmp_path / "hold.json")
    h.check(date(2020, 1, 1), date(2030, 1, 1))
    h.define(date(2024, 1, 1), date(2024, 6, 30))
    with pytest.raises(FileExistsError):
        h.define(date(2024, 1, 1), date(2024, 6, 30))
    h.check(date(2023, 1, 1), date(2023, 12, 31))
    with pytest.raises(PermissionError):
        h.check(date(2024, 6, 30), date(2024, 7, 30))
    h.open("final")
    h.check(date(2024, 6, 30), date(2024, 7, 30))
    with pytest.raises(PermissionError):
        h.open("again")


def test_run_record(tmp_path):
    ledger = tmp_path / "runs.jsonl"
    with G.run_record(ledger, "first", {"a": 1}, tmp_path) as result:
        result["x"] = 2
    with pytest.raises(ZeroDivisionError), G.run_record(ledger, "second", {}, tmp_path):
        1 / 0
    rows = [json.loads(x) for x in ledger.read_text().splitlines()]
    assert [(r["event"], r.get("status")) for r in rows] == [("start", None), ("end", "ok"), ("start", None), ("end", "failed")]
    with pytest.raises(ValueError), G.run_record(ledger, "../x", {}, tmp_path):
        pass


def test_status_table(spark):
    rows = [("r", "a", "d1", "1", "failed"), ("r", "a", "d1", "2", "ok"), ("r", "b", "d2", "1", "ok")]
    out = G.status_table(spark.createDataFrame(rows, "repo string, job string, day string, ts string, status string"), ["d1", "d2"]).orderBy("job").collect()
    assert [tuple(r) for r in out] == [("r", "a", "ok", None), ("r", "b", None, "ok")]


def test_risk_model(spark):
    rng = np.random.default_rng(3)
    n, t = 60, 40
    style, ind, cap = rng.normal(size=n), rng.integers(0, 2, n), rng.uniform(1, 5, n)
    f = rng.normal(size=(t, 2)) * [0.01, 0.02]
    ret = f[:, [0]] + f[:, [1]] * style + rng.normal(size=(t, n)) * 0.005
    pdf = pd.DataFrame([(date.fromordinal(738000 + i), i, j, ret[i, j], cap[j], style[j], str(ind[j])) for i in range(t) for j in range(n)], columns=["date", "t", "code", "ret", "cap", "s", "ind"])
    m = risk.build_risk_model(spark.createDataFrame(pdf), ["s"], "ind", t - 1, 30.0)
    assert m.names[:2] == ["market", "s"] and len(m.codes) == n
    assert m.f[1, 1] == pytest.approx(f[1:, 1].var(), rel=0.6)
    assert np.median(m.d) == pytest.approx(0.005**2, rel=0.4)
    w = rng.random(n)
    assert m.var(w) == pytest.approx(w @ m.cov() @ w) and sum(m.decompose(w).values()) == pytest.approx(m.var(w))


def test_random_entries(spark):
    rng = random.Random(1)
    path = [("a", s, float(rng.randint(10, 20))) for s in sorted(rng.sample(range(200), 60))]
    out = resampling.random_entries(spark.createDataFrame(path, "key string, sec int, price double"), spark.createDataFrame([("a", 1), ("a", 2)], "key string, n_th long"), 15, 20, 7).collect()
    assert len(out) == 40
    price = {s: p for _, s, p in path}
    for r in out:
        later = [s for s in price if s >= r.sec + 15]
        assert r.exit_sec == (min(later) if later else None)
        if later:
            assert r.ret == pytest.approx(price[min(later)] / price[r.sec] - 1)

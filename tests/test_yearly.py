"""A copy by year writes what changed and nothing else."""

from datetime import date
from pathlib import Path

from quantweft.sources.yearly import YearlyCopy


def files(root):
    return {p.relative_to(root): p.stat().st_mtime_ns for p in Path(root).rglob("part-*")}


def years_of(changed):
    return {p.parts[1] for p in changed if p.parts[0] == "rows"}


def test_only_changed_years_are_written(spark, tmp_path):
    root = str(tmp_path / "copy")
    rows = [(c, date(y, m, 1), float(c * y + m)) for c in range(5) for y in (2019, 2020, 2021) for m in (1, 6)] + [(9, None, 1.0)]
    schema = "code int, date date, close double"
    table = lambda r: spark.createDataFrame(r, schema)
    copy = YearlyCopy(spark, root)
    assert copy.stored().count() == 0
    assert copy.refresh(table(rows)) == [0, 2019, 2020, 2021]
    first = files(root)
    assert copy.refresh(table(rows[::-1])) == [] and files(root) == first  # another order is no change
    changed = [(c, d, v + (d == date(2020, 6, 1) and c == 3)) for c, d, v in rows]
    assert copy.refresh(table(changed)) == [2020]
    second = files(root)
    assert years_of(set(first) ^ set(second)) == {"year=2020"}
    assert all(second[p] == t for p, t in first.items() if p in second)
    assert sorted(map(str, copy.read().collect())) == sorted(map(str, table(changed).collect()))
    swapped = [(c, d, v if d else 2.0) for c, d, v in changed]
    assert copy.refresh(table(swapped)) == [0]
    less = [r for r in swapped if r[1] is None or r[1].year != 2019]
    assert copy.refresh(table(less)) == [2019]
    assert copy.read().count() == len(less) and copy.read(2020, 2020).count() == 10
    assert copy.refresh(table(swapped)) == [2019] and copy.read().count() == len(rows)
    plan = copy.read(2021)._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(year#" in plan and "= 2021)], PushedFilters: []" in plan

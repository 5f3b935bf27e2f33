"""Both revisions of the yearly copy come from one aggregation."""

from quantweft.plans import panel_queries as PQ
from quantweft.sources import yearly as Y

SMALL = "/root/testdata/sf0.001"


def test_yearly_copy_aggregates_line_items_once(spark, monkeypatch):
    seen = []
    refresh = Y.YearlyCopy.refresh
    monkeypatch.setattr(Y.YearlyCopy, "refresh", lambda self, table: seen.append(table._jdf.queryExecution().optimizedPlan().toString()) or refresh(self, table))
    PQ.yearly_copy(spark, SMALL)
    assert len(seen) == 2 and not any("l_extendedprice" in x for x in seen)

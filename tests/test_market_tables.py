"""The tables of a market come from one aggregation."""

from quantweft.plans import session_queries as Z

SMALL = "/root/testdata/sf0.001"


def test_market_reads_line_items_once(spark):
    for query in (Z.base_price, Z.session_repair):
        plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_extendedprice" not in plan  # read while the bars were written

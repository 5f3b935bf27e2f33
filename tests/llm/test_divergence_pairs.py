"""The pairs of a term are made in generated code; p is exact on both sides of a long."""

from quantweft.llm import divergence as D


def test_no_lambda_for_pairs(spark):
    rows = [(f"a b c w{i % 3} w{i % 4}", "en", f"s{i % 5}") for i in range(60)]
    audit = D.Audit(spark.createDataFrame(rows, "text string, lang string, source string"))
    plan = audit.pairs()._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(vector" not in plan and plan.count("transform(vector") == 1


def test_p_of_large_counts(spark):
    counts = [0, 7, D.MOST_COUNT - 1, D.MOST_COUNT, 10**12]
    total = 3 * 10**12 + 1
    got = spark.createDataFrame([(n, total) for n in counts], "n long, total long").selectExpr(f"{D._p('n', 'total')} as p").collect()
    assert [r.p for r in got] == [1 + D.SCALE * (n + 1) // total for n in counts]

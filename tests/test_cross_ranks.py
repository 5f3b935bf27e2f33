"""Ranks of values that are equal but for the rounding of their sums."""

from quantweft.operators import order_book as O


def test_sums_that_differ_by_rounding_are_ties(spark):
    rows = [(1, "d", 0, 0.3, 0.0), (1, "d", 1, 0.0, 0.0), (2, "d", 0, 0.1, 0.0), (2, "d", 1, 0.2, 0.0)]
    book = spark.createDataFrame([(*r, None) for r in rows], "code int, day string, slot int, buy double, sell double, mid double")
    got = {(r.code, r.slot): r.value_rank for r in O.cross_ranks(book).collect()}
    assert 0.1 + 0.2 > 0.3
    assert got == {(1, 0): 1, (2, 0): 2, (1, 1): 1, (2, 1): 2}

"""Orders against price levels, first crossings and makers against plain loops."""

import random

import pytest

from quantweft.operators import levels, order_book


@pytest.mark.parametrize(("seed", "tick"), [(1, 1), (2, 5)])
def test_traded_at_like_a_loop(spark, seed, tick):
    rng = random.Random(seed)
    trades = [(c, "2024-01-01", s, rng.randint(90, 90 + 7 * c), float(rng.randint(0, 5)), float(rng.randint(0, 5))) for c in (1, 2, 3) for s in range(40) for _ in range(3)]
    orders = [(rng.randint(1, 4), "2024-01-01", i, rng.choice([1, -1]), rng.randint(80, 130), rng.randint(-5, 45), 0) for i in range(300)]
    orders = [(*o[:6], o[5] + rng.randint(0, 30)) for o in orders]
    got = levels.traded_at(
        spark.createDataFrame(orders, "code int, day string, order_id long, side int, price long, start int, stop int"),
        spark.createDataFrame(trades, "code int, day string, slot int, price long, buy_vol double, sell_vol double"), tick,
    )
    found = {r.order_id: (r.at_level, r.beyond) for r in got.collect()}
    some = 0
    for code, _, i, side, price, start, stop in orders:
        here = beyond = 0.0
        for c, _, s, p, buy, sell in trades:
            if c == code and start < s <= stop:
                gap = (p // tick - price // tick) * side
                here += (sell if side > 0 else buy) * (gap == 0)
                beyond += (sell if side > 0 else buy) * (gap < 0)
        assert found[i] == (here, beyond)
        some += here > 0 and beyond > 0
    assert len(found) == 300 and some > 20


def test_one_level_and_no_trades(spark):
    orders = spark.createDataFrame([(1, "d", 7, 1, 100, 0, 9), (1, "d", 8, -1, 99, 0, 9), (2, "d", 9, 1, 100, 0, 9)], "code int, day string, order_id long, side int, price long, start int, stop int")
    trades = spark.createDataFrame([(1, "d", 3, 100, 2.0, 3.0)], "code int, day string, slot int, price long, buy_vol double, sell_vol double")
    assert {r.order_id: (r.at_level, r.beyond) for r in levels.traded_at(orders, trades).collect()} == {7: (3.0, 0.0), 8: (0.0, 2.0), 9: (0.0, 0.0)}
    assert {r.order_id: r.beyond for r in levels.traded_at(orders, trades.limit(0)).collect()} == {7: 0.0, 8: 0.0, 9: 0.0}


def test_book_quantity(spark):
    grid = spark.createDataFrame([(1, "d", 0, 10, 1, 9, 2, 11, 3, 12, None)], "code int, day string, slot int, bid1 int, bidqty1 int, bid2 int, bidqty2 int, ask1 int, askqty1 int, ask2 int, askqty2 int")
    orders = spark.createDataFrame([(1, "d", 0, 1, 9), (1, "d", 0, 1, 11), (1, "d", 0, -1, 11), (1, "d", 0, -1, 12), (1, "d", 5, 1, 10)], "code int, day string, slot int, side int, price int")
    assert [r.shown for r in levels.book_quantity(orders, grid, 2).orderBy("slot", "side", "price").collect()] == [3, None, 2, None, None]


def test_crossings_like_a_loop(spark):
    rng = random.Random(5)
    path = [None if rng.random() < 0.1 else float(rng.randint(-1, 9)) for _ in range(120)]
    book = spark.createDataFrame([(1, "d", i, b) for i, b in enumerate(path)], "code int, day string, slot int, bid double")
    for within in (1, 7, 60):
        found = {r.slot: r.fill_slot for r in order_book.through_fill(book, within).collect()}
        for t in range(120):
            order = path[t + 1] if t + 1 < 120 else None
            hit = [s for s in range(t + 2, min(120, t + 2 + within)) if order is not None and path[s] is not None and 0 < path[s] < order]
            assert found[t] == (hit[0] if hit else None)

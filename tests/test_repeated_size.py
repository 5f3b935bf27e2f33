"""The most frequent size of windows of any width."""

import numpy as np

from quantweft.operators import order_book as O


def test_repeated_size_of_any_width(spark):
    r = np.random.default_rng(3)
    rows = [(int(c), "d", int(s), int(i), None if v == 4 else float(v) + 0.5, int(side)) for i, (c, s, v, side) in enumerate(zip(r.integers(0, 2, 900), r.integers(0, 2000, 900), r.integers(1, 6, 900), r.integers(0, 2, 900)))]
    ticks = spark.createDataFrame(rows, "code int, day string, sec int, seq long, price double, side int")
    for width in (60, 3_000_000_000):
        got = {(x.code, x.sec): (x.size, x.times) for x in O.repeated_size(ticks, width).collect()}
        want = {}
        for c, s in {(x[0], x[2]) for x in rows if x[5]}:
            seen = [float("inf") if x[4] is None else int(x[4]) for x in rows if x[5] and x[0] == c and s - width < x[2] <= s]
            size = min(set(seen), key=lambda v: (-seen.count(v), v))
            want[c, s] = (None if size == float("inf") else size, seen.count(size))
        assert got == want

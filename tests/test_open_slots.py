"""Open slots of a feature stream: what they keep does not grow with the events, and nothing is lost by it."""

import datetime as dt
from collections import Counter

import numpy as np
import pandas as pd
from test_stream_totals import Handle

from quantweft.streaming import feature_streams as Y

KEY = (1, dt.date(2031, 3, 4))


def events_of(n, slots, seed):
    r = np.random.default_rng(seed)
    quote, px = r.random(n) < 0.3, r.integers(100, 40_000, n).astype(float)
    price = np.where(quote | (r.random(n) < 0.2), np.nan, px)
    kind = lambda x, y: np.where(quote, x, y)
    made = {"sec": r.integers(0, slots * 60, n), "seq": r.permutation(n), "quote": quote, "price": price, "volume": kind(np.nan, r.integers(1, 6, n)), "side": kind(np.nan, r.integers(-1, 2, n)), "strength": kind(np.nan, r.integers(1, 9, n))}
    made |= {"best_bid": kind(np.nan, px - 5), "best_ask": kind(np.nan, px + 5), "bid1": kind(px * (r.random(n) < 0.8), np.nan), "ask1": kind(px + 10, np.nan), **{c: kind(r.integers(1, 50, n), np.nan) for c in Y.EVENT_COLUMNS[-4:]}}
    return pd.DataFrame(made)[Y.EVENT_COLUMNS]


def stream_of(*parts):
    stream = Y.FeatureStream(True, 1440, 60)
    stream.init(Handle())
    for part in parts:
        stream._add(KEY, part)
    return stream


def pieces(events, n):
    return [events.iloc[i::n] for i in range(n)]


def kept(stream):
    return sum(len(x) if isinstance(x, bytes) else 8 for row in stream.open.get() for x in row)


def test_open_slots_are_bounded():
    few, many = (kept(stream_of(events_of(n, 50, 3))) for n in (5_000, 60_000))
    assert many < 1.2 * few
    assert kept(stream_of(events_of(60_000, 50, 3))) == kept(stream_of(iter(pieces(events_of(60_000, 50, 3), 7))))


def test_a_closed_session_keeps_no_ring():
    stream = stream_of(events_of(500, 1440, 4))
    stream._closed(KEY, None, 0, 1440)
    assert stream.ring.get()[0] == 1440 and not any(x for x in stream.ring.get()[3:])


def test_batches_in_any_order_and_repeated_sizes():
    events = events_of(3_000, 1440, 5)
    once = stream_of(events)._closed(KEY, None, 0, 1440)
    mixed = stream_of(*pieces(events.sample(frac=1, random_state=1), 6))
    first = mixed._closed(KEY, None, 0, 900)
    pd.testing.assert_frame_equal(once, pd.concat([first, mixed._closed(KEY, mixed.ring.get(), 900, 1440)], ignore_index=True))
    buys = events[(events["side"] > 0)].sort_values(["sec", "seq"])
    slot = buys["sec"] // 60
    some = 0
    for s in range(1440):
        rows = buys[(slot > s - 10) & (slot <= s)]
        prices = rows["price"].dropna()
        want = 0.0
        if len(rows) > 1 and len(prices):
            volume, times = min(Counter(rows["volume"]).items(), key=lambda x: (-x[1], x[0]))
            want, some = times * volume * prices.iloc[-1], some + 1
        assert once["same_size_val10"].iloc[s] == np.log1p(want)
    assert some > 1000
    trades = events[~events["quote"]]
    value = (trades["price"] * trades["volume"]).where(trades["side"] != 0)
    np.testing.assert_allclose(once["cumval"], value.groupby(trades["sec"] // 60).sum().reindex(range(1440), fill_value=0).cumsum())
    quotes = events[events["quote"]].sort_values(["sec", "seq"]).assign(slot=lambda x: x["sec"] // 60)
    imb = quotes[quotes["bid1"] > 0].groupby("slot").tail(1).set_index("slot").eval("(bid_depth3 - ask_depth3) / (bid_depth3 + ask_depth3)")
    np.testing.assert_allclose(once["imb3"], imb.reindex(range(1440)).ffill())

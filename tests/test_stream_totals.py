"""Running totals of a feature stream that closes its slots in two steps."""

import datetime as dt

import numpy as np
import pandas as pd

from quantweft.streaming import feature_streams as Y


class State:
    """A value or a list, kept here."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if self.value is not None else ()

    def update(self, value):
        self.value = value

    def put(self, values):
        self.value = list(values)

    def appendList(self, values):
        self.value = [*(self.value or []), *values]

    def clear(self):
        self.value = None


class Handle:
    def getListState(self, *_):
        return State()

    getValueState = getListState

    def registerTimer(self, at):
        pass


def closed(events, ends):
    stream = Y.FeatureStream(False, 1440, 60)
    stream.init(Handle())
    key = (1, dt.date(2031, 3, 4))
    stream._add(key, events)
    begin, out = 0, []
    for end in ends:
        out.append(stream._closed(key, stream.ring.get() if stream.ring.exists() else None, begin, end))
        begin = end
    return pd.concat(out)


def test_order_flow_of_the_first_slot_kept(spark):
    r = np.random.default_rng(5)
    n = 1440
    events = pd.DataFrame({c: np.nan for c in Y.EVENT_COLUMNS}, index=range(n))
    events = events.assign(sec=np.arange(n) * 60, seq=np.arange(n), quote=True, bid1=100.0, ask1=r.integers(101, 104, n), bidqty1=r.integers(1, 50, n), askqty1=r.integers(1, 50, n), bid_depth3=1.0, ask_depth3=1.0)
    once, twice = closed(events, [n]), closed(events, [1000, n])
    assert (once["slot"].to_numpy() == twice["slot"].to_numpy()).all()
    np.testing.assert_allclose(twice["ofi"], once["ofi"])
    assert once["ofi"].diff().iloc[1000 - Y.RING] != 0

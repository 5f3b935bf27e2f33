"""The two order-book feature sets (`lob.features_v1`, `lob.features_v2`) of a stream of ticks and quotes, row by row.

State per (code, day): the slots that are still open (a list of parts, one a batch: flows by slot, the rows that are the last of
their slot in some way, and how often each quantity was bought; PART names the packed columns), a ring of the last RING closed
slots with what the longest window needs, and the slot at which output begins.  A part has at most five rows a slot besides the
quantities, however many events there were.  A timer closes each slot when the watermark has passed its end and sets the next, so
empty slots come out too, and events that are late but within the watermark count.  A stream that starts within a session takes the
events so far as its initial state: they fill the ring, and output resumes at the given slot.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quantweft.functions.market import STOCK_BANDS, STOCK_TOP
from quantweft.operators.lob import INPUTS, V1, V2

RING = 640
#: Slots whose buys the repeated size looks at.
SIZES = 10
FLOWS = {"buy": np.add, "sell": np.add, "cnt": np.add, "n_buy": np.add, "max_buy": np.fmax, "buy_hi": np.fmax, "buy_lo": np.fmin}
HELD = [*FLOWS, "buy_last", *INPUTS]
EVENT = (
    "sec int, seq long, quote boolean, price double, volume double, side double, strength double, best_bid double, best_ask double, bid1 double, ask1 double, bidqty1 double, askqty1 double, bid_depth3 double, ask_depth3 double"
)
EVENT_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
#: Columns of the open slots: f_ of a slot, e_ of an event, b_ of a quantity bought in a slot.
PART = {
    "f_slot": "i4", **{f"f_{c}": "f8" for c in FLOWS}, **{f"e_{c}": {"sec": "i4", "seq": "i8", "quote": "?"}.get(c, "f8") for c in EVENT_COLUMNS},
    "b_slot": "i4", "b_volume": "f8", "b_times": "f8",
}
OPEN = ", ".join(f"{c} binary" for c in PART)
STATE = f"next int, c_tot double, c_e double, {', '.join(f'{c} array<double>' for c in HELD)}, b_slot array<double>, b_volume array<double>, b_times array<double>"


def _packed(part: dict[str, np.ndarray]) -> tuple:
    return tuple(part[c].tobytes() for c in PART)


def _unpacked(row: tuple) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(bytes(x), kind) for (c, kind), x in zip(PART.items(), row, strict=True)}


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _lasts(x: dict[str, np.ndarray], unit: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Slots of the events e_, and for each the index of its last trade, trade with a price, buy with a price, quote with both sides
    and quote; -1 where it has none."""
    order = np.lexsort((x["e_seq"], x["e_sec"]))
    slot = x["e_sec"][order] // unit
    at = _begins(slot)
    quote, priced = x["e_quote"], ~np.isnan(x["e_price"])
    kinds = {"trade": ~quote, "priced": ~quote & priced, "bought": ~quote & priced & (x["e_side"] > 0), "valid": quote & (x["e_bid1"] > 0) & (x["e_ask1"] > 0), "quote": quote}
    place = {k: np.maximum.reduceat(np.where(v[order], np.arange(len(order)), -1), at) for k, v in kinds.items()}
    return slot[at], {k: np.where(i >= 0, order[i], -1) for k, i in place.items()}


def merged(parts: list[dict[str, np.ndarray]], unit: int) -> dict[str, np.ndarray]:
    """One part for several: a row of flows a slot, the last rows of each slot, a row a quantity and slot."""
    x = {c: np.concatenate([np.zeros(0, kind), *(p[c] for p in parts)]) for c, kind in PART.items()}
    order = np.argsort(x["f_slot"], kind="stable")
    at = _begins(x["f_slot"][order])
    out = {"f_slot": x["f_slot"][order][at], **{f"f_{c}": how.reduceat(x[f"f_{c}"][order], at) for c, how in FLOWS.items()}}
    kept = np.unique(np.concatenate(list(_lasts(x, unit)[1].values())))
    out |= {c: x[c][kept[kept >= 0]] for c in PART if c.startswith("e_")}
    order = np.lexsort((x["b_volume"], x["b_slot"]))
    at = _begins(x["b_slot"][order], x["b_volume"][order])
    return out | {c: x[c][order][at] for c in ("b_slot", "b_volume")} | {"b_times": np.add.reduceat(x["b_times"][order], at)}


def part_of(events: pd.DataFrame, unit: int) -> dict[str, np.ndarray]:
    known = events.fillna({"seq": np.iinfo("i8").min})
    x = {f"e_{c}": known[c].to_numpy(PART[f"e_{c}"]) for c in EVENT_COLUMNS}
    trade = ~x["e_quote"]
    slot, price, volume, side = (v[trade] for v in (x["e_sec"] // unit, x["e_price"], x["e_volume"], x["e_side"]))
    value, bought, counted = price * volume, side > 0, (side > 0) & ~np.isnan(volume)
    x |= {
        "f_slot": slot, "f_buy": np.where(bought, np.nan_to_num(value), 0.0), "f_sell": np.where(side < 0, np.nan_to_num(value), 0.0), "f_cnt": np.ones(len(slot)), "f_n_buy": bought.astype(float),
        "f_max_buy": np.where(bought, value, np.nan), **{f"f_{c}": np.where(bought, price, np.nan) for c in ("buy_hi", "buy_lo")},
        "b_slot": slot[counted], "b_volume": volume[counted], "b_times": np.ones(counted.sum()),
    }
    return merged([x], unit)


def slot_inputs(part: dict[str, np.ndarray], begin: int, end: int, unit: int) -> dict[str, np.ndarray]:
    """What `lob.slot_inputs` gives for slots begin .. end-1, NaN where it has NULL."""
    out = {c: np.zeros(end - begin) if c in ("buy", "sell", "cnt", "n_buy", "max_buy") else np.full(end - begin, np.nan) for c in HELD}
    for c in FLOWS:
        out[c][part["f_slot"] - begin] = np.nan_to_num(part[f"f_{c}"]) if c == "max_buy" else part[f"f_{c}"]
    slots, last = _lasts(part, unit)
    for kind, columns in (
        ("trade", {"strength": "strength", "bid": "best_bid", "ask": "best_ask"}), ("priced", {"last": "price"}), ("bought", {"buy_last": "price"}),
        ("valid", {"bid": "bid1", "ask": "ask1", **{c: c for c in ("bidqty1", "askqty1", "bid_depth3", "ask_depth3")}}), ("quote", {"bidqty1_raw": "bidqty1", "askqty1_raw": "askqty1"}),
    ):
        some = last[kind] >= 0
        for c, source in columns.items():
            out[c][slots[some] - begin] = part[f"e_{source}"][last[kind][some]]
    return out


def _filled(x: np.ndarray) -> np.ndarray:
    at = np.where(np.isnan(x), -1, np.arange(len(x)))
    at = np.maximum.accumulate(at)
    return np.where(at >= 0, x[np.maximum(at, 0)], np.nan)


def _tick(price: np.ndarray) -> np.ndarray:
    out = np.select([price < bound for bound, _ in STOCK_BANDS], [float(tick) for _, tick in STOCK_BANDS], float(STOCK_TOP))
    return np.where(price > 0, out, 1.0)


class _Columns:
    """Windows over the held slots, the first of which is slot `base`."""

    def __init__(self, held: dict[str, np.ndarray], base: int, c_tot: float, c_e: float):
        self.x = x = {**held}
        self.n, self.slot = len(x["buy"]), base + np.arange(len(x["buy"]))
        for c in ("bid", "ask"):
            x[c] = np.where(x[c] > 0, x[c], np.nan)
        x["mid"], x["tot"], x["burst"] = (x["bid"] + x["ask"]) / 2, x["buy"] + x["sell"], (x["n_buy"] >= 5).astype(float)
        pb, pa, pbq, paq = (self.past(c, 1) for c in ("bid", "ask", "bidqty1", "askqty1"))
        some = lambda test, v: np.where(test, v, 0.0)
        flow = some(x["bid"] >= pb, x["bidqty1"]) - some(x["bid"] <= pb, pbq) - some(x["ask"] <= pa, x["askqty1"]) + some(x["ask"] >= pa, paq)
        x["e"] = np.where(np.isnan(x["bidqty1"] + x["askqty1"] + pbq + paq), 0.0, flow)
        self.c_tot, self.c_e = c_tot + np.cumsum(x["tot"]), c_e + np.cumsum(x["e"])

    def past(self, c: str, k: int) -> np.ndarray:
        return np.concatenate([np.full(min(k, self.n), np.nan), self.x[c][: max(0, self.n - k)]])

    def sum(self, c: str, k: int) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.x[c])])
        i = np.arange(1, self.n + 1)
        return total[i] - total[np.maximum(i - k, 0)]

    def full(self, c: str, k: int) -> np.ndarray:
        return np.where(self.slot >= k - 1, self.sum(c, k), np.nan)

    def top(self, v: np.ndarray, k: int, largest: bool = True) -> np.ndarray:
        r = pd.Series(v).rolling(k, min_periods=1)
        return (r.max() if largest else r.min()).to_numpy()

    def depth(self, a: str, b: str) -> np.ndarray:
        self.x["_half"] = np.nan_to_num((self.x[a] + self.x[b]) / 2)
        return self.sum("_half", 60) / np.minimum(self.slot + 1, 60)

    def v1(self) -> dict[str, np.ndarray]:
        x = self.x
        x["_v600"] = self.full("tot", 600)
        v30 = self.full("tot", 30)
        acc = v30 / (self.past("_v600", 30) / 20 + 1e6)
        bd, ad = x["bid_depth3"], x["ask_depth3"]
        return {
            "acc": acc, "v30": v30, "v600": x["_v600"], "buyshare30": self.full("buy", 30) / (v30 + 1), "buyshare10": self.full("buy", 10) / (self.full("tot", 10) + 1),
            **{f"ret{k}": x["mid"] / self.past("mid", k) - 1 for k in (30, 300)}, "ofi10": self.full("e", 10) / (self.depth("bidqty1", "askqty1") + 1), "imb3": (bd - ad) / (bd + ad),
            "spread_bp": (x["ask"] - x["bid"]) / x["mid"] * 1e4, "strength": x["strength"], **{f"dstr{k}": x["strength"] - self.past("strength", k) for k in (10, 30, 60)},
            "spread_ticks": (x["ask"] - x["bid"]) / _tick(np.where(np.isnan(x["ask"]), 1.0, x["ask"])), "bid": x["bid"], "ask": x["ask"], "bidval1": np.nan_to_num(x["bidqty1"] * x["bid"]),
            "bidval3": np.nan_to_num(bd), "ofi": self.c_e, "mid": x["mid"], "book_ok": ((x["ask"] > x["bid"]) & ~np.isnan(acc)).astype(float),
        }

    def v2(self, repeated: np.ndarray) -> dict[str, np.ndarray]:
        x = self.x
        bp = lambda a, b: (a / b - 1) * 1e4
        sw = np.nan_to_num((x["buy_hi"] - x["buy_lo"]) / _tick(np.maximum(np.where(np.isnan(x["ask"]), 1000.0, x["ask"]), 1.0)))
        depth = self.depth("bidqty1_raw", "askqty1_raw") + 1
        bd, ad, mid, bq, aq = x["bid_depth3"], x["ask_depth3"], x["mid"], x["bidqty1_raw"], x["askqty1_raw"]
        return {
            "sec": self.slot.astype(float), "log_cumval": np.log1p(self.c_tot), "cumval": self.c_tot, "spread_bp": (x["ask"] - x["bid"]) / mid * 1e4, "last": x["last"],
            "dist_lo300": bp(mid, self.top(mid, 300, False)), "dist_hi300": bp(mid, self.top(mid, 300)), "ret300": bp(mid, self.past("mid", 300)), "micro_dev": bp((x["bid"] * aq + x["ask"] * bq) / (bq + aq), mid),
            "same_size_val10": np.log1p(repeated), "imb3": (bd - ad) / (bd + ad), **{c: self.sum("cnt", k) for c, k in (("n_tr1", 1), ("n_tr5", 5), ("n_tr10", 10), ("ntr60", 60))}, "burst_secs10": self.sum("burst", 10),
            **{c: np.log1p(self.sum("buy", k)) for c, k in (("buyval1", 1), ("buyval3", 3), ("buyval10", 10), ("bv30", 30))},
            **{c: np.log1p(self.sum("sell", k)) for c, k in (("sellval1", 1), ("sellval3", 3), ("sellval5", 5), ("sv20", 20), ("sv60", 60))},
            "maxbuy5": np.log1p(self.top(x["max_buy"], 5)), "sweep_ticks1": sw, "sweep_ticks3": self.top(sw, 3), "sweep10": self.top(sw, 10),
            **{c: x["strength"] - self.past("strength", k) for c, k in (("dS2", 2), ("dstr3", 3), ("dstr5", 5))}, **{f"ofiw{k}": self.sum("e", k) / depth for k in (1, 2, 20, 30, 60)},
        }


def repeated_sizes(bought: np.ndarray, columns: _Columns) -> np.ndarray:
    """Of each slot: the most repeated quantity of the buys of the last SIZES slots (ties: the smaller) times its repeats times the last
    price; 0 with fewer than two.  bought: rows (slot, volume, times)."""
    out = np.zeros(columns.n)
    volumes, kind = np.unique(bought[:, 1], return_inverse=True)
    at = (bought[:, 0].astype(int)[:, None] - columns.slot[0] + np.arange(SIZES)).ravel()
    inside = (at >= 0) & (at < columns.n)
    cell, where = np.unique((at * len(volumes) + np.repeat(kind, SIZES))[inside], return_inverse=True)
    if len(cell):
        times = np.bincount(where, np.repeat(bought[:, 2], SIZES)[inside])
        slot, kind = np.divmod(cell, len(volumes))
        order = np.lexsort((kind, -times, slot))
        best = order[np.r_[True, slot[order][1:] != slot[order][:-1]]]
        price = pd.Series(columns.x["buy_last"]).ffill(limit=SIZES - 1).to_numpy()
        out[slot[best]] = np.nan_to_num(times[best] * volumes[kind[best]] * price[slot[best]])
    return np.where(columns.sum("n_buy", SIZES) > 1, out, 0.0)


class FeatureStream(StatefulProcessor):
    def __init__(self, second: bool, slots: int, unit: int):
        self.second, self.slots, self.unit = second, slots, unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)
        self.ring = handle.getValueState("ring", STATE)
        self.resume = handle.getValueState("resume", "slot int")
        self.timer = handle.getValueState("timer", "at long")

    def _end_of(self, day: Any, slot: int) -> int:
        return (calendar.timegm(day.timetuple()) + (slot + 1) * self.unit) * 1000

    def _add(self, key: tuple, rows: pd.DataFrame | Iterator[pd.DataFrame]) -> None:
        first = self.ring.get()[0] if self.ring.exists() else 0
        part = None
        for some in [rows] if isinstance(rows, pd.DataFrame) else rows:
            some = some[(some["sec"] >= first * self.unit) & (some["sec"] < self.slots * self.unit)]
            if len(some):
                fresh = part_of(some, self.unit)
                part = merged([part, fresh], self.unit) if part else fresh
        if part is None:
            return
        self.open.appendList([_packed(part)])
        if not self.timer.exists():
            self._wake(key, first)

    def _wake(self, key: tuple, slot: int) -> None:
        at = self._end_of(key[1], slot)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.resume.update((int(initialState["resume"].max()),))
        self._add(key, initialState)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if not pd.isna(key[0]):  # else a mark of time alone
            self._add(key, rows)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = (timerValues.getCurrentWatermarkInMs() // 1000 - calendar.timegm(key[1].timetuple())) // self.unit
        kept = self.ring.get() if self.ring.exists() else None
        begin, end = (kept[0] if kept else 0), int(min(self.slots, passed))
        if end > begin:
            yield self._closed(key, kept, begin, end)
        if end < self.slots:
            self._wake(key, max(begin, end))

    def _closed(self, key: tuple, kept: tuple | None, begin: int, end: int) -> pd.DataFrame:
        part = merged([_unpacked(row) for row in self.open.get()], self.unit)
        late = {"f": part["f_slot"] >= end, "e": part["e_sec"] >= end * self.unit, "b": part["b_slot"] >= end}
        now = {c: v[~late[c[0]]] for c, v in part.items()}
        self.open.clear()
        if late["f"].any() or late["e"].any():
            self.open.put([_packed({c: v[late[c[0]]] for c, v in part.items()})])
        fresh = slot_inputs(now, begin, end, self.unit)
        old = dict(zip(HELD, (np.array(x, float) for x in kept[3 : 3 + len(HELD)]), strict=True)) if kept else {c: np.zeros(0) for c in HELD}
        held = {c: np.concatenate([old[c], fresh[c]]) for c in HELD}
        for c in INPUTS:
            held[c] = _filled(held[c])
        base = end - len(held["buy"])
        bought = np.column_stack([now["b_slot"], now["b_volume"], now["b_times"]])
        if kept:
            bought = np.concatenate([np.column_stack([np.array(x, float) for x in kept[-3:]]), bought])
        with np.errstate(divide="ignore", invalid="ignore"):
            columns = _Columns({c: v.copy() for c, v in held.items()}, base, *(kept[1:3] if kept else (0.0, 0.0)))
            made = columns.v2(repeated_sizes(bought, columns)) if self.second else columns.v1()
        cut = max(0, len(held["buy"]) - RING)
        # the order flow of the first slot kept counts as passed: without the slot before it comes out as 0 next time
        totals = (float(columns.c_tot[cut - 1]) if cut else kept[1] if kept else 0.0, float(columns.c_e[cut]))
        bought = bought[bought[:, 0] > end - SIZES]
        if end >= self.slots:  # nothing follows: only the slot, against late events
            cut, bought = len(held["buy"]), bought[:0]
        self.ring.update((end, *totals, *(held[c][cut:].tolist() for c in HELD), *(bought[:, j].tolist() for j in range(3))))
        resume = max(begin, self.resume.get()[0] if self.resume.exists() else 0)
        some = slice(len(held["buy"]) - (end - resume), None) if resume < end else slice(0, 0)
        out = pd.DataFrame({c: made[c][some] for c in (V2 if self.second else V1)})
        out.insert(0, "code", key[0])
        out.insert(1, "day", key[1])
        out.insert(2, "slot", np.arange(max(resume, begin), max(end, resume)) if resume < end else np.zeros(0, int))
        return out


def feature_stream(events: DataFrame, second: bool, slots: int, unit: int = 1, delay: str = "2 seconds", history: DataFrame | None = None) -> DataFrame:
    """(code, day, slot, V1 or V2) of a stream of events (code, day, ts and EVENT; a row without a code only moves time on).

    history: (code, day, resume and EVENT), what a session had before the stream: output begins at slot `resume`.  Unknown values are NaN.
    """
    kind = events.schema["code"].dataType.simpleString()
    schema = f"code {kind}, day date, slot int, " + ", ".join(f"`{c}` double" for c in (V2 if second else V1))
    keyed = events.withWatermark("ts", delay).groupBy("code", "day")
    past = None if history is None else history.groupBy("code", "day")
    return keyed.transformWithStateInPandas(FeatureStream(second, slots, unit), schema, "Append", "EventTime", past)

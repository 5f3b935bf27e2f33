"""Limit-order-book features on a gap-free time grid, and simulations over it.

Ticks (code, day, sec, seq, price, side[, volume]) become one row a slot and code: flows, counts, last values.  The grid
holds every slot, empty ones too, so trailing windows are row frames.  Path-dependent simulations that a window cannot
express run as Arrow kernels on one (code, day) group, whose size is that of a session.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.operators import windows as X
from quantweft.operators.selection import exact_quantiles
from quantweft.sources.shapes import r6
from quantweft.sources.staging import written

KEYS = ["code", "day"]


def by_slot() -> W:
    return W.partitionBy(*KEYS).orderBy("slot")


def slot_aggregates(ticks: DataFrame, unit: int = 1) -> DataFrame:
    """(code, day, slot, buy, sell, cnt, n_buy, max_buy, last, lo, hi): one pass, map-side combined.

    The last price is that of the highest (sec, seq), even if NULL.
    """
    value = F.col("price")
    last = F.max(F.struct("sec", "seq", "price"))
    return ticks.groupBy("code", "day", F.floor(F.col("sec") / unit).cast("int").alias("slot")).agg(
        F.sum(F.when(F.col("side") > 0, value).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("side") < 0, value).otherwise(0.0)).alias("sell"),
        F.count(F.lit(1)).alias("cnt"), F.sum((F.col("side") > 0).cast("int")).alias("n_buy"), F.max(F.when(F.col("side") > 0, value)).alias("max_buy"),
        last["price"].alias("last"), F.min("price").alias("lo"), F.max("price").alias("hi"),
    )


def level_trades(ticks: DataFrame, volume: Column, unit: int = 1) -> DataFrame:
    """(code, day, slot, price, buy_vol, sell_vol): trades of no side count on both."""
    return ticks.groupBy("code", "day", F.floor(F.col("sec") / unit).cast("int").alias("slot"), "price").agg(
        F.sum(F.when(F.col("side") >= 0, volume).otherwise(0.0)).alias("buy_vol"), F.sum(F.when(F.col("side") <= 0, volume).otherwise(0.0)).alias("sell_vol")
    )


def slot_grid(ticks: DataFrame, slots: int, unit: int) -> DataFrame:
    """All slots of every (code, day) that has ticks, with the aggregates; flows of empty slots are 0, prices NULL."""
    a = slot_aggregates(ticks, unit)
    frame = a.select(*KEYS).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    g = frame.join(a, [*KEYS, "slot"], "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("buy", "sell")} | {c: F.coalesce(c, F.lit(0)) for c in ("cnt", "n_buy")}
    return g.withColumns(zero)


def with_book(grid: DataFrame, tick: float) -> DataFrame:
    """Adds a filled-forward pseudo book: bid and ask one tick around the last price, sizes from the flows."""
    last = X.fill_forward("last", KEYS, ["slot"])
    g = grid.withColumn("px", last)
    # a price that is not positive is none, but only after filling
    px = F.when(F.col("px") > tick, F.col("px"))
    return g.withColumn("bid", px - tick).withColumn("ask", px + tick).withColumn("mid", px).withColumn("bid_qty", F.col("buy") + 1).withColumn("ask_qty", F.col("sell") + 1)


def order_flow(bid: str = "bid", ask: str = "ask", bid_qty: str = "bid_qty", ask_qty: str = "ask_qty") -> Column:
    """Order flow imbalance of one slot against the one before: 0 at the start and where a size is unknown."""
    w = by_slot()
    pb, pa, pbq, paq = (F.lag(c).over(w) for c in (bid, ask, bid_qty, ask_qty))
    b, a, bq, aq = map(F.col, (bid, ask, bid_qty, ask_qty))
    up = F.when(b > pb, bq).when(b == pb, bq - pbq).otherwise(-pbq)
    down = F.when(a < pa, aq).when(a == pa, aq - paq).otherwise(-paq)
    return F.coalesce(up - down, F.lit(0.0))


def repeated_size(ticks: DataFrame, width: int) -> DataFrame:
    """(code, day, sec, size, times): the most frequent buy size of the last `width` seconds (ties: the smaller); one row a second with buys."""
    buys = ticks.filter("side > 0 and sec is not null").withColumn("size", F.floor(F.col("price")))
    ahead = buys.groupBy(*KEYS, "sec", "size").agg(F.count(F.lit(1)).alias("k"))
    kinds = dict(ahead.dtypes)
    schema = f"code {kinds['code']}, day {kinds['day']}, sec {kinds['sec']}, size long, times long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sec")
        size = [math.inf if unknown else int(v) for v, unknown in zip(pdf["size"], pdf["size"].isna(), strict=True)]
        best = list(most_frequent(pdf["sec"].tolist(), size, pdf["k"].tolist(), width))
        sec, size, times = zip(*best, strict=True)
        known = pd.array([None if v == math.inf else v for v in size], dtype="Int64")
        return pd.DataFrame({"code": pdf["code"].iloc[0], "day": pdf["day"].iloc[0], "sec": sec, "size": known, "times": times})

    return ahead.groupBy(*KEYS).applyInPandas(run, schema)


def most_frequent(sec: list[int], size: list[float], k: list[int], width: int) -> Iterator[tuple[int, float, int]]:
    """(sec, size, times) of each second: the size with the largest sum of k in (sec - width, sec], the smaller of equal ones.

    Rows are in the order of sec, one a second and size.  A heap holds a current entry of each size; an entry that its size has left
    behind is corrected when it comes to the top, so the work of a row does not depend on the width.
    """
    now: dict[float, int] = {}
    heap: list[tuple[int, float]] = []
    old = i = 0
    while i < len(sec):
        at = sec[i]
        while i < len(sec) and sec[i] == at:
            now[size[i]] = now.get(size[i], 0) + k[i]
            heappush(heap, (-now[size[i]], size[i]))
            i += 1
        while sec[old] <= at - width:
            now[size[old]] -= k[old]
            old += 1
        while -heap[0][0] != (times := now[heap[0][1]]):
            # more than now: lowered in its place if it is the size's only one, or left out
            if times:
                heapreplace(heap, (-times, heap[0][1]))
            else:
                heappop(heap)
        yield at, heap[0][1], -heap[0][0]


def cross_ranks(book: DataFrame) -> DataFrame:
    """(code, day, slot, value_rank, return_rank) among codes of a slot, largest first, ties by code; unknown returns last.

    Values that differ by less than half a millionth are equal: sums of doubles depend on the order of the trades.
    """
    w = by_slot()
    cum = F.round(F.sum(F.col("buy") + F.col("sell")).over(w.rowsBetween(X.UP, 0)), 6)
    start = F.first("mid", ignorenulls=True).over(w.rowsBetween(X.UP, 0))
    g = book.withColumn("_c", cum).withColumn("_r", F.coalesce(F.try_divide(F.col("mid"), start) - 1, F.lit(-1e9)))
    rank = lambda c: F.row_number().over(W.partitionBy("day", "slot").orderBy(F.desc(c), "code")).cast("long")
    return g.select(*KEYS, "slot", rank("_c").alias("value_rank"), rank("_r").alias("return_rank"))


def oracle_exits(book: DataFrame, horizon: int, cost: float) -> DataFrame:
    """Adds oracle_long and oracle_short: the best exit of the next `horizon` slots after entering one slot later, less cost."""
    entry_ask, entry_bid = F.lead("ask").over(by_slot()), F.lead("bid").over(by_slot())
    g = X.forward_extreme_blocks(book, "bid", KEYS, "slot", 2, horizon, "best_bid")
    g = X.forward_extreme_blocks(g, "ask", KEYS, "slot", 2, horizon, "best_ask", largest=False)
    return g.withColumn("oracle_long", F.try_divide(F.col("best_bid"), entry_ask) - 1 - cost).withColumn("oracle_short", F.lit(1.0) - F.try_divide(F.col("best_ask"), entry_bid) - cost).drop("best_bid", "best_ask")


def _ahead(within: int, *columns: str) -> Column:
    """The rows t+2 .. t+1+within as an array: one frame, whatever `within` is."""
    return F.collect_list(F.struct("slot", *columns)).over(by_slot().rowsBetween(2, within + 1))


def _below(rows: Column, order: Column) -> Column:
    return F.filter(rows, lambda x: (x["bid"] > 0) & (x["bid"] < order))


def through_fill(book: DataFrame, within: int) -> DataFrame:
    """Adds fill_slot: the first slot of t+2 .. t+1+within whose bid is below the bid at t+1."""
    g = book.withColumn("_order", F.lead("bid").over(by_slot())).withColumn("_ahead", _ahead(within, "bid"))
    return g.withColumn("fill_slot", F.get(_below(F.col("_ahead"), F.col("_order")), F.lit(0))["slot"]).drop("_order", "_ahead")


def ceiling_table(book: DataFrame, horizons: list[int], cost: float) -> DataFrame:
    """(horizon, kind, n, mean, median, p90, positive) of the oracle exits, in basis points.  The book is read once for all horizons, and
    a kind's values are never gathered (`selection`)."""
    g = book.select(*KEYS, "slot", "bid", "ask")
    for h in horizons:
        g = oracle_exits(g, h, cost).withColumnsRenamed({"oracle_long": f"_long{h}", "oracle_short": f"_short{h}"})
    each = ", ".join(f"{h}, '{kind}', _{kind}{h}" for h in horizons for kind in ("long", "short"))
    rows = g.select(F.expr(f"stack({2 * len(horizons)}, {each}) as (horizon, kind, x)")).filter("x is not null").withColumn("x", F.col("x") * 1e4)
    rows = written(rows, "exits")
    x = F.col("x")
    sums = rows.groupBy("horizon", "kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(x)).alias("mean"), r6(F.avg((x > 0).cast("double"))).alias("positive"))
    quantiles = exact_quantiles(rows, ["horizon", "kind"], "x", [0.5, 0.9], stored=True).groupBy("horizon", "kind").agg(*[r6(F.max(F.when(F.col("quantile") == q, F.col("value")))).alias(c) for q, c in ((0.5, "median"), (0.9, "p90"))])
    return sums.join(quantiles, ["horizon", "kind"]).select("horizon", "kind", "n", "mean", "median", "p90", "positive")


def exit_simulation(signals: DataFrame, path: DataFrame, take: float, stop: float, max_hold: int, latency: int = 1) -> DataFrame:
    """(code, day, slot, exit_slot, reason, ret): enter at the ask `latency` slots on; leave at the first slot whose bid takes
    profit (reason 1) or stops the loss (2), profit first, else at the last slot held with a bid (3).

    One Arrow group is a session of a code; its signals step through the path together, and those that have left drop out.
    """

    def simulate(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n = int(right["slot"].max()) + 1 if len(right) else 0
        bid, ask = np.full(n + max_hold + latency + 1, np.nan), np.full(n + max_hold + latency + 1, np.nan)
        bid[right["slot"]], ask[right["slot"]] = right["bid"], right["ask"]
        slot = np.sort(left["slot"].to_numpy())
        slot = slot[slot + latency < n]
        at = slot + latency
        known = ~np.isnan(ask[at])
        slot, at = slot[known], at[known]
        entry = ask[at]
        out, reason, ret = np.full(len(slot), -1), np.full(len(slot), 3), np.full(len(slot), np.nan)
        active = np.arange(len(slot))
        for k in range(1, max_hold + 1):
            active = active[at[active] + k < n]
            if not len(active):
                break
            now = bid[at[active] + k] / entry[active] - 1
            here = ~np.isnan(now)
            seen = active[here]
            out[seen], ret[seen] = at[seen] + k, now[here]
            won, lost = now >= take, now <= -stop
            reason[active[won]], reason[active[lost & ~won]] = 1, 2
            active = active[~(won | lost)]
        held = out >= 0
        return pd.DataFrame({"code": key[0], "day": key[1], "slot": slot[held], "exit_slot": out[held], "reason": reason[held], "ret": ret[held]})

    kinds = f"code {path.schema['code'].dataType.simpleString()}, day date, slot int, exit_slot int, reason int, ret double"
    path = path.select(*KEYS, "slot", "bid", "ask").select(*[F.col(c).alias(c) for c in (*KEYS, "slot", "bid", "ask")])  # both sides may come from one table
    return signals.select(*KEYS, "slot").groupBy(*KEYS).cogroup(path.groupBy(*KEYS)).applyInPandas(simulate, kinds).withColumn("ret", r6("ret"))


def queue_fills(orders: DataFrame, path: DataFrame, model: str = "risk_averse") -> DataFrame:
    """(code, day, order_id, status, fill_slot): limit buys in a queue.  status 0 no market, 1 taken at once, 2 filled, 3 not filled.

    Per slot: a bid through the price fills; trades at the price use up the queue ahead; a smaller book moves the order up
    by `model`: 'risk_averse' only when the book is shorter than the queue, 'prob' in proportion.
    """
    if model not in ("risk_averse", "prob"):
        raise ValueError(f"unknown queue model: {model}")

    def simulate(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("slot")
        # lists: numpy's scalars are slow one at a time
        slot, bid, ask, size, sold = (right[c].tolist() for c in ("slot", "bid", "ask", "bid_qty", "sell_at"))
        out = []
        for o in left.itertuples():
            i = bisect_left(slot, o.slot)
            if i >= len(slot) or math.isnan(bid[i]):
                out.append((*key, o.order_id, 0, None))
                continue
            if o.limit_price >= ask[i]:
                out.append((*key, o.order_id, 1, int(slot[i])))
                continue
            ahead, status, at = (size[i] if o.limit_price == bid[i] else 0.0), 3, None
            for j in range(i + 1, min(len(slot), i + 1 + o.wait)):
                if math.isnan(bid[j]):
                    continue
                if ask[j] <= o.limit_price or bid[j] < o.limit_price:
                    status, at = 2, int(slot[j])
                    break
                if bid[j] == o.limit_price:
                    ahead -= sold[j]
                    if ahead < 0:
                        status, at = 2, int(slot[j])
                        break
                    ahead = min(ahead, size[j]) if model == "risk_averse" else ahead * min(1.0, size[j] / max(size[j - 1], 1e-9))
            out.append((*key, o.order_id, status, at))
        return pd.DataFrame(out, columns=["code", "day", "order_id", "status", "fill_slot"]).astype({"fill_slot": "Int64"})

    path = path.select(*[F.col(c).alias(c) for c in path.columns])  # both sides may come from one table
    kinds = f"code {path.schema['code'].dataType.simpleString()}, day date, order_id long, status int, fill_slot long"
    return orders.groupBy(*KEYS).cogroup(path.groupBy(*KEYS)).applyInPandas(simulate, kinds)


def maker_pessimistic(book: DataFrame, within: int, horizon: int, cost: float) -> DataFrame:
    """Adds maker: buy at the bid of the next slot, filled only when the bid falls below it (`through_fill`), then the best ask of the
    `horizon` slots after the fill, less cost.  NULL without a fill, a price, or a whole horizon."""
    g = X.forward_extreme_blocks(book, "ask", KEYS, "slot", 0, horizon, "_best")
    last = F.max("slot").over(W.partitionBy(*KEYS))
    g = g.withColumn("_best", F.when(F.col("slot") + (horizon - 1) <= last, F.col("_best")))
    w = by_slot()
    # the best exit after a slot travels with it, so that the fill brings it along
    g = g.withColumn("_next", F.lead("_best").over(w)).withColumn("_bid", F.lead("bid").over(w)).withColumn("_ahead", _ahead(within, "bid", "_next"))
    g = g.withColumn("_fill", F.get(_below(F.col("_ahead"), F.col("_bid")), F.lit(0))).withColumn("fill_slot", F.col("_fill.slot")).withColumn("_after", F.col("_fill._next"))
    return g.withColumn("maker", F.when((F.col("_bid") > 0) & (F.col("_after") > 0), F.col("_after") / F.col("_bid") - 1 - cost)).drop("_best", "_next", "_bid", "_ahead", "_fill", "_after")

"""Orders, fills and positions as tables: folds per account key, reconciliation, guards, kill switch, event replay."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_events(quotes: DataFrame | None = None, trades: DataFrame | None = None, bars: DataFrame | None = None) -> DataFrame:
    """One tagged table of events in the order (ts, quote < trade < bar, seq); `seq` is each table's own order."""
    out = None
    for kind, rank, df in (("quote", 0, quotes), ("trade", 1, trades), ("bar", 2, bars)):
        if df is not None:
            tagged = df.withColumn("kind", F.lit(kind)).withColumn("kind_order", F.lit(rank))
            out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no events")
    return out.orderBy("ts", "kind_order", "seq")


def position_fold(fills: DataFrame, commission: str = "0.00015", tax: str = "0.0020") -> DataFrame:
    """(code, seq, qty, avg_price, realized): position after each fill, average price in decimals; selling more than is held raises.

    One code a group; commission of both sides and tax of the sale come off a sale's profit.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        qty, avg, out = 0, Decimal(0), []
        fee, levy = Decimal(commission), Decimal(tax)
        for r in pdf.sort_values("seq").itertuples():
            price, n, pnl = Decimal(str(r.price)), int(r.qty), Decimal(0)
            if r.side == "buy":
                avg = (avg * qty + price * n) / (qty + n)
                qty += n
            elif r.side == "sell":
                if n > qty:
                    raise ValueError(f"sale of {n} with {qty} held: {r.code}")
                pnl = (price - avg) * n - avg * n * fee - price * n * (fee + levy)
                qty -= n
            else:
                raise ValueError(f"unknown side: {r.side}")
            out.append((r.code, r.seq, qty, float(avg) if qty else 0.0, float(pnl)))
        return pd.DataFrame(out, columns=["code", "seq", "qty", "avg_price", "realized"])

    kind = fills.schema["code"].dataType.simpleString()
    return fills.select("code", "seq", "side", "qty", "price").groupBy("code").applyInPandas(fold, f"code {kind}, seq long, qty long, avg_price double, realized double")


def reconcile(book: DataFrame, broker: DataFrame) -> DataFrame:
    """(code, kind, book_qty, broker_qty) where holdings differ: only_book, only_broker, qty_mismatch."""
    b = book.filter("qty > 0").select("code", F.col("qty").alias("book_qty"))
    r = broker.filter("qty > 0").select("code", F.col("qty").alias("broker_qty"))
    both = b.join(r, "code", "full_outer")
    kind = F.when(F.col("broker_qty").isNull(), "only_book").when(F.col("book_qty").isNull(), "only_broker").when(F.col("book_qty") != F.col("broker_qty"), "qty_mismatch")
    return both.withColumn("kind", kind).filter("kind is not null").select("code", "kind", F.coalesce("book_qty", F.lit(0)).cast("long").alias("book_qty"), F.coalesce("broker_qty", F.lit(0)).cast("long").alias("broker_qty"))


def split_fills(fills: DataFrame, own_orders: DataFrame, order_no: Callable[[str], Column]) -> tuple[DataFrame, DataFrame]:
    """(own, foreign) fills, by normalised order number."""
    keyed = fills.withColumn("_k", order_no("ord_no"))
    own = own_orders.select(order_no("ord_no").alias("_k")).distinct()
    return keyed.join(own, "_k", "left_semi").drop("_k"), keyed.join(own, "_k", "left_anti").drop("_k")


def incremental_fills(polls: DataFrame) -> DataFrame:
    """(day, ord_no, seq, new_qty): positive differences of cumulative quantities per order and day."""
    w = W.partitionBy("day", "ord_no").orderBy("seq")
    seen = F.coalesce(F.max("cum_qty").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return polls.withColumn("new_qty", F.col("cum_qty") - seen).filter("new_qty > 0").select("day", "ord_no", "seq", "new_qty")


def guard_reason(code: Column, side: Column, qty: Column, price: Column, ref_price: Column, nth_order: Column, nth_of_code: Column, blocked: list[str], held: Column, allowed: list[str] | None = None, max_qty: int = 10, hard_cap: int = 100, band: float = 0.1, per_day: int = 0, per_code: int = 0) -> Column:
    """Why an order is refused, NULL if it is not.  The order of the tests is part of the contract."""
    out = F.when(code.isNull() | (F.length(code) != 6), "bad_code").when(code.isin(*blocked) if blocked else F.lit(False), "blocked")
    out = out.when((side == "buy") & held, "held")
    if allowed:
        out = out.when(~code.isin(*allowed), "not_allowed")
    out = out.when(qty < 1, "qty_below_one").when(qty > hard_cap, "qty_hard_cap").when(qty > max_qty, "qty_cap").when(price <= 0, "price")
    out = out.when(F.coalesce((ref_price > 0) & (F.abs(price / ref_price - 1) > band + 1e-9), F.lit(False)), "price_band")
    if per_day:
        out = out.when(nth_order > per_day, "orders_per_day")
    if per_code:
        out = out.when(nth_of_code > per_code, "orders_per_code")
    return out


def kill_switch(pnl: DataFrame, loss_limit: float = 0.0, max_losses: int = 0, giveback: float = 0.0, giveback_from: float = 0.0) -> DataFrame:
    """(account, day, seq, realized, reason): after each trade of a day, why trading stops (NULL: it goes on).

    A day's fold as running windows: realised sum, its peak (0 at least), the current run of losses; the first reason
    sticks for the day.  Order of the tests: profit given back, losses in a row, daily loss.
    """
    w = W.partitionBy("account", "day").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    loss = F.col("pnl") < -1e-9
    d = pnl.withColumn("realized", F.sum("pnl").over(w)).withColumn("_island", F.sum((~loss).cast("int")).over(w))
    d = d.withColumn("peak", F.greatest(F.max("realized").over(w), F.lit(0.0)))
    run = F.sum(loss.cast("int")).over(W.partitionBy("account", "day", "_island").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_run", run)
    now = F.lit(None).cast("string")
    rules = []
    if giveback:
        rules.append(((F.col("peak") >= giveback_from) & (F.col("peak") > 0) & (F.col("realized") <= F.col("peak") * giveback), "profit_giveback"))
    if max_losses:
        rules.append((F.col("_run") >= max_losses, "consecutive_losses"))
    if loss_limit:
        rules.append((F.col("realized") <= -abs(loss_limit), "daily_loss"))
    for cond, name in reversed(rules):
        now = F.when(cond, F.lit(name)).otherwise(now)
    d = d.withColumn("_now", now).withColumn("reason", F.first("_now", ignorenulls=True).over(w))
    return d.select("account", "day", "seq", "realized", "reason")


def replay(events: DataFrame, strategy: Callable[[dict, dict], list[tuple[str, int]]], latency: int = 0) -> DataFrame:
    """(account, seq, side, qty, price): fills of a strategy replayed over each account's events, judged from the event after the order.

    strategy(event, state) returns orders ('buy' or 'sell', quantity); they fill at the next quote that comes `latency` or more
    later, whole or not at all.  One account a group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting, state, out = [], {"qty": 0}, []
        for e in pdf.sort_values(["ts", "seq"]).to_dict("records"):
            still = []
            for side, qty, due in waiting:
                if e["ts"] >= due and e["bid"] > 0:
                    if side == "sell" and qty > state["qty"]:
                        continue
                    state["qty"] += qty if side == "buy" else -qty
                    out.append((e["account"], e["seq"], side, qty, e["ask"] if side == "buy" else e["bid"]))
                else:
                    still.append((side, qty, due))
            waiting = still + [(side, qty, e["ts"] + latency) for side, qty in strategy(e, state) or []]
        return pd.DataFrame(out, columns=["account", "seq", "side", "qty", "price"])

    kind = events.schema["account"].dataType.simpleString()
    return events.groupBy("account").applyInPandas(run, f"account {kind}, seq long, side string, qty long, price double")

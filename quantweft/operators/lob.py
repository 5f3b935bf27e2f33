"""Order-flow features on a grid of seconds (or other slots) from ticks and multi-level quotes.

Inputs: ticks (code, day, sec, seq, price, volume, side, strength, best_bid, best_ask) and quotes (code, day, sec, seq, bid1.., bidqty1..,
ask1.., askqty1..).  One row a slot and code; the grid holds every slot.  Sums over trailing windows are differences of running
sums and long extremes come from blocks, so the work of a row does not depend on the width, and one sort by (code, day, slot)
serves all columns.  NULL is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.functions.market import ieee_divide, tick_size_or_one
from quantweft.operators import windows as X

KEYS = ["code", "day"]
INPUTS = ["bid", "ask", "strength", "bidqty1", "askqty1", "bid_depth3", "ask_depth3", "bidqty1_raw", "askqty1_raw", "last"]

V1 = [
    "acc", "v30", "v600", "buyshare30", "buyshare10", "ret30", "ret300", "ofi10", "imb3", "spread_bp", "strength", "dstr10", "dstr30", "dstr60",
    "spread_ticks", "bid", "ask", "bidval1", "bidval3", "ofi", "mid", "book_ok",
]
V2 = [
    "sec", "log_cumval", "spread_bp", "n_tr10", "dist_lo300", "ret300", "same_size_val10", "sweep_ticks3", "dist_hi300", "micro_dev", "imb3", "ntr60", "n_tr5",
    "buyval3", "n_tr1", "burst_secs10", "buyval1", "sv20", "bv30", "buyval10", "sv60", "sellval5", "sellval3", "maxbuy5", "sweep10", "sellval1", "sweep_ticks1",
    "dstr3", "dstr5", "dS2", "ofiw20", "ofiw30", "ofiw60", "ofiw1", "ofiw2", "cumval", "last",
]


def _slot(unit: int) -> Column:
    return F.floor(F.col("sec") / unit).cast("int").alias("slot")


def _by_slot() -> W:
    return W.partitionBy(*KEYS).orderBy("slot")


def book_grid(quotes: DataFrame, slots: int, unit: int = 1, levels: int = 10) -> DataFrame:
    """(code, day, slot, bid1.., bidqty1.., ask1.., askqty1..): the last snapshot with a bid and an ask, carried forward whole.

    A deeper level without a price has no quantity either.
    """
    sides = [(f"{p}{i}", f"{p}qty{i}") for p in ("bid", "ask") for i in range(1, levels + 1)]
    shown = [F.when(F.col(x) > 0, F.col(x)).alias(x) for x, _ in sides] + [F.when(F.col(x) > 0, F.col(q)).alias(q) for x, q in sides]
    valid = quotes.filter("bid1 > 0 and ask1 > 0").groupBy(*KEYS, _slot(unit)).agg(F.max(F.struct("sec", "seq", *shown)).alias("snap"))
    frame = quotes.select(*KEYS).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    grid = frame.join(valid, [*KEYS, "slot"], "left").withColumn("snap", F.last("snap", ignorenulls=True).over(_by_slot().rowsBetween(X.UP, 0)))
    return grid.select(*KEYS, "slot", *[F.col(f"snap.{c}").alias(c) for pair in sides for c in pair])


def slot_inputs(ticks: DataFrame, quotes: DataFrame, slots: int, unit: int = 1) -> DataFrame:
    """The raw inputs of every slot of every (code, day) with ticks: flows (0 where nothing happened) and INPUTS (NULL there).

    bid and ask are those of the slot's last snapshot with both, else of its last tick; the raw sizes are those of its last
    snapshot of any kind.
    """
    value = F.col("price") * F.col("volume")
    bought, sold = F.col("side") > 0, F.col("side") < 0
    trades = ticks.groupBy(*KEYS, _slot(unit)).agg(
        F.sum(F.when(bought, value).otherwise(0.0)).alias("buy"), F.sum(F.when(sold, value).otherwise(0.0)).alias("sell"), F.count(F.lit(1)).alias("cnt"),
        F.sum(bought.cast("int")).alias("n_buy"), F.max(F.when(bought, value)).alias("max_buy"), F.max(F.when(bought, F.col("price"))).alias("buy_hi"), F.min(F.when(bought, F.col("price"))).alias("buy_lo"),
        F.max(F.struct("sec", "seq", "strength", "best_bid", "best_ask")).alias("t"), F.max(F.when(F.col("price").isNotNull(), F.struct("sec", "seq", "price")))["price"].alias("last"),
    )
    depth = lambda p: sum(F.coalesce(f"{p}qty{i}", F.lit(0)) for i in (1, 2, 3)) * F.col(f"{p}1")
    book = quotes.groupBy(*KEYS, _slot(unit)).agg(
        F.max(F.when((F.col("bid1") > 0) & (F.col("ask1") > 0), F.struct("sec", "seq", "bid1", "ask1", "bidqty1", "askqty1", depth("bid").alias("bd"), depth("ask").alias("ad")))).alias("q"),
        F.max(F.struct("sec", "seq", "bidqty1", "askqty1")).alias("raw"),
    )
    frame = ticks.select(*KEYS).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    g = frame.join(trades, [*KEYS, "slot"], "left").join(book, [*KEYS, "slot"], "left")
    price = lambda p: F.when(F.col("q").isNotNull(), F.col(f"q.{p}1")).otherwise(F.col(f"t.best_{p}")).cast("double").alias(p)
    flows = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("buy", "sell", "max_buy")] + [F.coalesce(c, F.lit(0)).alias(c) for c in ("cnt", "n_buy")]
    return g.select(
        *KEYS, "slot", *flows, "buy_hi", "buy_lo", price("bid"), price("ask"), F.col("t.strength").alias("strength"),
        *[F.col(x).cast("double").alias(y) for x, y in (("q.bidqty1", "bidqty1"), ("q.askqty1", "askqty1"), ("q.bd", "bid_depth3"), ("q.ad", "ask_depth3"), ("raw.bidqty1", "bidqty1_raw"), ("raw.askqty1", "askqty1_raw"))],
        F.col("last").cast("double").alias("last"),
    )


def _prepared(inputs: DataFrame) -> DataFrame:
    """Filled forward, with mid, order flow e and running sums; prices that are not positive are unknown, but only after filling."""
    w = _by_slot()
    g = inputs.withColumns({c: X.fill_forward(c, KEYS, ["slot"]) for c in INPUTS})
    g = g.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in ("bid", "ask")}).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    b, a, bq, aq = map(F.col, ("bid", "ask", "bidqty1", "askqty1"))
    pb, pa, pbq, paq = (F.lag(c).over(w) for c in ("bid", "ask", "bidqty1", "askqty1"))
    some = lambda test, x: F.when(test, x).otherwise(0.0)
    flow = some(b >= pb, bq) - some(b <= pb, pbq) - some(a <= pa, aq) + some(a >= pa, paq)
    known = bq.isNotNull() & aq.isNotNull() & pbq.isNotNull() & paq.isNotNull()
    g = g.withColumn("e", F.when(known, flow).otherwise(0.0)).withColumn("tot", F.col("buy") + F.col("sell")).withColumn("burst", (F.col("n_buy") >= 5).cast("int"))
    return g.withColumns({f"c_{c}": F.sum(c).over(w.rowsBetween(X.UP, 0)) for c in ("buy", "sell", "tot", "cnt", "e", "burst")})


def _sum(c: str, k: int) -> Column:
    """Of the last k slots, of fewer at the beginning."""
    return F.col(f"c_{c}") - F.coalesce(F.lag(f"c_{c}", k).over(_by_slot()), F.lit(0))


def _full(c: str, k: int) -> Column:
    """Of the last k slots; unknown while there are fewer."""
    return F.when(F.col("slot") >= k - 1, _sum(c, k))


def _past(c: str, k: int) -> Column:
    return F.lag(c, k).over(_by_slot())


def _mean_depth(bid: str, ask: str) -> Column:
    """Mean of half the sizes at the touch over the last 60 slots, unknown ones as 0."""
    half = F.coalesce((F.col(bid) + F.col(ask)) / 2, F.lit(0.0))
    return F.avg(half).over(_by_slot().rowsBetween(-59, 0))


def features_v1(inputs: DataFrame) -> DataFrame:
    """(code, day, slot, V1) of slot_inputs.  Windows of n slots are unknown before slot n - 1."""
    g = _prepared(inputs).withColumn("v30", _full("tot", 30)).withColumn("v600", _full("tot", 600))
    g = g.withColumn("acc", F.col("v30") / (_past("v600", 30) / 20 + 1e6))
    spread = F.col("ask") - F.col("bid")
    out = {
        "buyshare30": _full("buy", 30) / (F.col("v30") + 1), "buyshare10": _full("buy", 10) / (_full("tot", 10) + 1),
        **{f"ret{k}": F.col("mid") / _past("mid", k) - 1 for k in (30, 300)}, "ofi10": _full("e", 10) / (_mean_depth("bidqty1", "askqty1") + 1),
        "imb3": ieee_divide(F.col("bid_depth3") - F.col("ask_depth3"), F.col("bid_depth3") + F.col("ask_depth3")), "spread_bp": spread / F.col("mid") * 1e4,
        **{f"dstr{k}": F.col("strength") - _past("strength", k) for k in (10, 30, 60)}, "spread_ticks": spread / tick_size_or_one(F.coalesce("ask", F.lit(1.0))),
        "bidval1": F.coalesce(F.col("bidqty1") * F.col("bid"), F.lit(0.0)), "bidval3": F.coalesce("bid_depth3", F.lit(0.0)), "ofi": F.col("c_e"),
        "book_ok": F.coalesce((F.col("ask") > F.col("bid")) & F.col("acc").isNotNull(), F.lit(False)).cast("int"),
    }
    return g.select(*KEYS, "slot", *[out[c].alias(c) if c in out else F.col(c) for c in V1])


def same_size(ticks: DataFrame, unit: int = 1, width: int = 10) -> DataFrame:
    """(code, day, slot, same_size_val10): of the buys of the last `width` slots the most repeated quantity (ties: the smaller)
    times its repeats times the last price.  Slots with two such buys or more.  `width` rows a trade, whatever the grid."""
    buys = ticks.filter("side > 0").select(*KEYS, _slot(unit), "sec", "seq", "price", "volume")
    ahead = F.explode(F.sequence(F.col("at"), F.col("at") + width - 1)).alias("slot")
    kinds = buys.groupBy(*KEYS, F.col("slot").alias("at"), "volume").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("sec", "seq", "price")).alias("t"))
    kinds = kinds.select(*KEYS, ahead, "volume", "k", "t").groupBy(*KEYS, "slot", "volume").agg(F.sum("k").alias("k"), F.max("t").alias("t"))
    best = kinds.groupBy(*KEYS, "slot").agg(F.sum("k").alias("n"), F.max(F.struct("k", (-F.col("volume")).alias("v"))).alias("b"), F.max("t").alias("t")).filter("n > 1")
    return best.select(*KEYS, "slot", (F.col("b.k") * -F.col("b.v") * F.col("t.price")).cast("double").alias("same_size_val10"))


def features_v2(inputs: DataFrame, ticks: DataFrame, unit: int = 1) -> DataFrame:
    """(code, day, slot, V2) of slot_inputs and the ticks behind them.  Windows hold what there is at the beginning."""
    w = _by_slot()
    g = _prepared(inputs)
    tick = tick_size_or_one(F.greatest(F.coalesce("ask", F.lit(1000.0)), F.lit(1.0)))
    g = g.withColumn("sw", F.coalesce((F.col("buy_hi") - F.col("buy_lo")) / tick, F.lit(0.0))).withColumn("depth", _mean_depth("bidqty1_raw", "askqty1_raw") + 1)
    g = X.trailing_extreme_blocks(g, "mid", KEYS, "slot", 300, "hi300")
    g = X.trailing_extreme_blocks(g, "mid", KEYS, "slot", 300, "lo300", largest=False)
    g = g.join(same_size(ticks, unit), [*KEYS, "slot"], "left")
    bp = lambda x, y: (ieee_divide(x, y) - 1) * 1e4
    top = lambda c, k: F.max(c).over(w.rowsBetween(1 - k, 0))
    mid = F.col("mid")
    micro = ieee_divide(F.col("bid") * F.col("askqty1_raw") + F.col("ask") * F.col("bidqty1_raw"), F.col("bidqty1_raw") + F.col("askqty1_raw"))
    out = {
        "sec": F.col("slot").cast("double"), "log_cumval": F.log1p("c_tot"), "cumval": F.col("c_tot"), "spread_bp": ieee_divide(F.col("ask") - F.col("bid"), mid) * 1e4,
        "dist_lo300": bp(mid, F.col("lo300")), "dist_hi300": bp(mid, F.col("hi300")), "ret300": bp(mid, _past("mid", 300)), "micro_dev": bp(micro, mid),
        "same_size_val10": F.log1p(F.coalesce("same_size_val10", F.lit(0.0))), "imb3": ieee_divide(F.col("bid_depth3") - F.col("ask_depth3"), F.col("bid_depth3") + F.col("ask_depth3")),
        **{c: _sum("cnt", k).cast("double") for c, k in (("n_tr1", 1), ("n_tr5", 5), ("n_tr10", 10), ("ntr60", 60))}, "burst_secs10": _sum("burst", 10).cast("double"),
        **{c: F.log1p(_sum("buy", k)) for c, k in (("buyval1", 1), ("buyval3", 3), ("buyval10", 10), ("bv30", 30))},
        **{c: F.log1p(_sum("sell", k)) for c, k in (("sellval1", 1), ("sellval3", 3), ("sellval5", 5), ("sv20", 20), ("sv60", 60))},
        "maxbuy5": F.log1p(top("max_buy", 5)), "sweep_ticks1": F.col("sw"), "sweep_ticks3": top("sw", 3), "sweep10": top("sw", 10),
        **{c: F.col("strength") - _past("strength", k) for c, k in (("dS2", 2), ("dstr3", 3), ("dstr5", 5))}, **{f"ofiw{k}": _sum("e", k) / F.col("depth") for k in (1, 2, 20, 30, 60)},
    }
    return g.select(*KEYS, "slot", *[out[c].alias(c) if c in out else F.col(c) for c in V2])

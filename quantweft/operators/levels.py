"""Orders against price levels: what the book shows at an order's price, and what traded there and through it.

The index of trades is sparse in time and price.  Levels of a session (code, day) are numbered from the far side, so that what trades
through an order has smaller numbers; a trade counts in every dyadic range of levels [node << h, (node + 1) << h) that a
question can ask for.  "Below level r" is the union of one range a set bit of r, and the volume of a range between two times is a
difference of running sums.  So a question is a few equality keys, whatever the number of orders and trades: trades and questions
are united and sorted by (range, time) once; no order meets a trade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.operators.windows import UP

KEYS = ["code", "day"]


def book_quantity(orders: DataFrame, grid: DataFrame, levels: int) -> DataFrame:
    """orders (code, day, slot, side, price ..) with `shown`: the quantity at the price on the order's own side of the book of
    its slot; NULL where no visible level has that price.

    grid: (code, day, slot, bid1.., bidqty1.., ask1.., askqty1..)."""

    def at(p: str) -> Column:
        return F.coalesce(*[F.when(F.col(f"{p}{i}") == F.col("price"), F.col(f"{p}qty{i}")) for i in range(1, levels + 1)])

    columns = [f"{p}{q}{i}" for p in ("bid", "ask") for q in ("", "qty") for i in range(1, levels + 1)]
    both = orders.join(grid.select(*KEYS, "slot", *columns), [*KEYS, "slot"], "left")
    return both.withColumn("shown", F.when(F.col("side") > 0, at("bid")).otherwise(at("ask"))).drop(*columns)


def _level(price: str, tick: int) -> Column:
    return F.floor(F.col(price) / tick).cast("long")


def _ranges(level: Column, bits: Column) -> Column:
    """array<struct<h, node>> of the ranges that a trade counts in: all of height 0, above that the even ones."""
    each = F.transform(F.sequence(F.lit(0), bits), lambda h: F.struct(h.alias("h"), F.call_function("shiftright", level, h).alias("node")))
    return F.filter(each, lambda x: (x["h"] == 0) | (x["node"] % 2 == 0))


def _below(level: Column, bits: Column) -> Column:
    """array<struct<h, node>> whose union is the levels 0 .. level - 1."""
    each = F.transform(F.sequence(F.lit(0), bits), lambda h: F.struct(h.alias("h"), F.call_function("shiftright", level, h).alias("node")))
    odd = F.filter(each, lambda x: x["node"] % 2 == 1)
    return F.transform(odd, lambda x: F.struct(x["h"].alias("h"), (x["node"] - 1).alias("node")))


def traded_at(orders: DataFrame, trades: DataFrame, tick: int = 1) -> DataFrame:
    """(order_id, at_level, beyond): volume that traded at the level of an order, and through it, in slots start < slot <= stop.

    orders: (code, day, order_id, side, price, start, stop), side 1 buys: sells at or below its level count, else buys at or above.
    trades: (code, day, slot, price, buy_vol, sell_vol).  An order of a session without trades has 0.
    """
    t = trades.withColumn("_l", _level("price", tick))
    spans = t.groupBy(*KEYS).agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi"))
    # so many bits number the levels of the session and one beyond
    spans = spans.withColumn("_bits", F.ceil(F.log2((F.col("_hi") - F.col("_lo") + 2).cast("double"))).cast("int"))
    sided = F.array(
        F.struct(F.lit(1).alias("side"), (F.col("_l") - F.col("_lo")).alias("rank"), F.col("sell_vol").alias("vol")),
        F.struct(F.lit(-1).alias("side"), (F.col("_hi") - F.col("_l")).alias("rank"), F.col("buy_vol").alias("vol")),
    )
    rows = t.join(spans, KEYS).select(*KEYS, "slot", "_bits", F.explode(F.filter(sided, lambda x: x["vol"] != 0)).alias("s"))
    rows = rows.select(*KEYS, "slot", F.col("s.side").alias("side"), F.col("s.vol").alias("vol"), F.explode(_ranges(F.col("s.rank"), F.col("_bits"))).alias("r"))
    index = rows.groupBy(*KEYS, "side", F.col("r.h").alias("h"), F.col("r.node").alias("node"), "slot").agg(F.sum("vol").alias("vol"))

    side = F.when(F.col("side") > 0, 1).otherwise(-1)
    asked = orders.select(*KEYS, "order_id", side.alias("side"), _level("price", tick).alias("_l"), "start", "stop").join(spans, KEYS)
    rank = F.when(F.col("side") > 0, F.col("_l") - F.col("_lo")).otherwise(F.col("_hi") - F.col("_l"))
    asked = asked.withColumn("rank", F.least(F.greatest(rank, F.lit(0)), F.col("_hi") - F.col("_lo") + 1)).withColumn("known", rank.between(F.lit(0), F.col("_hi") - F.col("_lo")))
    own = F.when(F.col("known"), F.array(F.struct(F.lit(True).alias("here"), F.lit(0).alias("h"), F.col("rank").alias("node")))).otherwise(F.expr("cast(array() as array<struct<here:boolean,h:int,node:bigint>>)"))
    through = F.transform(_below(F.col("rank"), F.col("_bits")), lambda x: F.struct(F.lit(False).alias("here"), x["h"].alias("h"), x["node"].alias("node")))
    asked = asked.select(*KEYS, "order_id", "side", "start", "stop", F.explode(F.concat(own, through)).alias("q"))
    times = F.array(F.struct(F.col("start").alias("slot"), F.lit(-1).alias("sign")), F.struct(F.col("stop").alias("slot"), F.lit(1).alias("sign")))
    asked = asked.select(*KEYS, "order_id", "side", "q.*", F.explode(times).alias("e"))

    nothing = {"order_id": orders.schema["order_id"].dataType, "here": "boolean", "sign": "int"}
    left = index.select(*KEYS, "side", "h", "node", F.col("slot").cast("long").alias("slot"), F.col("vol").cast("double").alias("vol"), *[F.lit(None).cast(k).alias(c) for c, k in nothing.items()])
    right = asked.select(*KEYS, "side", "h", "node", F.col("e.slot").cast("long").alias("slot"), F.lit(0.0).alias("vol"), "order_id", "here", F.col("e.sign").alias("sign"))
    until = F.sum("vol").over(W.partitionBy(*KEYS, "side", "h", "node").orderBy("slot", F.col("sign").isNotNull()).rowsBetween(UP, 0))
    found = left.unionByName(right).withColumn("_sum", until).filter("sign is not null")
    change = F.col("_sum") * F.col("sign")
    sums = found.groupBy("order_id").agg(F.sum(F.when(F.col("here"), change)).alias("at_level"), F.sum(F.when(~F.col("here"), change)).alias("beyond"))
    return orders.select("order_id").join(sums, "order_id", "left").select("order_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("at_level", "beyond")])

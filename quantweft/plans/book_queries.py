"""Queries of the order-book operators over event ticks, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantweft.operators import levels as V
from quantweft.operators import lob as L
from quantweft.operators import order_book as O
from quantweft.operators import windows as X
from quantweft.sources import shapes as S
from quantweft.sources.shapes import r6

TICKS = S.TICKS_SQL
UNIT, SLOTS, TICK = 60, 1440, 0.5


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _book(spark, sf):
    return O.with_book(O.slot_grid(S.ticks(spark, sf), SLOTS, UNIT), TICK)


AGG_SQL = """agg as (select code, day, sec // 60 as slot, sum(case when side > 0 then price else 0 end) as buy, sum(case when side < 0 then price else 0 end) as sell, count(*) as cnt,
  sum((side > 0)::int) as n_buy, max(case when side > 0 then price end) as max_buy, arg_max(price, sec * 100000000::bigint + seq) as last, min(price) as lo, max(price) as hi from tk group by 1, 2, 3)"""
BOOK_SQL = f"""{TICKS}, tk as (select * from ticks), {AGG_SQL},
grid as (select k.code, k.day, s.slot, coalesce(a.buy, 0) as buy, coalesce(a.sell, 0) as sell, coalesce(a.cnt, 0) as cnt, coalesce(a.n_buy, 0) as n_buy, a.max_buy, a.last, a.lo, a.hi
  from (select distinct code, day from agg) k cross join range(0, 1440) s(slot) left join agg a on a.code = k.code and a.day = k.day and a.slot = s.slot),
filled as (select *, last_value(last ignore nulls) over (partition by code, day order by slot) as px from grid),
book as (select *, case when px > 0.5 then px - 0.5 end as bid, case when px > 0.5 then px + 0.5 end as ask, case when px > 0.5 then px end as mid, buy + 1 as bid_qty, sell + 1 as ask_qty from filled)"""
WIN = "window w as (partition by code, day order by slot)"


def second_agg(spark, sf):
    return O.slot_aggregates(S.ticks(spark, sf), UNIT).select("code", "day", "slot", r6("buy").alias("buy"), r6("sell").alias("sell"), "cnt", F.col("n_buy").cast("long").alias("n_buy"), "last", "lo", "hi")


SECOND_SQL = f"with {TICKS}, tk as (select * from ticks), {AGG_SQL} select code, day, slot::int as slot, {_r6('buy')} as buy, {_r6('sell')} as sell, cnt, n_buy::bigint as n_buy, last, lo, hi from agg"


def level_trades(spark, sf):
    t = S.ticks(spark, sf).withColumn("price", F.floor(F.col("price") / 5) * 5)
    return O.level_trades(t, F.lit(1.0), 3600)


LEVEL_SQL = f"with {TICKS} select code, day, (sec // 3600)::int as slot, (floor(price / 5) * 5)::bigint as price, sum((side >= 0)::int)::double as buy_vol, sum((side <= 0)::int)::double as sell_vol from ticks group by 1, 2, 3, 4"


def book_ffill(spark, sf):
    return _book(spark, sf).filter("mid is not null").select("code", "day", "slot", "bid", "ask", "mid")


FFILL_SQL = f"with {BOOK_SQL} select code, day, slot::int as slot, bid, ask, mid from book where mid is not null"


def ofi(spark, sf):
    return _book(spark, sf).select("code", "day", "slot", r6(O.order_flow()).alias("ofi"))


OFI_CASE = "coalesce(case when bid > lag(bid) over w then bid_qty when bid = lag(bid) over w then bid_qty - lag(bid_qty) over w else -lag(bid_qty) over w end - case when ask < lag(ask) over w then ask_qty when ask = lag(ask) over w then ask_qty - lag(ask_qty) over w else -lag(ask_qty) over w end, 0)"
OFI_SQL = f"with {BOOK_SQL} select code, day, slot::int as slot, {_r6(OFI_CASE)} as ofi from book {WIN}"


def _lob(spark, sf):
    return L.slot_inputs(S.lob_ticks(spark, sf), S.lob_quotes(spark, sf), SLOTS, UNIT)


def book_grid(spark, sf):
    return L.book_grid(S.lob_quotes(spark, sf), SLOTS, UNIT, 3)


SIDES = [f"{p}{i}" for p in ("bid", "bidqty", "ask", "askqty") for i in (1, 2, 3)]
GRID_SQL = f"""with {S.LOB_SQL}, v as (select code, day, sec // 60 as slot, {', '.join(f"arg_max(struct_pack(x := case when {c.replace('qty', '')} > 0 then {c} end), sec * 100000000::bigint + seq) as {c}" for c in SIDES)}
  from lq where bid1 > 0 and ask1 > 0 group by 1, 2, 3),
g as (select k.code, k.day, s.slot, {', '.join(f"v.{c}" for c in SIDES)} from (select distinct code, day from lq) k cross join range(0, 1440) s(slot) left join v on v.code = k.code and v.day = k.day and v.slot = s.slot)
select code, day, slot::int as slot, {', '.join(f"(last_value({c} ignore nulls) over w).x as {c}" for c in SIDES)} from g {WIN}"""

#: The grid of inputs, filled forward, with running sums; fields of a slot's last row travel in structs, as one may be NULL.
LOB_BASE = f"""{S.LOB_SQL},
tr as (select code, day, sec // 60 as slot, sum(case when side > 0 then price * volume else 0 end) as buy, sum(case when side < 0 then price * volume else 0 end) as sell, count(*) as cnt, sum((side > 0)::int) as n_buy,
  coalesce(max(case when side > 0 then price * volume end), 0) as max_buy, max(case when side > 0 then price end) as buy_hi, min(case when side > 0 then price end) as buy_lo,
  arg_max(struct_pack(strength := strength, b := best_bid, a := best_ask, p := price), sec * 100000000::bigint + seq) as t from lt group by 1, 2, 3),
qv as (select code, day, sec // 60 as slot, arg_max(struct_pack(b := bid1, a := ask1, bq := bidqty1, aq := askqty1, bd := (bidqty1 + coalesce(bidqty2, 0) + bidqty3) * bid1, ad := (askqty1 + coalesce(askqty2, 0) + askqty3) * ask1), sec * 100000000::bigint + seq) as q
  from lq where bid1 > 0 and ask1 > 0 group by 1, 2, 3),
qr as (select code, day, sec // 60 as slot, arg_max(struct_pack(bq := bidqty1, aq := askqty1), sec * 100000000::bigint + seq) as r from lq group by 1, 2, 3),
i as (select k.code, k.day, s.slot, coalesce(buy, 0)::double as buy, coalesce(sell, 0)::double as sell, coalesce(cnt, 0) as cnt, coalesce(n_buy, 0) as n_buy, coalesce(max_buy, 0) as max_buy, buy_hi, buy_lo,
    case when q is not null then q.b else t.b end as b0, case when q is not null then q.a else t.a end as a0, t.strength as s0, q.bq as bq0, q.aq as aq0, q.bd as bd0, q.ad as ad0, r.bq as br0, r.aq as ar0, t.p as l0
  from (select distinct code, day from lt) k cross join range(0, 1440) s(slot) left join tr on tr.code = k.code and tr.day = k.day and tr.slot = s.slot
  left join qv on qv.code = k.code and qv.day = k.day and qv.slot = s.slot left join qr on qr.code = k.code and qr.day = k.day and qr.slot = s.slot),
f as (select *, {', '.join(f"last_value({x}0 ignore nulls) over w::double as {x}f" for x in ("b", "a"))}, {', '.join(f"last_value({x} ignore nulls) over w::double as {y}" for x, y in (("s0", "strength"), ("bq0", "bq"), ("aq0", "aq"), ("bd0", "bd"), ("ad0", "ad"), ("br0", "br"), ("ar0", "ar"), ("l0", "last")))} from i {WIN}),
m as (select *, case when bf > 0 then bf end as bid, case when af > 0 then af end as ask, (case when bf > 0 then bf end + case when af > 0 then af end) / 2 as mid from f),
e as (select *, case when bq is null or aq is null or lag(bq) over w is null or lag(aq) over w is null then 0 else case when bid >= lag(bid) over w then bq else 0 end - case when bid <= lag(bid) over w then lag(bq) over w else 0 end
  - case when ask <= lag(ask) over w then aq else 0 end + case when ask >= lag(ask) over w then lag(aq) over w else 0 end end as e from m {WIN})"""


def _sum(x: str, k: int) -> str:
    return f"sum({x}) over (partition by code, day order by slot rows {k - 1} preceding)"


def _full(x: str, k: int) -> str:
    return f"case when slot >= {k - 1} then {_sum(x, k)} end"


def _tick_sql(x: str) -> str:
    from quantweft.functions.market import STOCK_BANDS, STOCK_TOP

    return "case " + " ".join(f"when {x} < {bound} then {tick}" for bound, tick in STOCK_BANDS) + f" else {STOCK_TOP} end"


def _rounded(df, names):
    return df.select("code", "day", "slot", *[F.when(F.isnan(F.col(c).cast("double")), None).otherwise(r6(c)).alias(c) for c in names])


def feat_v1(spark, sf):
    return _rounded(L.features_v1(_lob(spark, sf)).filter("acc is not null and ret30 is not null"), L.V1)


_IMB3 = "case when bd + ad = 0 then null else (bd - ad) / (bd + ad) end"
_V1_COLUMNS = {
    "acc": "acc", "v30": "v30", "v600": "v600", "buyshare30": f"{_full('buy', 30)} / (v30 + 1)", "buyshare10": f"{_full('buy', 10)} / ({_full('buy + sell', 10)} + 1)", "ret30": "mid / lag(mid, 30) over w - 1", "ret300": "mid / lag(mid, 300) over w - 1",
    "ofi10": f"{_full('e', 10)} / (avg(coalesce((bq + aq) / 2, 0)) over (partition by code, day order by slot rows 59 preceding) + 1)", "imb3": _IMB3, "spread_bp": "(ask - bid) / mid * 1e4", "strength": "strength",
    **{f"dstr{k}": f"strength - lag(strength, {k}) over w" for k in (10, 30, 60)}, "spread_ticks": f"(ask - bid) / ({_tick_sql('coalesce(ask, 1)')})", "bid": "bid", "ask": "ask", "bidval1": "coalesce(bq * bid, 0)", "bidval3": "coalesce(bd, 0)",
    "ofi": "sum(e) over w", "mid": "mid", "book_ok": "coalesce(ask > bid and acc is not null, false)::int",
}
V1_SQL = f"""with {LOB_BASE}, v as (select *, {_full('buy + sell', 30)} as v30, {_full('buy + sell', 600)} as v600 from e), a as (select *, v30 / (lag(v600, 30) over w / 20 + 1e6) as acc from v {WIN}),
o as (select code, day, slot::int as slot, {', '.join(f"{x} as {c}" for c, x in _V1_COLUMNS.items() if c != "acc")}, acc from a {WIN})
select code, day, slot, {', '.join(f"{_r6(c)} as {c}" for c in _V1_COLUMNS)} from o where acc is not null and ret30 is not null"""


def feat_v2(spark, sf):
    return _rounded(L.features_v2(_lob(spark, sf), S.lob_ticks(spark, sf), UNIT).filter("dist_hi300 is not null"), L.V2)


def _top(x: str, k: int, f: str = "max") -> str:
    return f"{f}({x}) over (partition by code, day order by slot rows {k - 1} preceding)"


_MICRO = "(bid * ar + ask * br) / nullif(br + ar, 0)"
_V2_COLUMNS = {
    "sec": "slot", "log_cumval": "ln(1 + sum(buy + sell) over w)", "spread_bp": "(ask - bid) / mid * 1e4", **{c: _sum("cnt", k) for c, k in (("n_tr1", 1), ("n_tr5", 5), ("n_tr10", 10), ("ntr60", 60))},
    "dist_lo300": f"(mid / {_top('mid', 300, 'min')} - 1) * 1e4", "dist_hi300": f"(mid / {_top('mid', 300)} - 1) * 1e4", "ret300": "(mid / lag(mid, 300) over w - 1) * 1e4", "same_size_val10": "ln(1 + coalesce(same, 0))",
    "sweep_ticks1": "sw", "sweep_ticks3": _top("sw", 3), "sweep10": _top("sw", 10), "micro_dev": f"({_MICRO} / mid - 1) * 1e4", "imb3": _IMB3, "burst_secs10": _sum("(n_buy >= 5)::int", 10), "maxbuy5": f"ln(1 + {_top('max_buy', 5)})",
    **{c: f"ln(1 + {_sum('buy', k)})" for c, k in (("buyval1", 1), ("buyval3", 3), ("buyval10", 10), ("bv30", 30))}, **{c: f"ln(1 + {_sum('sell', k)})" for c, k in (("sellval1", 1), ("sellval3", 3), ("sellval5", 5), ("sv20", 20), ("sv60", 60))},
    **{c: f"strength - lag(strength, {k}) over w" for c, k in (("dS2", 2), ("dstr3", 3), ("dstr5", 5))}, **{f"ofiw{k}": f"{_sum('e', k)} / dep" for k in (1, 2, 20, 30, 60)}, "cumval": "sum(buy + sell) over w", "last": "last",
}
V2_SQL = f"""with {LOB_BASE}, bt as (select code, day, sec // 60 as slot, sec, seq, price, volume from lt where side > 0),
bs as (select distinct code, day, slot + k as slot from bt, range(0, 10) r(k)),
bw as (select bs.code, bs.day, bs.slot, bt.volume, bt.price, bt.sec * 100000000::bigint + bt.seq as ord from bs join bt on bt.code = bs.code and bt.day = bs.day and bt.slot between bs.slot - 9 and bs.slot),
bk as (select code, day, slot, volume, count(*) as k from bw group by all), bl as (select code, day, slot, arg_max(price, ord) as px, count(*) as n from bw group by all),
sm as (select bk.code, bk.day, bk.slot, arg_min(bk.k * bk.volume, -bk.k * 1000000 + bk.volume) * any_value(bl.px) as same from bk join bl on bl.code = bk.code and bl.day = bk.day and bl.slot = bk.slot where bl.n > 1 group by all),
z as (select e.*, sm.same, coalesce((buy_hi - buy_lo) / ({_tick_sql('greatest(coalesce(ask, 1000), 1)')}), 0) as sw, avg(coalesce((br + ar) / 2, 0)) over (partition by e.code, e.day order by e.slot rows 59 preceding) + 1 as dep
  from e left join sm on sm.code = e.code and sm.day = e.day and sm.slot = e.slot),
o as (select code, day, slot::int as slot, {', '.join(f"{x} as {c}" for c, x in _V2_COLUMNS.items())} from z {WIN})
select code, day, slot, {', '.join(f"{_r6(c)} as {c}" for c in _V2_COLUMNS)} from o where dist_hi300 is not null"""


def repeated_size(spark, sf):
    return O.repeated_size(S.ticks(spark, sf), 300)


REPEAT_SQL = f"""with {TICKS}, b as (select code, day, sec, floor(price)::bigint as size from ticks where side > 0), s as (select distinct code, day, sec from b),
c as (select s.code, s.day, s.sec, b.size, count(*) as k from s join b on b.code = s.code and b.day = s.day and b.sec <= s.sec and b.sec > s.sec - 300 group by 1, 2, 3, 4)
select code, day, sec, size, k as times from (select *, row_number() over (partition by code, day, sec order by k desc, size) as rn from c) where rn = 1"""


def cross_ranks(spark, sf):
    return O.cross_ranks(_book(spark, sf))


RANKS_SQL = f"""with {BOOK_SQL}, c as (select code, day, slot, sum(buy + sell) over w as c, coalesce(mid / first_value(mid ignore nulls) over w - 1, -1e9) as r from book {WIN})
select * from (select code, day, slot::int as slot, row_number() over (partition by day, slot order by c desc, code) as value_rank, row_number() over (partition by day, slot order by r desc, code) as return_rank from c)"""


def fwd_extreme(spark, sf):
    b = _book(spark, sf)
    direct = b.withColumn("direct", X.forward_extreme(F.col("mid"), O.KEYS, "slot", 2, 20))
    return X.forward_extreme_blocks(direct, "mid", O.KEYS, "slot", 2, 20, "blocked").select("code", "day", "slot", "direct", "blocked").filter("direct is not null")


FWDX_SQL = f"""with {BOOK_SQL}, x as (select code, day, slot::int as slot, max(mid) over (partition by code, day order by slot rows between 2 following and 21 following) as direct from book) select *, direct as blocked from x where direct is not null"""


def trailing_sums_irregular(spark, sf):
    t = S.ticks(spark, sf).withColumn("v", F.floor("price").cast("long"))
    return t.select("code", "day", "seq", X.trailing_time_sum(F.col("v"), O.KEYS, "sec", ["seq"], 600).alias("value"), X.trailing_time_sum(F.lit(1), O.KEYS, "sec", ["seq"], 600).alias("n"))


TRAIL_SQL = f"""with {TICKS} select a.code, a.day, a.seq, sum(floor(b.price))::bigint as value, count(*) as n from ticks a join ticks b on a.code = b.code and a.day = b.day and b.sec > a.sec - 600 and (b.sec < a.sec or (b.sec = a.sec and b.seq <= a.seq)) group by 1, 2, 3"""


def forward_max_irregular(spark, sf):
    t = S.ticks(spark, sf)
    return t.select("code", "day", "seq", X.forward_time_max(F.col("price"), O.KEYS, "sec", ["seq"], 600).alias("best"))


FMAX_SQL = f"""with {TICKS} select a.code, a.day, a.seq, max(b.price) as best from ticks a left join ticks b on a.code = b.code and a.day = b.day and b.sec <= a.sec + 600 and (b.sec > a.sec or (b.sec = a.sec and b.seq > a.seq)) group by 1, 2, 3"""


def oracle_ceiling(spark, sf):
    o = O.oracle_exits(_book(spark, sf), 15, 0.002)
    return o.select("code", "day", "slot", r6("oracle_long").alias("oracle_long"), r6("oracle_short").alias("oracle_short")).filter("oracle_long is not null")


ORACLE_SQL_ = f"""{BOOK_SQL}, o as (select code, day, slot, max(bid) over (partition by code, day order by slot rows between 2 following and {{h}} following) / lead(ask) over w - 1 - 0.002 as oracle_long,
  1 - min(ask) over (partition by code, day order by slot rows between 2 following and {{h}} following) / lead(bid) over w - 0.002 as oracle_short from book {WIN})"""
CEIL_SQL = f"with {ORACLE_SQL_.format(h=16)} select code, day, slot::int as slot, {_r6('oracle_long')} as oracle_long, {_r6('oracle_short')} as oracle_short from o where oracle_long is not null"


def ceiling_table(spark, sf):
    return O.ceiling_table(_book(spark, sf), [5, 15], 0.002)


CTABLE_SQL = " union all ".join(
    f"select {h}::int as horizon, kind, count(*) as n, {_r6('avg(x * 1e4)')} as mean, {_r6('median(x * 1e4)')} as median, {_r6('quantile_cont(x * 1e4, 0.9)')} as p90, {_r6('avg((x > 0)::int::double)')} as positive from (with {ORACLE_SQL_.format(h=h + 1)} select 'long' as kind, oracle_long as x from o union all select 'short', oracle_short from o) where x is not null group by kind"
    for h in (5, 15)
)


def through_fill(spark, sf):
    return O.through_fill(_book(spark, sf), 8).filter("fill_slot is not null").select("code", "day", "slot", "fill_slot")


THROUGH_SQL = f"""with {BOOK_SQL}, k as (select b.code, b.day, b.slot, min(c.slot) as fill_slot from book b join book a on a.code = b.code and a.day = b.day and a.slot = b.slot + 1 join book c on c.code = b.code and c.day = b.day and c.slot between b.slot + 2 and b.slot + 9 and c.bid > 0 and c.bid < a.bid group by 1, 2, 3)
select code, day, slot::int as slot, fill_slot::int as fill_slot from k"""


def exit_sim(spark, sf):
    b = _book(spark, sf)
    return O.exit_simulation(b.filter("mid is not null"), b, 0.2, 0.2, 30)


EXIT_SQL = f"""with {BOOK_SQL}, s as (select code, day, slot from book where mid is not null), e as (select s.*, b.ask as entry from s join book b on b.code = s.code and b.day = s.day and b.slot = s.slot + 1 where b.ask is not null),
w as (select e.code, e.day, e.slot, b.slot as s, b.bid / e.entry - 1 as ret from e join book b on b.code = e.code and b.day = e.day and b.slot between e.slot + 2 and e.slot + 31 and b.bid is not null),
r as (select *, case when ret >= 0.2 then 1 when ret <= -0.2 then 2 end as reason, max(s) over (partition by code, day, slot) as last from w), p as (select *, row_number() over (partition by code, day, slot order by s) as rn from r where reason is not null or s = last)
select code, day, slot::int as slot, s::int as exit_slot, coalesce(reason, 3)::int as reason, {_r6('ret')} as ret from p where rn = 1"""


def limit_queue(spark, sf):
    b = _book(spark, sf).withColumn("sell_at", F.col("sell"))
    orders = b.select("code", "day", (F.col("code") * 100000 + F.col("slot")).cast("long").alias("order_id"), "slot", F.coalesce("bid", F.lit(0.0)).alias("limit_price"), F.lit(60).alias("wait"))
    return O.queue_fills(orders, b.select("code", "day", "slot", "bid", "ask", "bid_qty", "sell_at"))


WAIT, LEVEL = 120, 25


def order_levels(spark, sf):
    """Each trade as a limit order, every second one at a level of the book: what the book shows there, and what trades at and through
    its level while it waits."""
    grid = book_grid(spark, sf)
    t = S.lob_ticks(spark, sf).filter("side <> 0").withColumn("slot", F.floor(F.col("sec") / UNIT).cast("int"))
    own = F.when(F.col("side") > 0, F.coalesce(*[F.when(F.col("seq") % 6 == 2 * i, F.col(f"bid{i + 1}")) for i in range(3)])).otherwise(F.coalesce(*[F.when(F.col("seq") % 6 == 2 * i, F.col(f"ask{i + 1}")) for i in range(3)]))
    placed = t.select("code", "day", "seq", "side", "slot", F.col("price").alias("last")).join(grid, ["code", "day", "slot"], "left")
    orders = placed.select("code", "day", F.col("seq").alias("order_id"), "side", "slot", F.coalesce(own, F.col("last")).alias("price"), F.col("slot").alias("start"), (F.col("slot") + WAIT).alias("stop"))
    shown = V.book_quantity(orders, grid, 3)
    traded = V.traded_at(orders, O.level_trades(S.lob_ticks(spark, sf), F.col("volume"), UNIT), LEVEL)
    return shown.join(traded, "order_id").select("order_id", "side", "price", F.col("shown").cast("double").alias("shown"), "at_level", "beyond")


ORDER_LEVELS_SQL = f"""with {S.LOB_SQL}, bg as ({GRID_SQL}),
o as (select t.code, t.day, t.seq as order_id, t.side, t.sec // 60 as slot, coalesce(case when t.side > 0 then case t.seq % 6 when 0 then bid1 when 2 then bid2 when 4 then bid3 end else case t.seq % 6 when 0 then ask1 when 2 then ask2 when 4 then ask3 end end, t.price) as price
  from lt t left join bg on bg.code = t.code and bg.day = t.day and bg.slot = t.sec // 60 where t.side <> 0),
q as (select o.*, case when o.side > 0 then case o.price when bid1 then bidqty1 when bid2 then bidqty2 when bid3 then bidqty3 end else case o.price when ask1 then askqty1 when ask2 then askqty2 when ask3 then askqty3 end end as shown
  from o left join bg on bg.code = o.code and bg.day = o.day and bg.slot = o.slot),
v as (select o.order_id, sum(lt.volume) filter (floor(lt.price / {LEVEL}) = floor(o.price / {LEVEL})) as here, sum(lt.volume) filter (floor(lt.price / {LEVEL}) <> floor(o.price / {LEVEL})) as beyond from o join lt on lt.code = o.code and lt.day = o.day
  and lt.sec // 60 > o.slot and lt.sec // 60 <= o.slot + {WAIT} and ((o.side > 0 and lt.side <= 0 and floor(lt.price / {LEVEL}) <= floor(o.price / {LEVEL})) or (o.side < 0 and lt.side >= 0 and floor(lt.price / {LEVEL}) >= floor(o.price / {LEVEL}))) group by 1)
select q.order_id, q.side, q.price, q.shown::double as shown, coalesce(v.here, 0)::double as at_level, coalesce(v.beyond, 0)::double as beyond from q left join v using (order_id)"""


QUERIES = {
    "second_agg": (second_agg, SECOND_SQL, "day"),
    "level_trades": (level_trades, LEVEL_SQL, "day"),
    "book_ffill": (book_ffill, FFILL_SQL, "day"),
    "ofi": (ofi, OFI_SQL, "day"),
    "book_grid": (book_grid, GRID_SQL, "day"),
    "order_levels": (order_levels, ORDER_LEVELS_SQL),
    "feat_v1": (feat_v1, V1_SQL, "day"),
    "feat_v2": (feat_v2, V2_SQL, "day"),
    "repeated_size": (repeated_size, REPEAT_SQL, "day"),
    "cross_ranks": (cross_ranks, RANKS_SQL, "day"),
    "fwd_extreme": (fwd_extreme, FWDX_SQL, "day"),
    "trailing_sums_irregular": (trailing_sums_irregular, TRAIL_SQL, "day"),
    "forward_max_irregular": (forward_max_irregular, FMAX_SQL, "day"),
    "oracle_ceiling": (oracle_ceiling, CEIL_SQL, "day"),
    "ceiling_table": (ceiling_table, CTABLE_SQL),
    "through_fill": (through_fill, THROUGH_SQL, "day"),
    "exit_sim": (exit_sim, EXIT_SQL, "day"),
    "limit_queue": (limit_queue, None, "day"),
}

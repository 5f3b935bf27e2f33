"""Queries of market rules, costs and calendars, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantweft.functions import costs as K
from quantweft.functions import market as M
from quantweft.operators import windows as X
from quantweft.sources import shapes as S

PRICES = "explode(array(0.1D, 1.0D, 7.0D, 31.0D, 173.0D, 599.0D))"
SQL_PRICES = "(select p_partkey, floor(p_retailprice * k) as price from part, unnest([0.1, 1.0, 7.0, 31.0, 173.0, 599.0]) as u(k))"
SQL_TICK = "case when {p} <= 0 then null when {p} < 2000 then 1 when {p} < 5000 then 5 when {p} < 20000 then 10 when {p} < 50000 then 50 when {p} < 200000 then 100 when {p} < 500000 then 500 else 1000 end"


def _prices(spark, sf):
    p = S.table(spark, sf, "part").select("p_partkey", "p_retailprice", F.expr(PRICES).alias("k"))
    return p.select("p_partkey", F.floor(F.col("p_retailprice").cast("double") * F.col("k")).cast("double").alias("price"))


def tick_size_sweep(spark, sf):
    return _prices(spark, sf).select("p_partkey", "price", M.tick_size("price").alias("tick"), M.tick_size("price", fund=True).alias("fund_tick"), M.is_tick_valid("price").alias("valid"))


TICK_SQL = f"""select p_partkey, price::double as price, {SQL_TICK.format(p='price')}::int as tick, (case when price <= 0 then null when price < 2000 then 1 else 5 end)::int as fund_tick,
  coalesce(price > 0 and price % ({SQL_TICK.format(p='price')}) = 0, false) as valid from {SQL_PRICES}"""


def tick_round(spark, sf):
    return _prices(spark, sf).filter("price > 0").select("p_partkey", "price", M.round_to_tick(F.col("price") + 0.5).cast("double").alias("down"), M.round_to_tick_up(F.col("price") + 0.5).cast("double").alias("up"))


TICK_ROUND_SQL = f"""select p_partkey, price::double as price, floor((price + 0.5) / t) * t::double as down, ceil((price + 0.5) / t) * t::double as up
  from (select *, ({SQL_TICK.format(p='(price + 0.5)')})::double as t from {SQL_PRICES} where price > 0)"""


def tick_shift(spark, sf):
    base = M.round_to_tick("price").cast("long")
    p = _prices(spark, sf).select("p_partkey", base.alias("price")).filter("price > 0")
    return p.select("p_partkey", "price", *[M.shift_ticks("price", n).alias(f"by_{'m' if n < 0 else 'p'}{abs(n)}") for n in (-3, -1, 1, 4)])


TICK_SHIFT_SQL = f"""with grid as (select x::bigint as price, row_number() over (order by x) as i from range(1, 1000000) r(x) where x % ({SQL_TICK.format(p='x')}) = 0),
p as (select p_partkey, (floor(price / ({SQL_TICK.format(p='price')})) * ({SQL_TICK.format(p='price')}))::bigint as price from {SQL_PRICES})
select p.p_partkey, p.price, a.price as by_m3, b.price as by_m1, c.price as by_p1, d.price as by_p4
from p join grid g on g.price = p.price left join grid a on a.i = g.i - 3 left join grid b on b.i = g.i - 1 left join grid c on c.i = g.i + 1 left join grid d on d.i = g.i + 4
where p.price > 0"""


def limit_prices(spark, sf):
    p = _prices(spark, sf).filter("price > 0")
    return p.select("p_partkey", "price", M.limit_up("price").alias("up"), M.limit_down("price").alias("down"), M.near_limit_up(F.col("price") * 1.29, "price").alias("near"))


LIMIT_SQL = f"""with p as (select p_partkey, price::double as price, price::double * 1.3::double as raw from {SQL_PRICES} where price > 0),
q as (select *, ({SQL_TICK.format(p='raw')})::double as tu, ({SQL_TICK.format(p='price')})::double as tb from p),
u as (select *, floor(raw / tu + 1e-9::double) * tu as up, price - floor(price * 0.3::double / tb + 1e-9::double) * tb as down from q)
select p_partkey, price, up, down, price * 1.29::double >= up - 3 * ({SQL_TICK.format(p='up')}) as near from u"""


def normalize_codes(spark, sf):
    p = S.table(spark, sf, "part")
    raw = F.expr("concat(case p_partkey % 5 when 0 then 'A' when 1 then ' ' when 2 then 'kx-' when 3 then 'a0' else '' end, cast(p_partkey * 37 as string), case when p_partkey % 7 = 0 then 'e0' else '' end)")
    return p.select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", M.normalize_code("raw").alias("code"), M.is_valid_code(M.normalize_code("raw")).alias("valid"))


CODES_SQL = r"""with r as (select p_partkey, (case p_partkey % 5 when 0 then 'A' when 1 then ' ' when 2 then 'kx-' when 3 then 'a0' else '' end) || (p_partkey * 37)::varchar || (case when p_partkey % 7 = 0 then 'e0' else '' end) as raw from part),
a as (select *, regexp_replace(upper(trim(raw)), '[^A-Z0-9]', '', 'g') as t from r),
b as (select *, case when length(t) = 7 and regexp_matches(t, '^[A-Z]') then t[2:] else t end as u from a),
c as (select *, case when length(u) > 6 then right(u, 6) else u end as v from b),
d as (select *, case when regexp_matches(v, '^[0-9]+$') then lpad(v, 6, '0') else v end as code from c)
select p_partkey, raw, code, regexp_matches(code, '^[0-9A-Z]{6}$') as valid from d"""


def parse_text_fields(spark, sf):
    e = S.table(spark, sf, "orders").select("o_orderkey", F.expr("concat(case o_orderkey % 3 when 0 then '+' when 1 then '-' else '' end, cast(o_orderkey * 13 as string))").alias("raw"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("ord"))
    market = F.element_at(F.array(*map(F.lit, ("거래소", "kosdaq", "코넥스"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return e.select("o_orderkey", M.strip_sign("raw").alias("value"), M.normalize_order_no("ord").alias("ord_no"), M.parse_market(market).alias("market"))


TEXT_SQL = """select o_orderkey, (o_orderkey * 13)::bigint as value, coalesce(nullif(ltrim(lpad(o_orderkey::varchar, 9, '0'), '0'), ''), lpad(o_orderkey::varchar, 9, '0')) as ord_no,
  case o_orderkey % 3 when 0 then 'KOSPI' when 1 then 'KOSDAQ' else 'KONEX' end as market from orders"""

TITLES = ("상장폐지결정", "매매거래정지 (주식분할)", "매매거래정지 (상장적격성 심사)", "매매거래정지 ()", "단일판매공급계약체결", "횡령ㆍ배임혐의발생", "주권매매거래정지해제 (투자자 보호)", "분기보고서", "감사보고서제출 (의견거절)")


def disclosure_severity(spark, sf):
    t = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % len(TITLES) + 1).cast("int"))
    d = S.table(spark, sf, "documents").select("doc_id", t.alias("title"))
    d = d.withColumn("severity", M.title_severity("title"))
    score, conf = (F.col("doc_id") % 21 - 10) / F.lit(10.0), (F.col("doc_id") % 11) / F.lit(10.0)
    return d.select("doc_id", "severity", M.gate_action(F.col("severity"), score, conf, F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, score < 0).alias("action"))


_SQL_LIST = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"
_REASONS = "|".join(M.SEVERE_HALT_REASONS)
_SEVERE = "|".join(M.SEVERE_TITLES)
DISCLOSURE_SQL = f"""with d as (select doc_id, {_SQL_LIST}[doc_id % {len(TITLES)} + 1] as t from documents),
s as (select *, regexp_extract(t, '매매거래정지[^(]*\\((.*)$', 1) as reason, contains(t, '매매거래정지') as halt from d),
h as (select *, case when halt then trim(reason, ' )') = '' or regexp_matches(reason, '{_REASONS}') else regexp_matches(t, '{_SEVERE}') end as hard from s),
g as (select *, (doc_id % 21 - 10) / 10.0::double as score, (doc_id % 11) / 10.0::double as conf from h)
select doc_id, case when hard then 'HARD' else 'UNCLASSIFIED' end as severity,
  case when hard and doc_id % 2 = 0 then 'FORCE_EXIT' when hard or (score < 0 and score <= -0.5 and conf >= 0.6) then (case when doc_id % 3 = 0 then 'REJECT' else 'HALT_ENTRY' end) else 'PASS' end as action from g"""

_MARKET = "case o_custkey % 3 when 0 then 'KOSPI' when 1 then 'KOSDAQ' else 'KONEX' end"
_DATE = "cast(o_orderdate as date) + cast(o_orderkey % 9000 as int)"
_RATE = "case when d < date '2019-06-03' then (case when m = 'KOSPI' then 30 else 30 end) when d < date '2021-01-01' then 25 when d < date '2023-01-01' then 23 when d < date '2024-01-01' then 20 when d < date '2025-01-01' then 18 when d < date '2026-01-01' then 15 else 20 end"


def tax_asof(spark, sf):
    o = S.table(spark, sf, "orders").select("o_orderkey", F.expr("date_add(cast(o_orderdate as date), cast(o_orderkey % 9000 as int))").alias("d"), F.expr(_MARKET).alias("m"))
    return o.select("o_orderkey", "m", K.sell_tax("d", "m").cast("double").alias("rate"), S.r6(K.round_trip_cost("d", "m", slippage=0.001) * 1e4).alias("round_trip_bp"))


TAX_SQL = f"""select o_orderkey, m, ({_RATE}) / 10000.0::double as rate, floor((2 * 0.00015::double + ({_RATE}) / 10000.0::double + 0.002::double) * 1e4 * 1e6 + 0.5) / 1e6 as round_trip_bp
from (select o_orderkey, {_MARKET} as m, {_DATE} as d from orders)"""


def trade_cost_decimal(spark, sf):
    l = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 3).cast("double").alias("price"), F.col("l_quantity").cast("long").alias("qty"), F.expr("case when l_returnflag = 'R' then 'SELL' else 'BUY' end").alias("side"), F.expr("case when l_suppkey % 2 = 0 then 'KOSPI' else 'KOSDAQ' end").alias("market"))
    c = K.trade_cost(F.col("side"), F.col("price"), F.col("qty"), F.col("market"))
    l = l.withColumn("c", c)
    return l.groupBy("side", "market").agg(F.sum("c.fill_price").cast("double").alias("fill"), F.sum("c.commission").cast("double").alias("commission"), F.sum("c.tax").cast("double").alias("tax"))


COST_SQL = f"""with l as (select floor(l_extendedprice * 3)::decimal(20,0) as price, l_quantity::bigint as qty, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side, case when l_suppkey % 2 = 0 then 'KOSPI' else 'KOSDAQ' end as market from lineitem),
f as (select *, (price * (case when side = 'BUY' then 1 else -1 end * case when market = 'KOSDAQ' then 0.0015 else 0.0005 end + 1)::decimal(10,4)) as moved from l),
g as (select *, floor(moved / ({SQL_TICK.format(p='moved')})) * ({SQL_TICK.format(p='moved')}) as fill from f)
select side, market, sum(fill)::double as fill, sum((fill::decimal(20,0) * qty)::decimal(28,0) * 0.00015::decimal(8,5))::double as commission,
  sum(case when side = 'SELL' then (fill::decimal(20,0) * qty)::decimal(28,0) * 0.0020::decimal(8,4) else 0 end)::double as tax from g group by side, market"""


def impact_costs(spark, sf):
    l = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", F.col("l_shipdate").cast("date").alias("d"))
    n, adv, vol = F.col("l_extendedprice").cast("double"), F.col("l_quantity") * 2e6, F.col("l_discount").cast("double")
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    market = F.when(F.col("l_suppkey") % 2 == 0, "KOSPI").otherwise("KOSDAQ")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", S.r6(K.participation(n, adv) * 1e6).alias("share_ppm"), S.r6(K.sqrt_impact_bp(n, adv, vol)).alias("impact_bp"), S.r6(K.trade_cost_bp(side, n, adv, vol, market, F.col("d"), F.lit(3.0))).alias("cost_bp"))


IMPACT_SQL = """with l as (select *, l_extendedprice::double as n, l_quantity * 2e6::double as adv, l_discount::double as vol, cast(l_shipdate as date) as d from lineitem),
c as (select *, vol * sqrt(n / adv) * 1e4::double as imp,
  case when l_returnflag <> 'R' then 0 when d < date '2019-06-03' then 30 when d < date '2021-01-01' then 25 when d < date '2023-01-01' then 23 when d < date '2024-01-01' then 20 when d < date '2025-01-01' then 18 when d < date '2026-01-01' then 15 else 20 end / 10000.0::double as tax from l)
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, floor(n / adv * 1e6 * 1e6 + 0.5) / 1e6 as share_ppm, floor(imp * 1e6 + 0.5) / 1e6 as impact_bp,
  floor(((0.00015::double + tax) * 1e4 + 3.0 + imp) * 1e6 + 0.5) / 1e6 as cost_bp from c"""


def limit_fills(spark, sf):
    b = S.bars(spark, sf)
    limit = F.col("open") * 0.98
    return b.select("code", "date", K.limit_filled("BUY", limit, F.col("low")).alias("buy_through"), K.limit_filled("BUY", F.col("open"), F.col("low"), "touch").alias("buy_touch"), K.limit_filled("SELL", F.col("open") * 1.02, F.col("high")).alias("sell_through"), K.size_multiplier(F.col("trade_value"), 150000.0, 0.5).alias("size"))


FILLS_SQL = f"""with {S.BARS_SQL} select code, date, open * 0.98::double - low > 1e-9 as buy_through, open - low >= -1e-9 as buy_touch, high - open * 1.02::double > 1e-9 as sell_through,
case when trade_value >= 150000 then 1.0::double else 0.5::double end as size from bars"""


def calendar_prev_next(spark, sf):
    days = S.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    cal = S.calendar(spark, sf).filter("idx % 3 <> 1").select("date")
    out = X.next_session(days, "day", cal, strict=True).withColumnRenamed("session", "next_session")
    out = X.next_session(out, "day", cal, strict=False).withColumnRenamed("session", "same_or_next")
    return _with_prev(out, cal)


def _with_prev(days, cal):
    left = days.withColumn("k", F.lit(1))
    out = X.as_of(left, cal.select(F.lit(1).alias("k"), "date", F.col("date").alias("prev_session")), ["k"], "day", "date", ["prev_session"], strict=True)
    return out.drop("k")


CALENDAR_Q_SQL = f"""with {S.CALENDAR_SQL}, c as (select date from calendar where idx % 3 <> 1), d as (select distinct cast(l_shipdate as date) as day from lineitem)
select day, (select min(date) from c where date > day) as next_session, (select min(date) from c where date >= day) as same_or_next, (select max(date) from c where date < day) as prev_session from d"""


def session_flags(spark, sf):
    e = S.table(spark, sf, "events")
    return e.select("event_id", M.in_regular_session("ts").alias("regular"), M.past_cutoff("ts", "14:50").alias("late"), M.past_cutoff("ts", "25:99").alias("malformed"))


SESSION_SQL = """select event_id, dayofweek(ts) between 1 and 5 and hour(ts) * 60 + minute(ts) >= 540 and hour(ts) * 60 + minute(ts) < 930 as regular,
hour(ts) * 60 + minute(ts) >= 890 as late, false as malformed from events"""


def hash_draws(spark, sf):
    return S.table(spark, sf, "orders").select("o_orderkey", M.hash32("o_orderkey").alias("h"))


HASH_SQL = """with a as (select o_orderkey, o_orderkey::hugeint & 4294967295 as v from orders), b as (select o_orderkey, xor(v, v >> 16) as v from a), c as (select o_orderkey, (v * 2146121005) & 4294967295 as v from b),
d as (select o_orderkey, xor(v, v >> 15) as v from c), e as (select o_orderkey, (v * 1540483477) & 4294967295 as v from d) select o_orderkey, xor(v, v >> 16)::bigint as h from e"""

QUERIES = {
    "tick_size_sweep": (tick_size_sweep, TICK_SQL),
    "tick_round": (tick_round, TICK_ROUND_SQL),
    "tick_shift": (tick_shift, TICK_SHIFT_SQL),
    "limit_prices": (limit_prices, LIMIT_SQL),
    "normalize_codes": (normalize_codes, CODES_SQL),
    "parse_text_fields": (parse_text_fields, TEXT_SQL),
    "disclosure_severity": (disclosure_severity, DISCLOSURE_SQL),
    "tax_asof": (tax_asof, TAX_SQL),
    "trade_cost_decimal": (trade_cost_decimal, COST_SQL),
    "impact_costs": (impact_costs, IMPACT_SQL),
    "limit_fills": (limit_fills, FILLS_SQL, "date"),
    "calendar_prev_next": (calendar_prev_next, CALENDAR_Q_SQL, "day next_session same_or_next prev_session"),
    "session_flags": (session_flags, SESSION_SQL),
    "hash_draws": (hash_draws, HASH_SQL),
}

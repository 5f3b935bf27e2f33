"""Queries of tiers, capitalisation, filings, pessimistic makers, histories of specific variance and noise rules; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantweft.operators import cross_section as B
from quantweft.operators import order_book as O
from quantweft.operators import risk as R
from quantweft.operators import search as E
from quantweft.operators import windows as X
from quantweft.plans import book_queries as K
from quantweft.plans import panel_queries as P
from quantweft.sources import shapes as S
from quantweft.sources.shapes import r6


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def cap_tier(spark, sf):
    p = P.panel(spark, sf)
    return B.cap_tier(p, "trade_value", 5, 30, F.col("signal").isNotNull()).filter("in_tier").select("code", "date")


TIER_SQL = f"""with {P.PANEL_SQL}, r as (select code, date, row_number() over (partition by date order by trade_value desc, code) - 1 as place from panel where signal is not null and trade_value is not null)
select code, date from r where place >= 5 and place < 30"""


def capitalisation(spark, sf):
    p = P.panel(spark, sf).withColumn("shares", F.lit(100.0) + F.col("code") % 7).withColumn("raw", F.when(F.col("t") % 3 == 0, F.col("close")))
    return p.withColumn("cap", B.capitalisation(p, "shares", ["raw", "close"])).filter("cap is not null").select("code", "date", r6("cap").alias("cap"))


CAP_SQL = f"""with {P.PANEL_SQL}, c as (select code, date, (100.0 + code % 7)::double * coalesce(close, last_value(close ignore nulls) over (partition by code order by t rows between unbounded preceding and 1 preceding)) as cap from panel)
select code, date, {_r6('cap')} as cap from c where cap is not null"""


def earnings_known(spark, sf):
    o = S.table(spark, sf, "orders")
    period = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    code = (F.col("o_custkey") % 200).alias("code")
    e = o.groupBy(code, period.alias("period")).agg(F.max("o_orderdate").cast("date").alias("avail_date"), F.sum("o_totalprice").alias("netinc"), F.max(F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))).alias("netinc_prior"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "periodic").otherwise("other")
    f = o.select(code, period.alias("period"), kind.alias("kind"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("rcept_dt"))
    return B.earnings_known(e, f, "1997-06-30").select("code", "period", "known", r6("netinc").alias("netinc"), r6("netinc_prior").alias("netinc_prior"))


EARN_SQL = f"""with o as (select o_custkey % 200 as code, year(o_orderdate) || 'Q' || quarter(o_orderdate) as period, o_orderdate::date as day, o_orderkey, o_totalprice from orders),
e as (select code, period, max(day) as avail, sum(o_totalprice) as netinc, max(case when o_orderkey % 5 = 0 then 'nan'::double else o_totalprice end) as prior from o group by 1, 2), f as (select code, period, min(day + 30) as filed from o where o_orderkey % 3 = 0 group by 1, 2),
k as (select e.code, e.period, greatest(avail, coalesce(filed, avail)) as known, netinc, case when not isnan(prior) then prior end as prior from e left join f on f.code = e.code and f.period = e.period)
select code, period, known, {_r6('netinc')} as netinc, {_r6('prior')} as netinc_prior from k where known <= date '1997-06-30'"""


def maker_pessimistic(spark, sf):
    return O.maker_pessimistic(K._book(spark, sf), 8, 30, 0.002).filter("maker is not null").select("code", "day", "slot", r6("maker").alias("maker"))


MAKER_SQL = f"""with {K.BOOK_SQL}, h as (select *, case when slot + 29 <= max(slot) over (partition by code, day) then max(ask) over (partition by code, day order by slot rows between current row and 29 following) end as best from book),
f as (select b.code, b.day, b.slot, any_value(a.bid) as bid, min(c.slot) as fill from book b join book a on a.code = b.code and a.day = b.day and a.slot = b.slot + 1 join book c on c.code = b.code and c.day = b.day and c.slot between b.slot + 2 and b.slot + 9 and c.bid > 0 and c.bid < a.bid group by 1, 2, 3)
select f.code, f.day, f.slot::int as slot, {K._r6('h.best / f.bid - 1 - 0.002')} as maker from f join h on h.code = f.code and h.day = f.day and h.slot = f.fill + 1 where f.bid > 0 and h.best > 0"""


def specific_var_history(spark, sf):
    p = P.panel(spark, sf)
    r = p.withColumn("r", F.col("signal")).withColumn("u", F.when(F.abs("r") < 0.9, F.col("r"))).select("code", "t", "u", F.col("trade_value").alias("size"))
    return R.specific_variance_history(r, 60, 0.3, 5).filter("var is not null").select("code", "t", r6("var").alias("var"))


HISTORY_SQL = f"""with {P.PANEL_SQL}, x as (select code, t, case when abs(signal) < 0.9 then signal end as u, trade_value as size from panel), w as (select *, case when u is not null then pow(2.0, t / 60.0) end as w from x),
v as (select *, count(w) over o as n, sum(w * u * u) over o / sum(w) over o as v from w window o as (partition by code order by t)), q as (select *, case when n >= 60 then v end as q from v),
g as (select *, case when size is not null then floor((row_number() over (partition by t, size is not null order by size, code) - 1) * 5 / count(*) over (partition by t, size is not null)) end as g from q),
p as (select *, coalesce(case when g is not null then avg(q) over (partition by t, g) end, avg(q) over (partition by t)) as prior from g)
select code, t, {_r6('coalesce(q * 0.7 + prior * 0.3, prior)')} as var from p where coalesce(q * 0.7 + prior * 0.3, prior) is not null"""


def noise_rule(spark, sf):
    t = S.trades(spark, sf).withColumn("candidate", F.col("code").cast("string"))
    # each code with the next
    pairs = spark.range(0, 50, 2).select(F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"))
    out = E.noise_rules(t, "r", pairs, "candidate", 0.01)
    return out.select("a", "b", r6("mean_a").alias("mean_a"), r6("sd_a").alias("sd_a"), "n_a", r6("mean_b").alias("mean_b"), r6("sd_b").alias("sd_b"), "n_b", "winner")


NOISE_SQL = f"""with {S.TRADES_SQL}, s as (select code, avg(r) as m, stddev_samp(r) as s, count(r) as n from trades group by code), p(a, b) as (select k, k + 1 from range(0, 50, 2) r(k))
select p.a::varchar as a, p.b::varchar as b, {_r6('x.m')} as mean_a, {_r6('x.s')} as sd_a, x.n as n_a, {_r6('y.m')} as mean_b, {_r6('y.s')} as sd_b, y.n as n_b, case when abs(x.m - y.m) > 0.01 * greatest(x.s, y.s) then case when x.m > y.m then p.a else p.b end end::varchar as winner
from p join s x on x.code = p.a join s y on y.code = p.b"""


def paired_difference(spark, sf):
    t = S.trades(spark, sf).groupBy((F.col("code") % 2).cast("string").alias("candidate"), F.date_trunc("month", "entry_date").alias("seed")).agg(F.avg("r").alias("v"))
    return E.paired_difference(t, "v", "0", "1", "candidate", "seed").select(r6("mean").alias("mean"), r6("se").alias("se"), "n")


PAIR_SQL = f"""with {S.TRADES_SQL}, s as (select code % 2 as c, date_trunc('month', entry_date) as seed, avg(r) as v from trades group by 1, 2), d as (select a.v - b.v as d from s a join s b on a.seed = b.seed and a.c = 0 and b.c = 1)
select {_r6('avg(d)')} as mean, {_r6('stddev_samp(d) / sqrt(count(d))')} as se, count(d) as n from d"""


def trailing_extremes(spark, sf):
    b = K._book(spark, sf)
    b = X.trailing_extreme_blocks(b, "mid", O.KEYS, "slot", 100, "highest")
    return X.trailing_extreme_blocks(b, "mid", O.KEYS, "slot", 100, "lowest", largest=False).filter("highest is not null").select("code", "day", "slot", "highest", "lowest")


EXTREMES_SQL = f"""with {K.BOOK_SQL}, x as (select code, day, slot::int as slot, max(mid) over w as highest, min(mid) over w as lowest from book window w as (partition by code, day order by slot rows 99 preceding)) select * from x where highest is not null"""

QUERIES = {
    "cap_tier": (cap_tier, TIER_SQL, "date"),
    "capitalisation": (capitalisation, CAP_SQL, "date"),
    "earnings_known": (earnings_known, EARN_SQL, "known"),
    "maker_pessimistic": (maker_pessimistic, MAKER_SQL, "day"),
    "specific_var_history": (specific_var_history, HISTORY_SQL),
    "noise_rule": (noise_rule, NOISE_SQL),
    "paired_difference": (paired_difference, PAIR_SQL),
    "trailing_extremes": (trailing_extremes, EXTREMES_SQL, "day"),
}

"""Queries of the risk model, execution and ledgers, with the SQL of the same results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.functions import market as M
from quantweft.operators import allocation as A
from quantweft.operators import cross_section as B
from quantweft.operators import execution as E
from quantweft.operators import preparation as Q
from quantweft.operators import risk as R
from quantweft.operators import space as SP
from quantweft.operators import windows as X
from quantweft.plans import panel_queries as P
from quantweft.sources import shapes as S
from quantweft.sources.shapes import r6

PANEL = P.PANEL_SQL


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def standardize(spark, sf):
    p = P.panel(spark, sf).withColumn("cap", F.col("trade_value")).filter("trade_value is not null")
    return R.standardize(p, "signal", "cap", "z", 1.5).filter("z is not null").select("code", "date", r6("z").alias("z"))


STD_SQL = f"""with {PANEL}, a as (select *, median(signal) over (partition by date) as med, count(signal) over (partition by date) as n from panel where trade_value is not null),
b as (select *, median(abs(signal - med)) over (partition by date) * (1.4826 * 1.5)::double as mad from a), c as (select *, case when mad > 0 then greatest(least(signal, med + mad), med - mad) else signal end as zz from b),
d as (select *, sum(trade_value * zz) over (partition by date) / sum(case when zz is not null then trade_value end) over (partition by date) as mean, stddev_pop(zz) over (partition by date) as sd from (select * replace (case when signal is not null then zz end as zz) from c))
select code, date, {_r6('case when sd > 0 then (zz - mean) / sd else 0 end')} as z from d where n >= 2 and zz is not null"""


def industry_dummies(spark, sf):
    s, n = S.table(spark, sf, "supplier"), S.table(spark, sf, "nation")
    labelled = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select("s_suppkey", (F.col("n_nationkey") % 4).cast("string").alias("label"))
    return R.industry_dummies(labelled, "label", ["0", "1", "2"])


DUMMY_SQL = "select s_suppkey, (s_nationkey % 4)::varchar as label, (s_nationkey % 4 = 0)::int as ind_0, (s_nationkey % 4 = 1)::int as ind_1, (s_nationkey % 4 = 2)::int as ind_2 from supplier"


def _factor_rows(spark, sf):
    b = S.bars(spark, sf)
    f = b.groupBy("date", (F.col("code") % 4).alias("k")).agg(F.avg(F.col("close") / F.col("open") - 1).alias("f"))
    days = f.select("date").distinct().withColumn("t", F.row_number().over(W.orderBy("date")) - 1)
    return f.join(F.broadcast(days), "date").select("t", "k", "f")


FACTORS_SQL = f"""{S.BARS_SQL}, f0 as (select date, code % 4 as k, avg(close / open - 1) as f from bars group by 1, 2), fr as (select dense_rank() over (order by date) - 1 as t, k, f from f0)"""


def ewma_cov(spark, sf):
    return R.ewma_covariance(_factor_rows(spark, sf), 60, 1).select("a", "b", r6("cov").alias("cov"))


COV_SQL = f"""with {FACTORS_SQL}, x as (select t, k, f, pow(0.5, ((select max(t) from fr) - t) / 60.0) as w from fr), m as (select k, sum(w * f) / sum(w) as m from x group by k), d as (select t, x.k, w, f - m as d from x join m using (k)),
c0 as (select a.k as a, b.k as b, sum(a.w * a.d * b.d) / sum(a.w) as c from d a join d b on a.t = b.t group by 1, 2), c1 as (select a.k as a, b.k as b, sum(a.w * a.d * b.d) / sum(a.w) * 0.5 as c from d a join d b on a.t = b.t + 1 group by 1, 2)
select a, b, {_r6('sum(c)')} as cov from (select * from c0 union all select * from c1 union all select b, a, c from c1) group by a, b"""


def _residuals(spark, sf):
    p = P.panel(spark, sf).withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(W.partitionBy("code").orderBy("t"))) - 1).filter("r is not null and abs(r) < 0.9")
    return p.withColumn("u", F.col("r") - F.avg("r").over(W.partitionBy("t"))).select("code", "t", "u", F.col("trade_value").alias("size"), F.col("trade_value").alias("cap"))


RESID_SQL = f"""{PANEL}, r0 as (select *, close / lag(close) over (partition by code order by t) - 1 as r from panel), resid as (select code, t, r - avg(r) over (partition by t) as u, trade_value as size, trade_value as cap from r0 where r is not null and abs(r) < 0.9)"""


def specific_var(spark, sf):
    return R.specific_variance(_residuals(spark, sf), 60, 0.3, 5).select("code", r6("var").alias("var"))


SVAR_SQL = f"""with {RESID_SQL}, x as (select *, pow(0.5, ((select max(t) from resid) - t) / 60.0) as w from resid), v as (select code, sum(w * u * u) / sum(w) as v, count(*) as n, arg_max(size, t) as size from x group by code),
g as (select *, floor((row_number() over (order by size, code) - 1) * 5 / count(*) over ()) as g from v), p as (select *, avg(case when n >= 60 then v end) over (partition by g) as prior from g)
select code, {_r6('case when n < 60 then prior else v * 0.7 + coalesce(prior, v) * 0.3 end')} as var from p"""


def specific_vra(spark, sf):
    return R.specific_multiplier(_residuals(spark, sf).withColumn("sd", F.lit(0.3)), 90).select(r6("multiplier").alias("multiplier"))


VRA_SQL = f"""with {RESID_SQL}, d as (select t, sum(cap * pow(u / 0.3, 2)) / sum(cap) as z from resid group by t), w as (select z, pow(0.5, ((select max(t) from d) - t) / 90.0) as w from d) select {_r6('sqrt(sum(w * z) / sum(w))')} as multiplier from w"""


def bias_stat(spark, sf):
    rows = _factor_rows(spark, sf).select(F.col("k").alias("portfolio"), "t", F.col("f").alias("realized"), F.lit(0.1).alias("predicted"))
    return R.bias_statistic(rows, 24)


BIAS_SQL = f"""with {FACTORS_SQL}, z as (select k as portfolio, t, f / 0.1 as z from fr), b as (select portfolio, case when count(z) over w = 24 then stddev_samp(z) over w end as b from z window w as (partition by portfolio order by t rows 23 preceding))
select portfolio, {_r6('avg(b)')} as mean, {_r6('quantile_cont(b, 0.05)')} as q05, {_r6('quantile_cont(b, 0.95)')} as q95, count(*) as n from b where b is not null group by portfolio"""


def attribution(spark, sf):
    b = S.bars(spark, sf)
    w = b.select("date", "code", (F.col("trade_value") / F.sum("trade_value").over(W.partitionBy("date"))).alias("w"))
    x = b.select("date", "code", F.explode(F.array(F.struct(F.lit("px").alias("k"), F.ln("close").alias("x")), F.struct(F.lit("vol").alias("k"), F.when(F.col("volume") > 10, F.ln("volume")).alias("x")))).alias("s")).select("date", "code", "s.k", "s.x")
    f = b.groupBy("date").agg(F.avg(F.col("close") / F.col("open") - 1).alias("f")).withColumn("k", F.explode(F.array(F.lit("px"), F.lit("vol"))))
    return R.attribution(w, x, f)


ATTR_SQL = f"""with {S.BARS_SQL}, w as (select date, code, trade_value / sum(trade_value) over (partition by date) as w, ln(close) as px, case when volume > 10 then ln(volume) end as vol from bars), f as (select date, avg(close / open - 1) as f from bars group by date),
x as (select date, 'px' as k, sum(w * px) as e from w group by date union all select date, 'vol', case when count(*) = count(vol) then sum(w * vol) end from w group by date)
select x.date, k, {_r6('e')} as exposure, {_r6('e * f')} as contribution from x join f using (date)"""


def factor_regression(spark, sf):
    p = P.panel(spark, sf).withColumn("ret", B.forward_return(1, 0)).withColumn("ind", (F.col("code") % 3).cast("string"))
    return R.cross_section_regression(p.withColumn("cap", F.col("trade_value")), ["signal"], "ind", "ret", "cap")


def rolling_beta(spark, sf):
    out = R.rolling_beta(_market_rows(P.panel(spark, sf)), 60, 30.0, 30, 15)
    return out.select("code", "t", r6("beta").alias("beta"), r6("resid_sd").alias("resid_sd"))


def _market_rows(panel):
    """Every code and t: its return and the market's, by trade value; in partitions by code of a bounded size."""
    panel = X.by_code(panel, "market")
    r = F.try_divide(F.col("close"), F.lag("close").over(W.partitionBy("code").orderBy("t"))) - 1
    p = panel.withColumn("r", r).withColumn("r", F.when(F.abs("r") < 0.9, F.col("r")))
    known = F.when(F.col("r").isNotNull(), F.col("trade_value"))
    m = p.groupBy("t").agg((F.sum(F.col("r") * known) / F.sum(known)).alias("m"))
    return p.join(F.broadcast(m), "t")  # a row a session


MARKET_SQL = f"""{PANEL}, mr as (select *, case when abs(close / lag(close) over (partition by code order by t) - 1) < 0.9 then close / lag(close) over (partition by code order by t) - 1 end as r, close / lag(close) over (partition by code order by t) - 1 as raw from panel),
mk as (select t, sum(r * trade_value) / sum(case when r is not null then trade_value end) as m from mr group by t)"""


def beta_sql(window: int, half_life: float, least: int, resid: int, r: str = "r") -> str:
    """Steps after MARKET_SQL: rb (code, t, beta, resid_sd), by two passes over each window."""
    return f"""bx as (select mr.code, mr.t, {r} as r, m from mr join mk using (t) where {r} is not null and m is not null),
bg as (select distinct code, t from mr where t >= {window}), bw as (select g.code, g.t, x.t as s, r, m, pow(0.5, (g.t - x.t) / {half_life}::double) as w from bg g join bx x on x.code = g.code and x.t > g.t - {window} and x.t <= g.t),
bm as (select code, t, sum(w * m) / sum(w) as mb, sum(w * r) / sum(w) as rb from bw group by 1, 2 having count(*) >= {least}),
bb as (select code, t, sum(w * (m - mb) * (r - rb)) / sum(w * (m - mb) * (m - mb)) as beta from bw join bm using (code, t) group by 1, 2),
br as (select code, t, case when count(*) >= {resid // 2} then stddev_samp(r - beta * m) end as resid_sd from bw join bb using (code, t) where s > t - {resid} group by 1, 2),
rb as (select bb.code, bb.t, beta, resid_sd from bb left join br using (code, t))"""


BETA_SQL = f"""with {MARKET_SQL}, {beta_sql(60, 30, 30, 15)} select code, t, {_r6('beta')} as beta, {_r6('resid_sd')} as resid_sd from rb"""

LIQUIDITY = ((4, 0.35), (13, 0.35), (52, 0.3))


def risk_styles(spark, sf):
    """All six styles on a weekly panel; the windows are weeks, capitalisation and net income come from trade values."""
    w = W.partitionBy("code").orderBy("t")
    p = _market_rows(P.panel(spark, sf)).withColumn("cap", F.avg("trade_value").over(w.rowsBetween(-51, 0)) * 40).withColumn("ttm", F.avg("trade_value").over(w.rowsBetween(-12, 0)) / 10)
    out = Q.risk_styles(p, 60, 30.0, 30, 15, 13, 1, LIQUIDITY)
    return out.select("code", "t", *[r6(c).alias(c) for c in out.columns[2:]])


_LIQ = " + ".join(f"{weight} * case when count(turn) over (partition by code order by t rows {n - 1} preceding) >= {n // 2} and avg(turn) over (partition by code order by t rows {n - 1} preceding) > 0 then ln(21.0 * avg(turn) over (partition by code order by t rows {n - 1} preceding)) end" for n, weight in LIQUIDITY)
STYLES_SQL = f"""with {MARKET_SQL}, {beta_sql(60, 30, 30, 15, 'raw')},
c0 as (select *, avg(trade_value) over (partition by code order by t rows 51 preceding) * 40 as cap, avg(trade_value) over (partition by code order by t rows 12 preceding) / 10 as ttm from mr),
c1 as (select *, case when cap > 0 then cap end as pc, case when close > 0 then close end as pp, trade_value / case when cap > 0 then cap end as turn from c0),
c2 as (select code, t, ln(pc) as size, ln(lag(pp, 1) over (partition by code order by t)) - ln(lag(pp, 13) over (partition by code order by t)) as momentum, {_LIQ} as liquidity, ttm / pc as value from c1)
select c2.code, c2.t, {_r6('size')} as size, {_r6('beta')} as beta, {_r6('momentum')} as momentum, {_r6('resid_sd')} as resid_vol, {_r6('liquidity')} as liquidity, {_r6('value')} as value from c2 left join rb using (code, t)"""


def optimize_dates(spark, sf):
    p = P.panel(spark, sf).filter("signal is not null").select("date", "code", F.col("signal").alias("alpha"), F.lit(0.04).alias("d"), F.lit(0.01).alias("w_prev"), (F.col("signal") * 0 + 1).alias("mkt"), (F.col("code") % 2).cast("double").alias("odd"))
    return R.optimize_dates(p, ["mkt", "odd"], np.array([[0.04, 0.0], [0.0, 0.01]]), 5.0, 0.001, 0.1)


BOOK_LIMITS = A.Limits(max_weight=0.15, sector_band=0.1, beta_bounds=(0.8, 1.2), style_bounds={"size": (-0.5, 0.5)}, max_turnover=0.8, max_participation=5.0)


def optimize_limits(spark, sf):
    """The book of every date under all kinds of limits: sectors are codes by their last digit, the benchmark is the trade value."""
    p = P.panel(spark, sf).filter("signal is not null and trade_value is not null")
    day = W.partitionBy("date")
    share = F.col("trade_value") / F.sum("trade_value").over(day)
    size = F.ln("trade_value")
    rows = p.select(
        "date", "code", (F.col("signal") / 100).alias("alpha"), (0.02 + (F.col("code") % 7) / 100).alias("d"), (1 / F.count(F.lit(1)).over(day)).alias("w_prev"), F.lit(1.0).alias("mkt"),
        ((size - F.avg(size).over(day)) / F.greatest(F.stddev_pop(size).over(day), F.lit(1e-9))).alias("size"), (F.col("code") % 5).alias("sector"), share.alias("benchmark"), (share * 2).alias("capacity"),
        F.lit(0.001).alias("linear"), F.lit(-0.0005).alias("tilt"), F.lit(0.002).alias("impact"), (F.col("code") % 11 == 3).alias("no_buy"), (F.col("code") % 17 == 5).alias("no_trade"),
    )
    return A.optimize_panel(rows, ["mkt", "size"], np.array([[0.04, 0.0], [0.0, 0.01]]), BOOK_LIMITS, 5.0)


def _fills(spark, sf):
    l = S.table(spark, sf, "lineitem")
    seq = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    side = F.when(seq % 3 == 0, "sell").otherwise("buy")
    return l.select(F.col("l_suppkey").alias("code"), seq.cast("long").alias("seq"), side.alias("side"), F.when(seq % 3 == 0, 1).otherwise(F.col("l_quantity").cast("int")).cast("long").alias("qty"), F.floor("l_extendedprice").cast("long").alias("price"))


def position_fold(spark, sf):
    return E.position_fold(_fills(spark, sf))


def reconcile(spark, sf):
    l = S.table(spark, sf, "lineitem")
    side = lambda flag: l.filter(F.col("l_returnflag") == flag).groupBy((F.col("l_partkey") % 3000).alias("code")).agg(F.count(F.lit(1)).alias("qty"))
    return E.reconcile(side("N"), side("R"))


REC_SQL = """with b as (select l_partkey % 3000 as code, count(*) as qty from lineitem where l_returnflag = 'N' group by 1), r as (select l_partkey % 3000 as code, count(*) as qty from lineitem where l_returnflag = 'R' group by 1)
select coalesce(b.code, r.code) as code, case when r.qty is null then 'only_book' when b.qty is null then 'only_broker' else 'qty_mismatch' end as kind, coalesce(b.qty, 0) as book_qty, coalesce(r.qty, 0) as broker_qty from b full join r on b.code = r.code where b.qty is distinct from r.qty"""


def own_foreign_fills(spark, sf):
    o = S.table(spark, sf, "orders")
    fills = o.select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("ord_no"), F.col("o_totalprice").alias("v"))
    own, foreign = E.split_fills(fills, o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("ord_no")), M.normalize_order_no)
    stat = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), r6(F.sum("v")).alias("v"))
    return stat(own, "own").unionByName(stat(foreign, "foreign"))


# number 0 keeps its zeros, so the padded and the plain form differ
OWN_SQL = f"select case when o_orderstatus = 'F' and o_orderkey > 0 then 'own' else 'foreign' end as kind, count(*) as n, {_r6('sum(o_totalprice)')} as v from orders group by 1"


def incremental_fills(spark, sf):
    e = S.table(spark, sf, "events")
    cum = F.sum(F.floor(F.col("value") / 40)).over(W.partitionBy(F.col("ts").cast("date"), "user_id").orderBy("event_id")).cast("long")
    return E.incremental_fills(e.select(F.col("ts").cast("date").alias("day"), F.col("user_id").alias("ord_no"), F.col("event_id").alias("seq"), cum.alias("cum_qty")))


INCR_SQL = """with c as (select ts::date as day, user_id as ord_no, event_id as seq, sum(floor(value / 40)) over (partition by ts::date, user_id order by event_id)::bigint as cum from events),
d as (select *, cum - coalesce(max(cum) over (partition by day, ord_no order by seq rows between unbounded preceding and 1 preceding), 0) as new_qty from c) select day, ord_no, seq, new_qty from d where new_qty > 0"""


def order_guard(spark, sf):
    e = S.table(spark, sf, "events").withColumn("day", F.col("ts").cast("date")).withColumn("code", F.lpad((F.col("user_id") * 7).cast("string"), 6, "0"))
    by_day, by_code = W.partitionBy("day").orderBy("event_id"), W.partitionBy("day", "code").orderBy("event_id")
    why = E.guard_reason(F.col("code"), F.when(F.col("event_type") == "purchase", "buy").otherwise("sell"), F.floor(F.col("value") / 10).cast("int"), F.col("value"), F.lit(55.0), F.row_number().over(by_day), F.row_number().over(by_code), ["000070", "000140"], F.col("user_id") % 11 == 0, None, 8, 15, 0.5, 300, 4)
    return e.select("event_id", F.coalesce(why, F.lit("ok")).alias("reason"))


GUARD_SQL = """with e as (select *, ts::date as day, lpad((user_id * 7)::varchar, 6, '0') as code, floor(value / 10)::int as qty from events), n as (select *, row_number() over (partition by day order by event_id) as nd, row_number() over (partition by day, code order by event_id) as nc from e)
select event_id, case when length(code) <> 6 then 'bad_code' when code in ('000070', '000140') then 'blocked' when event_type = 'purchase' and user_id % 11 = 0 then 'held' when qty < 1 then 'qty_below_one' when qty > 15 then 'qty_hard_cap' when qty > 8 then 'qty_cap' when value <= 0 then 'price'
  when abs(value / 55.0 - 1) > 0.5 + 1e-9 then 'price_band' when nd > 300 then 'orders_per_day' when nc > 4 then 'orders_per_code' else 'ok' end as reason from n"""


def kill_switch(spark, sf):
    e = S.table(spark, sf, "events").select((F.col("user_id") % 40).alias("account"), F.col("ts").cast("date").alias("day"), F.col("event_id").alias("seq"), F.floor(F.col("value") - 55).cast("long").alias("pnl"))
    return E.kill_switch(e, 120.0, 3, 0.5, 60.0).select("account", "day", "seq", "realized", F.coalesce("reason", F.lit("on")).alias("reason"))


KILL_SQL = """with e as (select user_id % 40 as account, ts::date as day, event_id as seq, floor(value - 55)::bigint as pnl from events), r as (select *, (sum(pnl) over w)::bigint as realized, sum((pnl >= 0)::int) over w as isl from e window w as (partition by account, day order by seq)),
p as (select *, greatest(max(realized) over (partition by account, day order by seq), 0) as peak, sum((pnl < 0)::int) over (partition by account, day, isl order by seq) as run from r),
k as (select *, case when peak >= 60 and realized <= peak * 0.5 then 'profit_giveback' when run >= 3 then 'consecutive_losses' when realized <= -120 then 'daily_loss' end as now from p)
select account, day, seq, realized, coalesce(first_value(now ignore nulls) over (partition by account, day order by seq), 'on') as reason from k"""


def replay(spark, sf):
    e = S.table(spark, sf, "events").select((F.col("user_id") % 20).alias("account"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"), (F.col("value") - 0.5).alias("bid"), (F.col("value") + 0.5).alias("ask"))
    return E.replay(e, _dip_buyer, 60)


def _dip_buyer(event: dict, state: dict) -> list[tuple[str, int]]:
    """Buys one when the ask is low and sells all when the bid is high: a strategy to replay."""
    if event["ask"] < 15:
        return [("buy", 1)]
    if event["bid"] > 90 and state["qty"] > 0:
        return [("sell", state["qty"])]
    return []


def runs_merged(spark, sf):
    """Start and end rows of a run ledger as one row a run; a run without an end has none."""
    o = S.table(spark, sf, "orders")
    starts = o.select(F.col("o_orderkey").alias("run_id"), F.lit("start").alias("event"), F.col("o_orderstatus").alias("v"))
    ends = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("run_id"), F.lit("end").alias("event"), F.col("o_orderpriority").alias("v"))
    u = starts.unionByName(ends)
    return u.groupBy("run_id").agg(F.max(F.when(F.col("event") == "start", F.col("v"))).alias("label"), F.max(F.when(F.col("event") == "end", F.col("v"))).alias("status"))


RUNS_SQL = "select o_orderkey as run_id, o_orderstatus as label, case when o_orderkey % 3 <> 0 then o_orderpriority end as status from orders"


def trials_distinct(spark, sf):
    o = S.table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.sha2(F.concat_ws("|", "o_custkey", "o_orderstatus"), 256)).alias("trials"))


TRIALS_SQL = "select o_orderpriority as label, count(*) as rows, count(distinct o_custkey::varchar || '|' || o_orderstatus) as trials from orders group by 1"


def pending_registrations(spark, sf):
    o = S.table(spark, sf, "orders")
    done = S.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


PENDING_SQL = "select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A')"


def sweep_objective(trades):
    """value of phenotypes (horizon, top, cost): mean of r over trades of codes below `top` whose code's last `horizon` trades gained, less
    cost; all phenotypes in one pass over the trades."""

    def value(configs):
        horizons = [r[0] for r in configs.select("horizon").distinct().collect()]  # levels of a gene
        w = W.partitionBy("code").orderBy("entry_date", "trade_id")
        past = F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), F.avg("r").over(w.rowsBetween(-h, -1)).alias("m")) for h in horizons] or [F.struct(F.lit(0).cast("long").alias("horizon"), F.lit(0.0).alias("m"))])
        rows = trades.withColumn("p", past).select("code", "r", F.explode("p").alias("p")).filter("p.m > 0").select("code", "r", "p.horizon")
        hits = rows.join(F.broadcast(configs), "horizon").filter(F.col("code") < F.col("top"))  # a row a phenotype
        means = hits.groupBy("key").agg(F.avg("r").alias("m"))
        return configs.join(means, "key", "left").select("key", (F.col("m") - F.col("cost")).alias("value"))

    return value


SWEEP_SPACE = SP.Space([SP.Ordinal("horizon", (5, 20, 60)), SP.Ordinal("top", (10, 40)), SP.Real("cost", 0.001, 0.002)])


def sweep_grid(spark, sf):
    """A grid of parameters, some of it twice, each phenotype evaluated once over all trades; half of them come from a memo."""
    grid = [(float(c), float(h), float(t)) for h in range(3) for t in range(2) for c in (0, 1)]
    table = spark.createDataFrame([(i, list(x)) for i, x in enumerate([*grid, *grid[:5]])], "index long, x array<double>")
    value = sweep_objective(S.trades(spark, sf))
    _, memo = SP.evaluated_once(table.filter("index % 2 = 0"), SWEEP_SPACE, value)
    out, _ = SP.evaluated_once(table, SWEEP_SPACE, value, memo)
    return out.select("index", "horizon", "top", "cost", r6("value").alias("score"))


SWEEP_SQL = f"""with {S.TRADES_SQL}, g as (select h * 4 + t * 2 + c as i, [5, 20, 60][h + 1] as horizon, [10, 40][t + 1] as top, [0.001, 0.002][c + 1]::double as cost from range(0, 3) a(h), range(0, 2) b(t), range(0, 2) d(c)),
x as (select i as index, * from g union all select i + 12, * from g where i < 5),
m as (select code, r, avg(r) over (partition by code order by entry_date, trade_id rows between 5 preceding and 1 preceding) as m5, avg(r) over (partition by code order by entry_date, trade_id rows between 20 preceding and 1 preceding) as m20,
  avg(r) over (partition by code order by entry_date, trade_id rows between 60 preceding and 1 preceding) as m60 from trades),
s as (select g.i, avg(r) - any_value(cost) as score from g join m on m.code < g.top and case g.horizon when 5 then m5 when 20 then m20 else m60 end > 0 group by g.i)
select x.index, x.horizon::bigint as horizon, x.top::bigint as top, x.cost, {_r6('s.score')} as score from x left join s using (i)"""

QUERIES = {
    "standardize": (standardize, STD_SQL, "date"),
    "industry_dummies": (industry_dummies, DUMMY_SQL),
    "ewma_cov": (ewma_cov, COV_SQL),
    "specific_var": (specific_var, SVAR_SQL),
    "specific_vra": (specific_vra, VRA_SQL),
    "bias_stat": (bias_stat, BIAS_SQL),
    "attribution": (attribution, ATTR_SQL, "date"),
    "factor_regression": (factor_regression, None, "date"),
    "rolling_beta": (rolling_beta, BETA_SQL),
    "risk_styles": (risk_styles, STYLES_SQL),
    "optimize_dates": (optimize_dates, None, "date"),
    "optimize_limits": (optimize_limits, None, "date"),
    "position_fold": (position_fold, None),
    "reconcile": (reconcile, REC_SQL),
    "own_foreign_fills": (own_foreign_fills, OWN_SQL),
    "incremental_fills": (incremental_fills, INCR_SQL, "day"),
    "order_guard": (order_guard, GUARD_SQL),
    "kill_switch": (kill_switch, KILL_SQL, "day"),
    "replay": (replay, None),
    "runs_merged": (runs_merged, RUNS_SQL),
    "trials_distinct": (trials_distinct, TRIALS_SQL),
    "pending_registrations": (pending_registrations, PENDING_SQL),
    "sweep_grid": (sweep_grid, SWEEP_SQL),
}

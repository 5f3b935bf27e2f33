"""Queries of point-in-time preparation, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.functions import market as M
from quantweft.operators import preparation as Q
from quantweft.operators import resampling as R
from quantweft.operators import statistics as T
from quantweft.plans import panel_queries as P
from quantweft.plans import stats_queries as ST
from quantweft.sources import shapes as S
from quantweft.sources.shapes import r6

TRADES, BARS = S.TRADES_SQL, S.BARS_SQL


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def ttm_asof(spark, sf):
    o = S.table(spark, sf, "orders")
    e = o.groupBy((F.col("o_custkey") % 60).alias("code"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("q")).agg(F.sum("o_totalprice").alias("netinc"))
    return Q.trailing_year(e.withColumn("netinc_prior", F.col("netinc") * 0.75)).select("code", "year", "q", r6("ttm").alias("ttm"))


TTM_SQL = f"""with e as (select o_custkey % 60 as code, year(o_orderdate)::int as year, quarter(o_orderdate)::int as q, sum(o_totalprice) as netinc from orders group by 1, 2, 3),
g as (select a.code, a.year, a.q, a.netinc, sum(b.netinc - b.netinc * 0.75) as gain, count(*) as n from e a join e b on a.code = b.code and a.year = b.year and b.q <= a.q group by 1, 2, 3, 4)
select g.code, g.year, g.q, {_r6('case when g.q = 4 then g.netinc when g.n = g.q then p.netinc + g.gain else p.netinc end')} as ttm from g left join e p on p.code = g.code and p.year = g.year - 1 and p.q = 4"""


def regular_session(spark, sf):
    daily = S.bars(spark, sf)
    session = S.rollup_bars(S.table(spark, sf, "lineitem").filter("l_linenumber <= 5"))
    return Q.repair_sessions(daily, session, "1997-01-01")


SESSION_SQL = f"""with {BARS}, l5 as (select * from lineitem where l_linenumber <= 5), {BARS.replace('bars as', 'sess as').replace('from lineitem)', 'from l5)')}
select b.code, b.date, {', '.join(f"case when b.date >= date '1997-01-01' and s.{c} is not null then s.{c} else b.{c} end as {c}" for c in ('open', 'high', 'low', 'close', 'volume'))}, b.date < date '1997-01-01' or s.close is not null as regular_ok
from bars b left join sess s on s.code = b.code and s.date = b.date"""


def snap_ratios(spark, sf):
    b = S.bars(spark, sf)
    ratio = F.col("close") / F.lag("close").over(W.partitionBy("code").orderBy("date"))
    out = Q.snap_ratio(F.col("ratio"), F.array(F.lit(1.0), F.lit(0.5), F.lit(2.0), F.lit(0.2)), 0.02)
    return b.withColumn("ratio", ratio).filter("ratio is not null").select("code", "date", out.alias("snapped"))


SNAP_SQL = f"""with {BARS}, r as (select code, date, close / lag(close) over (partition by code order by date) as ratio from bars), c as (select r.*, c, abs(ln(ratio / c)) as e from r, unnest([1.0::double, 0.5::double, 2.0::double, 0.2::double]) u(c) where ratio is not null)
select code, date, case when min(e) <= 0.02 then arg_min(c, e) else max(ratio) end as snapped from c group by code, date"""


def align_forward_sessions(spark, sf):
    l = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("published"))
    cal = S.calendar(spark, sf).filter("idx % 5 <> 2 and date < date '1998-06-01'").select("date")
    return Q.align_to_sessions(l, "published", cal)


ALIGN_SQL = f"""with {S.CALENDAR_SQL}, c as (select date from calendar where idx % 5 <> 2 and date < date '1998-06-01'), d as (select distinct cast(l_shipdate as date) as day from lineitem), m as (select day, min(date) as session from d join c on c.date >= d.day group by day)
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, cast(l_shipdate as date) as published, session from lineitem join m on m.day = cast(l_shipdate as date)"""


def session_offsets(spark, sf):
    o = S.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    cal = S.calendar(spark, sf)
    later = Q.session_offset(o, "day", cal, 3).withColumnRenamed("offset", "later")
    return Q.session_offset(later, "day", cal, -2).withColumnRenamed("offset", "earlier")


OFFSET_SQL = f"""with {S.CALENDAR_SQL} select o_orderkey, cast(o_orderdate as date) as day, a.date as later, b.date as earlier from orders join calendar c on c.date = cast(o_orderdate as date) left join calendar a on a.idx = c.idx + 3 left join calendar b on b.idx = c.idx - 2"""


def resolve_exits(spark, sf):
    t = S.trades(spark, sf).withColumn("exit_date", F.when(F.col("trade_id") % 3 == 0, F.date_add("entry_date", 5)))
    return Q.resolve_exits(t, 20).select("trade_id", "entry_date", "exit_date")


EXITS_SQL = f"with {TRADES} select trade_id, entry_date, case when trade_id % 3 = 0 then entry_date + 5 else entry_date + 20 end as exit_date from trades"


def sweep_vwap(spark, sf):
    l = S.table(spark, sf, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    book = l.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("day")).agg(F.array_sort(F.collect_list(F.struct(px.alias("px"), F.col("l_quantity").cast("double").alias("qty"), "l_orderkey"))).alias("levels"))
    return book.select("l_suppkey", "day", r6(Q.sweep_vwap(F.col("levels"), 40000.0)).alias("vwap"))


VWAP_SQL = f"""with l as (select l_suppkey, cast(l_shipdate as date) as day, l_extendedprice / l_quantity as px, l_extendedprice as val, sum(l_extendedprice) over (partition by l_suppkey, l_shipdate order by l_extendedprice / l_quantity, l_quantity, l_orderkey rows between unbounded preceding and current row) as cum from lineitem),
s as (select l_suppkey, day, sum(val) as total, sum(greatest(0, least(val, 40000.0 - (cum - val))) / px) as shares from l group by 1, 2)
select l_suppkey, day, case when total >= 40000.0 - 1e-9 then {_r6('40000.0 / shares')} end as vwap from s"""


def style_panels(spark, sf):
    p = P.panel(spark, sf)
    cap = F.avg("trade_value").over(W.partitionBy("code").orderBy("t").rowsBetween(-51, 0)) * 40
    return Q.style_panels(p.withColumn("cap", cap), F.col("cap")).select("code", "date", r6("size").alias("size"), r6("momentum").alias("momentum"), r6("liquidity").alias("liquidity"))


STYLE_SQL = f"""with {P.PANEL_SQL}, c as (select *, avg(trade_value) over (partition by code order by t rows 51 preceding) * 40 as cap, avg(trade_value) over (partition by code order by t rows 11 preceding) as m, count(trade_value) over (partition by code order by t rows 11 preceding) as k from panel)
select code, date, {_r6('case when cap > 0 then ln(cap) end')} as size, {_r6('signal')} as momentum, {_r6('case when k >= 6 and cap > 0 then ln(m / cap) end')} as liquidity from c"""


def risk_decomposition(spark, sf):
    b = S.bars(spark, sf)
    w = b.select("date", "code", (F.col("trade_value") / F.sum("trade_value").over(W.partitionBy("date"))).alias("w"))
    x = b.select("date", "code", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(1.0).alias("x")), F.struct(F.lit(1).alias("k"), (F.col("code") % 5).cast("double").alias("x")))).alias("s")).select("date", "code", "s.k", "s.x")
    f = spark.createDataFrame([(0, 0, 0.04), (0, 1, 0.01), (1, 0, 0.01), (1, 1, 0.02)], "a int, b int, cov double")
    d = b.select("code").distinct().withColumn("var", 0.1 + (F.col("code") % 3) / 10)
    return Q.decompose(w, x, f, d)


DECOMP_SQL = f"""with {BARS}, w as (select date, code, trade_value / sum(trade_value) over (partition by date) as w from bars), y as (select date, sum(w) as y0, sum(w * (code % 5)) as y1, sum(w * w * (0.1 + (code % 3) / 10.0)) as sv from w group by date)
select date, {_r6('y0 * y0 * 0.04 + 2 * y0 * y1 * 0.01 + y1 * y1 * 0.02')} as factor_var, {_r6('sv')} as specific_var, {_r6('y0 * y0 * 0.04 + 2 * y0 * y1 * 0.01 + y1 * y1 * 0.02 + sv')} as total_var from y"""


def paired_bootstrap(spark, sf):
    """Bootstrap of the mean difference of two daily series on their common dates."""
    t = S.trades(spark, sf)
    day = lambda rows, c: rows.groupBy("entry_date").agg(F.avg("r").alias(c))
    d = day(t.filter("code < 25"), "a").join(day(t.filter("code >= 25"), "b"), "entry_date").select("entry_date", (F.col("a") - F.col("b")).alias("x"))
    return R.block_bootstrap(d, "x", "entry_date", block=1, replicates=100, seed=3, per_year=1)


PAIRED_SQL = ST.boot_sql(
    "select entry_date as month, avg(r) filter (code < 25) - avg(r) filter (code >= 25) as x from trades group by 1 having count(*) filter (code < 25) > 0 and count(*) filter (code >= 25) > 0", 1, 100, 3, 1
)


def versions(spark, sf):
    o = S.table(spark, sf, "orders").select("o_orderkey", F.expr("concat('v', o_orderkey % 5, '.', o_orderkey % 13, case when o_orderkey % 2 = 0 then 'rc1' else '' end)").alias("v"))
    parts = M.version_parts("v")
    return o.select("o_orderkey", parts[0].alias("major"), parts[1].alias("minor"), F.size(parts).alias("n"))


VERSION_SQL = "select o_orderkey, (o_orderkey % 5)::int as major, (o_orderkey % 13)::int as minor, 2::int as n from orders"


def walk_forward(spark, sf):
    t = S.trades(spark, sf)

    def fit(train):
        return {"cut": train.agg(F.percentile("r", F.lit(0.7))).first()[0]}

    out = Q.walk_forward(t, T.rolling_folds(1995, 1998, 1, 1), "entry_date", fit, lambda test, p: test.filter(F.col("r") >= p["cut"]))
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r")).alias("mean"))


WALK_SQL = f"""with {ST.FOLDED_SQL}, c as (select f.fold, f.test_lo, f.test_hi, quantile_cont(t.r, 0.7) as cut from folds f join trades t on t.entry_date >= f.train_lo and t.entry_date < f.test_lo group by 1, 2, 3)
select fold, count(*) as n, {_r6('avg(r)')} as mean from c join trades t on t.entry_date >= c.test_lo and t.entry_date < c.test_hi and t.r >= c.cut group by fold"""

QUERIES = {
    "ttm_asof": (ttm_asof, TTM_SQL),
    "regular_session": (regular_session, SESSION_SQL, "date"),
    "snap_ratios": (snap_ratios, SNAP_SQL, "date"),
    "align_forward_sessions": (align_forward_sessions, ALIGN_SQL, "published session"),
    "session_offsets": (session_offsets, OFFSET_SQL, "day later earlier"),
    "resolve_exits": (resolve_exits, EXITS_SQL, "entry_date exit_date"),
    "sweep_vwap": (sweep_vwap, VWAP_SQL, "day"),
    "style_panels": (style_panels, STYLE_SQL, "date"),
    "risk_decomposition": (risk_decomposition, DECOMP_SQL, "date"),
    "paired_date_bootstrap": (paired_bootstrap, PAIRED_SQL),
    "versions": (versions, VERSION_SQL),
    "walk_forward": (walk_forward, WALK_SQL),
}

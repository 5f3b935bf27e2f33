"""Queries over bars and panels: roll-ups, as-of joins, ranks, cross-sectional tests; with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.operators import cross_section as B
from quantweft.operators import windows as X
from quantweft.sources import shapes as S
from quantweft.sources.shapes import r6
from quantweft.sources.staging import new_path, written
from quantweft.sources.yearly import YearlyCopy

BARS = S.BARS_SQL


def panel(spark, sf, near=1, far=13):
    """Dense weekly panel with a momentum signal."""
    b = S.bars(spark, sf)
    p = X.densify(b, b, b).select("code", "date", "t", "close", "trade_value")
    return p.withColumn("signal", B.momentum(near, far))


PANEL_SQL = f"""{BARS}, ds as (select date, row_number() over (order by date) - 1 as t from (select distinct date from bars)), cs as (select distinct code from bars),
grid as (select cs.code, ds.date, ds.t, b.close, b.trade_value from cs cross join ds left join bars b on b.code = cs.code and b.date = ds.date),
panel as (select *, ln(lag(close, 1) over w) - ln(lag(close, 13) over w) as signal from grid window w as (partition by code order by t))"""


def bars_rollup(spark, sf):
    return S.bars(spark, sf)


def fingerprint(spark, sf):
    b = S.bars(spark, sf)
    return b.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.max("date").cast("string").alias("last"), F.sum(F.rint(F.col("close") * 100).cast("long")).cast("long").alias("closes"), F.sum(F.col("volume").cast("long")).cast("long").alias("volumes"))


FINGERPRINT_SQL = f"with {BARS} select year(date)::int as year, count(*) as n, max(date)::varchar as last, sum(round_even(close * 100, 0)::bigint)::bigint as closes, sum(volume::bigint)::bigint as volumes from bars group by 1"


def yearly_copy(spark, sf):
    """Bars copied by year in two revisions: the second has more rows in every third year, and only those are written again."""
    bars = written(S.bars(spark, sf), "bars")  # fingerprints and copies of both revisions read it
    copy = YearlyCopy(spark, new_path(spark, "yearly"))
    copy.refresh(bars.filter((F.year("date") % 3 != 0) | (F.col("code") % 5 != 0)))
    again = copy.refresh(bars)
    rows = copy.read().groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("close")).alias("close"))
    return rows.withColumn("written", F.col("year").isin(again))


YEARLY_SQL = f"with {BARS} select year, count(*) as n, floor(sum(close) * 1e6 + 0.5) / 1e6 as close, bool_or(year % 3 = 0 and code % 5 = 0) as written from (select *, year(date)::int as year from bars) group by year"


def panel_dense(spark, sf):
    return panel(spark, sf).select("code", "date", F.col("t").cast("long").alias("t"), "close", "trade_value")


def adv_windows(spark, sf):
    p = panel(spark, sf)
    return p.select("code", "date", r6(B.trailing_adv(8)).alias("adv_before"), r6(B.adv(4)).alias("adv_now"))


ADV_SQL = f"""with {PANEL_SQL} select code, date,
  floor(case when count(*) over b = 8 then avg(trade_value) over b end * 1e6 + 0.5) / 1e6 as adv_before,
  floor(case when count(trade_value) over n = 4 then avg(abs(trade_value)) over n end * 1e6 + 0.5) / 1e6 as adv_now
from panel window b as (partition by code order by t rows between 8 preceding and 1 preceding), n as (partition by code order by t rows between 3 preceding and current row)"""


def forward_returns(spark, sf):
    return panel(spark, sf).select("code", "date", B.forward_return(4).alias("ret"))


FWD_SQL = f"with {PANEL_SQL} select code, date, lead(close, 5) over w / lead(close, 1) over w - 1 as ret from panel window w as (partition by code order by t)"


def pct_rank_avg(spark, sf):
    b = S.bars(spark, sf).withColumn("v", F.floor(F.col("close") / 50))
    return b.select("code", "date", X.average_rank("v", "date").alias("rank"), r6(X.percent_rank("v", "date")).alias("pct"))


PCT_SQL = f"""with {BARS}, v as (select code, date, floor(close / 50) as v from bars)
select code, date, (rank() over (partition by date order by v) + (count(*) over (partition by date, v) - 1) / 2.0::double)::double as rank,
  floor((rank() over (partition by date order by v) + (count(*) over (partition by date, v) - 1) / 2.0::double) / count(*) over (partition by date) * 1e6 + 0.5) / 1e6 as pct from v"""


def rank_bucket_rows(spark, sf):
    b = S.bars(spark, sf).withColumn("v", F.when(F.col("volume") > 30, F.floor(F.col("close") / 20)))
    return b.select("code", "date", F.coalesce(X.rank_buckets("v", 5, ["date"], ["code"]), F.lit(-1)).cast("long").alias("bucket"), F.coalesce(X.rank_buckets("v", 5, ["date"], ["code"], ascending=True), F.lit(-1)).cast("long").alias("up"))


BUCKET_SQL = f"""with {BARS}, v as (select code, date, case when volume > 30 then floor(close / 20) end as v from bars)
select code, date, case when v is not null then least(floor((row_number() over (partition by date, v is not null order by v desc, code) - 1) * 5 / count(v) over (partition by date)), 4) else -1 end::bigint as bucket,
  case when v is not null then least(floor((row_number() over (partition by date, v is not null order by v, code) - 1) * 5 / count(v) over (partition by date)), 4) else -1 end::bigint as up from v"""


def quantile_summary(spark, sf):
    rows = B.eligible(panel(spark, sf), 4, 0.0, 8, 130, 10, every=40)
    return B.quantile_summary(rows.select("code", "date", "signal", "ret"), 5)


ELIGIBLE_SQL = f"""{PANEL_SQL}, r as (select *, lead(close, {{h}} + 1) over w / lead(close, 1) over w - 1 as ret, max(t) over () as last from panel window w as (partition by code order by t)),
ok as (select *, count(*) over (partition by t) as n from r where t >= 130 and t < last - {{h}} and (t - 130) % {{e}} = 0 and signal is not null and ret is not null)"""
QSUM_SQL = f"""with {ELIGIBLE_SQL.format(h=4, e=40)}, k as (select *, row_number() over (order by signal desc, code, date) as rn, count(*) over () as m from ok where n >= 10)
select greatest(1, ceil((rn - 1) * 5::double / (m - 1)))::bigint as bucket, count(*) as n, floor(avg(ret) * 1e6 + 0.5) / 1e6 as mean, floor(avg((ret > 0)::int::double) * 1e6 + 0.5) / 1e6 as hit from k group by 1"""


def rank_ic_series(spark, sf):
    """Flagship: daily rank information coefficient of momentum."""
    return B.rank_ic(panel(spark, sf), 4, min_names=5).withColumn("t", F.col("t").cast("long"))


IC_SQL = f"""with {ELIGIBLE_SQL.format(h=4, e=1)}, k as (select *, rank() over (partition by t order by signal) + (count(*) over (partition by t, signal) - 1) / 2.0::double as ra,
  rank() over (partition by t order by ret) + (count(*) over (partition by t, ret) - 1) / 2.0::double as rb from ok where n >= 5)
select date, t, count(*) as n, floor(corr(ra, rb) * 1e6 + 0.5) / 1e6 as ic from k group by date, t having stddev_pop(ra) > 0 and stddev_pop(rb) > 0"""


def ic_decay(spark, sf):
    p = panel(spark, sf)
    out = None
    for h in (1, 4, 12):
        s = B.rank_ic(p, h, min_names=5).agg(F.lit(h).alias("horizon"), F.count(F.lit(1)).alias("n"), F.avg("ic").alias("m"), F.stddev_samp("ic").alias("sd"), r6(F.avg((F.col("ic") > 0).cast("double"))).alias("positive"))
        out = s if out is None else out.unionByName(s)
    return out.select("horizon", "n", r6("m").alias("mean"), F.floor(F.try_divide(F.col("m"), F.col("sd")) * 1e4 + 0.5) / 1e4, "positive").toDF("horizon", "n", "mean", "icir", "positive")


DECAY_SQL = " union all ".join(
    f"select {h}::int as horizon, count(*) as n, floor(avg(ic) * 1e6 + 0.5) / 1e6 as mean, floor(avg(ic) / stddev_samp(ic) * 1e4 + 0.5) / 1e4 as icir, floor(avg((ic > 0)::int::double) * 1e6 + 0.5) / 1e6 as positive from ({IC_SQL.replace(ELIGIBLE_SQL.format(h=4, e=1), ELIGIBLE_SQL.format(h=h, e=1))})"
    for h in (1, 4, 12)
)


def rank_tilt_periods(spark, sf):
    return B.rank_tilt(panel(spark, sf), 4, min_names=5, adv_window=8, borrow=0.02).withColumn("t", F.col("t").cast("long"))


TILT_SQL = f"""with {ELIGIBLE_SQL.format(h=4, e=4)}, k as (select *, (rank() over (partition by t order by signal) + (count(*) over (partition by t, signal) - 1) / 2.0::double) / n - 0.5 as tilt from ok where n >= 5),
w as (select *, tilt / sum(abs(tilt)) over (partition by t) as w from k), ts as (select t, lag(t) over (order by t) as pt from (select distinct t from w)),
g as (select t, max(date) as date, sum(w * ret) as gross, sum(case when w < 0 then -w else 0 end) as short from w group by t),
tn as (select ts.t, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) as turnover from ts, lateral (select code from w where w.t = ts.t union select code from w where w.t = ts.pt) c
  left join w a on a.t = ts.t and a.code = c.code left join w b on b.t = ts.pt and b.code = c.code group by ts.t)
select g.date, g.t, floor(gross * 1e6 + 0.5) / 1e6 as gross, floor(turnover * 1e6 + 0.5) / 1e6 as turnover, floor((gross - turnover * 0.0023 - 0.02 * 4 / 252.0 * short) * 1e6 + 0.5) / 1e6 as net from g join tn using (t)"""


def long_only_top(spark, sf):
    return B.rank_tilt(panel(spark, sf), 4, min_names=5, adv_window=8, long_only=True, top_n=3).withColumn("t", F.col("t").cast("long"))


TOP_SQL = f"""with {ELIGIBLE_SQL.format(h=4, e=4)}, w as (select *, case when row_number() over (partition by t order by signal desc, code) <= 3 then 1.0 / least(3, n) else 0 end::double as w from ok where n >= 5),
ts as (select t, lag(t) over (order by t) as pt from (select distinct t from w)), g as (select t, max(date) as date, sum(w * ret) - avg(ret) as gross from w group by t),
tn as (select ts.t, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) as turnover from ts, lateral (select code from w where w.t = ts.t union select code from w where w.t = ts.pt) c
  left join w a on a.t = ts.t and a.code = c.code left join w b on b.t = ts.pt and b.code = c.code group by ts.t)
select g.date, g.t, floor(gross * 1e6 + 0.5) / 1e6 as gross, floor(turnover * 1e6 + 0.5) / 1e6 as turnover, floor((gross - turnover * 0.0023) * 1e6 + 0.5) / 1e6 as net from g join tn using (t)"""


def staggered_tranches(spark, sf):
    return B.staggered_tranches(panel(spark, sf), 12, 4, 3, 0.0, 8, 130, 5)


STAGGER_SQL = f"""with {PANEL_SQL}, r as (select *, lead(close, 4) over w / close - 1 as ret, max(t) over () as last, case when count(*) over v = 8 then avg(trade_value) over v end as adv from panel
  window w as (partition by code order by t), v as (partition by code order by t rows between 8 preceding and 1 preceding)),
ok as (select *, count(*) over (partition by t) as n from r where signal is not null and adv >= 0 and (t - 130) % 4 = 0),
bk as (select code, t from (select *, row_number() over (partition by t order by signal desc, code) as p from ok where n >= 5) where p <= 3),
h as (select b.t + k.k * 4 as t, k.k, avg(r.ret) as book from bk b cross join (select unnest([0, 1, 2]) as k) k join r on r.code = b.code and r.t = b.t + k.k * 4 group by 1, 2),
bench as (select t, date, avg(ret) as bench, max(n) as n_universe from ok where n >= 5 and t >= 130 and t < last - 4 group by t, date)
select date, t, floor((avg(book) - max(bench)) * 1e6 + 0.5) / 1e6 as gross, 1.0::double / 3 as turnover, floor((avg(book) - max(bench)) * 1e6 + 0.5) / 1e6 as net, floor(avg(book) * 1e6 + 0.5) / 1e6 as book,
  floor(max(bench) * 1e6 + 0.5) / 1e6 as bench, max(n_universe) as n_universe from h join bench using (t) group by date, t"""


def signal_turnover(spark, sf):
    return B.signal_turnover(panel(spark, sf), 0.2).select("date", "turnover")


STURN_SQL = f"""with {PANEL_SQL}, top as (select code, date, t from (select *, row_number() over (partition by t order by signal desc, code) as p, count(*) over (partition by t) as n from panel where signal is not null) where p <= greatest(1, floor(n * 0.2)))
select a.date, floor((1 - count(b.code) / max(c.n)::double) * 1e6 + 0.5) / 1e6 as turnover from top a left join top b on b.code = a.code and b.t = a.t - 1 join (select t, count(*) as n from top group by t) c on c.t = a.t - 1 group by a.date"""


def intraday_overnight(spark, sf):
    return B.intraday_overnight(S.bars(spark, sf)).select("code", "date", r6("intraday_bp").alias("intraday_bp"), r6("overnight_bp").alias("overnight_bp"), r6("close_to_close_bp").alias("close_to_close_bp"))


IO_SQL = f"""with {BARS}, p as (select *, lag(close) over (partition by code order by date) as prev from bars)
select code, date, floor((close / open - 1) * 1e4 * 1e6 + 0.5) / 1e6 as intraday_bp, floor((open / prev - 1) * 1e4 * 1e6 + 0.5) / 1e6 as overnight_bp, floor((close / prev - 1) * 1e4 * 1e6 + 0.5) / 1e6 as close_to_close_bp from p"""


def _revisions(spark, sf):
    l, o = S.table(spark, sf, "lineitem"), S.table(spark, sf, "orders")
    known = F.expr("date_add(cast(l_shipdate as date), cast(l_linenumber * 5 as int))")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("date"), known.alias("known"), F.col("l_quantity").cast("double").alias("value"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


REV_SQL = """rev as (select l_suppkey as code, cast(l_shipdate as date) as date, cast(l_shipdate as date) + cast(l_linenumber * 5 as int) as known, l_quantity::double as value, l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem join orders on l_orderkey = o_orderkey)"""


def shares_asof_revisions(spark, sf):
    """Latest value date among what was known by each week's start, ties to the later knowledge."""
    rev = _revisions(spark, sf)
    order = F.struct("date", "known", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "value")
    best = F.max(order).over(W.partitionBy("code").orderBy("known", "date", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(X.UP, 0))
    states = rev.withColumn("best", best).select("code", "known", F.col("best.date").alias("value_date"), F.col("best.value").alias("value"), F.col("date").alias("d2"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    weeks = S.bars(spark, sf).select("code", "date")
    return X.as_of(weeks, states, ["code"], "date", "known", ["value_date", "value"], strict=True, ties=["d2", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


SHARES_SQL = f"""with {BARS}, {REV_SQL}, j as (select b.code, b.date, r.date as value_date, r.value, row_number() over (partition by b.code, b.date order by r.date desc, r.known desc, r.l_orderkey desc, r.l_linenumber desc, r.l_partkey desc, r.l_extendedprice desc) as rn
  from bars b join rev r on r.code = b.code and r.known < b.date)
select b.code, b.date, j.value_date, j.value from bars b left join j on j.code = b.code and j.date = b.date and j.rn = 1"""


def corp_action_roll(spark, sf):
    """Log of the product of (1 - discount) over the events of the last 90 days: prefix sums by two as-of joins."""
    ev = S.table(spark, sf, "lineitem").filter("l_linenumber = 1 and l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("date")).agg(F.sum(F.ln(1 - F.col("l_discount").cast("double"))).alias("x"))
    cum = ev.withColumn("cum", F.sum("x").over(W.partitionBy("code").orderBy("date"))).select("code", "date", "cum")
    b = S.bars(spark, sf).select("code", "date", F.date_sub("date", 90).alias("ref"))
    at = X.as_of(b, cum, ["code"], "date", "date", ["cum"]).withColumnRenamed("cum", "c1")
    both = X.as_of(at, cum, ["code"], "ref", "date", ["cum"])
    return both.select("code", "date", r6(F.coalesce("c1", F.lit(0.0)) - F.coalesce("cum", F.lit(0.0))).alias("log_factor"))


ROLL_SQL = f"""with {BARS}, ev as (select l_suppkey as code, cast(l_shipdate as date) as date, ln(1 - l_discount::double) as x from lineitem where l_linenumber = 1 and l_returnflag = 'A')
select b.code, b.date, floor(coalesce(sum(e.x), 0) * 1e6 + 0.5) / 1e6 as log_factor from bars b left join ev e on e.code = b.code and e.date > b.date - 90 and e.date <= b.date group by b.code, b.date"""


def merger_gap_mask(spark, sf):
    ev = S.table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("date")).distinct().withColumn("event", F.col("date"))
    b = S.bars(spark, sf).select("code", "date")
    return X.as_of(b, ev, ["code"], "date", "date", ["event"]).select("code", "date", F.coalesce(F.col("event") > F.date_sub("date", 30), F.lit(False)).alias("masked"))


GAP_SQL = f"""with {BARS} select code, date, exists (select 1 from lineitem where l_quantity >= 49 and l_suppkey = code and cast(l_shipdate as date) > date - 30 and cast(l_shipdate as date) <= date) as masked from bars"""


def sector_asof(spark, sf):
    """Sector of a code in the last snapshot at or before the date; a code that snapshot lacks has none."""
    s, n = S.table(spark, sf, "supplier"), S.table(spark, sf, "nation")
    member = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("sector"))
    snaps = S.calendar(spark, sf).filter("idx % 60 = 0").select("date").withColumn("snapshot", F.col("date")).withColumn("k", F.lit(1))
    rows = snaps.crossJoin(F.broadcast(member)).filter((F.col("code") + F.dayofmonth("snapshot")) % 5 != 0).select("snapshot", "code", "sector")
    b = S.bars(spark, sf).select("code", "date")
    days = X.as_of(b.select("date").distinct().withColumn("k", F.lit(1)), snaps, ["k"], "date", "date", ["snapshot"]).drop("k")
    return b.join(F.broadcast(days), "date", "left").join(rows, ["snapshot", "code"], "left").select("code", "date", "sector")


SECTOR_SQL = f"""with {BARS}, {S.CALENDAR_SQL}, snaps as (select date as snapshot from calendar where idx % 60 = 0),
m as (select snapshot, s_suppkey as code, n_name as sector from snaps, supplier join nation on s_nationkey = n_nationkey where (s_suppkey + day(snapshot)) % 5 <> 0)
select b.code, b.date, m.sector from bars b left join m on m.code = b.code and m.snapshot = (select max(snapshot) from snaps where snapshot <= b.date)"""


def base_price_priority(spark, sf):
    """First of several price sources by priority."""
    b = S.bars(spark, sf)
    src = [b.filter("code % 3 = 0").select("code", "date", F.lit(1).alias("prio"), F.col("close").alias("price")), b.filter("volume > 60").select("code", "date", F.lit(2).alias("prio"), F.col("open").alias("price")), b.select("code", "date", F.lit(3).alias("prio"), F.col("low").alias("price"))]
    u = src[0].unionByName(src[1]).unionByName(src[2])
    return u.groupBy("code", "date").agg(F.min_by("price", "prio").alias("price"), F.min("prio").alias("source"))


BASE_SQL = f"""with {BARS}, u as (select code, date, 1 as prio, close as price from bars where code % 3 = 0 union all select code, date, 2, open from bars where volume > 60 union all select code, date, 3, low from bars)
select code, date, price, prio as source from (select *, row_number() over (partition by code, date order by prio) as rn from u) where rn = 1"""


def base_from_change(spark, sf):
    """Previous price from a price and its rounded change: the coarsest grid that gives the change back."""
    b = S.bars(spark, sf).withColumn("p", F.lag("close").over(W.partitionBy("code").orderBy("date"))).filter("p is not null")
    b = b.withColumn("c", F.rint(F.col("close") * 10)).withColumn("chg", F.floor((F.col("close") / F.col("p") - 1) * 1e4 + 0.5))
    b0 = F.col("c") / (1 + F.col("chg") / 1e4)
    out = None
    for g in (1000.0, 500.0, 100.0, 50.0, 10.0, 5.0, 1.0):
        v = F.rint(b0 / g) * g
        fits = (v > 0) & (F.abs((F.try_divide(F.col("c"), v) - 1) * 1e4 - F.col("chg")) <= 0.5001)
        out = F.when(fits, v) if out is None else out.when(fits, v)
    return b.select("code", "date", out.alias("base"))


_V = "round_even(c / (1 + chg / 1e4) / {g}, 0) * {g}"
BFC_SQL = f"""with {BARS}, p as (select code, date, round_even(close * 10, 0) as c, close, lag(close) over (partition by code order by date) as p from bars), q as (select *, floor((close / p - 1) * 1e4 + 0.5) as chg from p where p is not null)
select code, date, case {' '.join(f"when {_V.format(g=g)} > 0 and abs((c / nullif({_V.format(g=g)}, 0) - 1) * 1e4 - chg) <= 0.5001 then {_V.format(g=g)}" for g in ('1000.0::double', '500.0::double', '100.0::double', '50.0::double', '10.0::double', '5.0::double', '1.0::double'))} end as base from q"""


def equity_sets(spark, sf):
    """Codes with and without a listing: semi and anti join."""
    b = S.bars(spark, sf)
    listed = S.table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("code")).union(S.table(spark, sf, "supplier").filter("s_nationkey < 3").select("s_suppkey")).distinct()
    yes = b.join(listed, "code", "left_semi").groupBy(F.lit("listed").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("codes"))
    return yes.unionByName(b.join(listed, "code", "left_anti").groupBy(F.lit("other").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("codes")))


EQUITY_SQL = f"""with {BARS}, listed as (select s_suppkey as code from supplier where s_acctbal > 0 union select s_suppkey from supplier where s_nationkey < 3)
select case when code in (select code from listed) then 'listed' else 'other' end as kind, count(*) as n, count(distinct code) as codes from bars group by 1"""


def drift_summary(spark, sf):
    io = B.intraday_overnight(S.bars(spark, sf)).filter("intraday_bp is not null").withColumn("bucket", F.col("code") % 3)
    days = io.groupBy("bucket", "date").agg(F.avg("intraday_bp").alias("m"))
    months = io.groupBy("bucket", F.date_trunc("month", "date").alias("month")).agg(F.avg("intraday_bp").alias("m"))
    a = io.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("intraday_bp")).alias("mean"), r6(F.median("intraday_bp")).alias("median"))
    return a.join(days.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_days")), "bucket").join(months.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_months"), r6(F.avg((F.col("m") < 0).cast("double"))).alias("neg_month_share")), "bucket")


DRIFT_SQL = f"""with {BARS}, io as (select code % 3 as bucket, date, (close / open - 1) * 1e4 as v from bars where open > 0 and close > 0),
d as (select bucket, count(distinct date) as n_days from io group by bucket), m as (select bucket, date_trunc('month', date) as mo, avg(v) as m from io group by 1, 2),
ms as (select bucket, count(*) as n_months, floor(avg((m < 0)::int::double) * 1e6 + 0.5) / 1e6 as neg_month_share from m group by bucket)
select bucket, n, mean, median, n_days, n_months, neg_month_share from (select bucket, count(*) as n, floor(avg(v) * 1e6 + 0.5) / 1e6 as mean, floor(median(v) * 1e6 + 0.5) / 1e6 as median from io group by bucket) join d using (bucket) join ms using (bucket)"""

QUERIES = {
    "bars_rollup": (bars_rollup, f"with {BARS} select * from bars", "date"),
    "fingerprint_by_year": (fingerprint, FINGERPRINT_SQL),
    "yearly_copy": (yearly_copy, YEARLY_SQL),
    "panel_dense": (panel_dense, f"with {PANEL_SQL} select code, date, t, close, trade_value from panel", "date"),
    "adv_windows": (adv_windows, ADV_SQL, "date"),
    "forward_returns": (forward_returns, FWD_SQL, "date"),
    "pct_rank_avg": (pct_rank_avg, PCT_SQL, "date"),
    "rank_buckets": (rank_bucket_rows, BUCKET_SQL, "date"),
    "quantile_summary": (quantile_summary, QSUM_SQL),
    "rank_ic_series": (rank_ic_series, IC_SQL, "date"),
    "ic_decay": (ic_decay, DECAY_SQL),
    "rank_tilt_periods": (rank_tilt_periods, TILT_SQL, "date"),
    "long_only_top": (long_only_top, TOP_SQL, "date"),
    "staggered_tranches": (staggered_tranches, STAGGER_SQL, "date"),
    "signal_turnover": (signal_turnover, STURN_SQL, "date"),
    "intraday_overnight": (intraday_overnight, IO_SQL, "date"),
    "shares_asof_revisions": (shares_asof_revisions, SHARES_SQL, "date value_date"),
    "corp_action_roll": (corp_action_roll, ROLL_SQL, "date"),
    "merger_gap_mask": (merger_gap_mask, GAP_SQL, "date"),
    "sector_asof_snapshot": (sector_asof, SECTOR_SQL, "date"),
    "base_price_priority": (base_price_priority, BASE_SQL, "date"),
    "base_from_change": (base_from_change, BFC_SQL, "date"),
    "equity_sets": (equity_sets, EQUITY_SQL),
    "drift_summary": (drift_summary, DRIFT_SQL),
}

"""Queries of statistics, validation and resampling over trades and series, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.operators import cross_section as B
from quantweft.operators import resampling as R
from quantweft.operators import statistics as T
from quantweft.plans import panel_queries as P
from quantweft.sources import shapes as S
from quantweft.sources.shapes import r6

TRADES = S.TRADES_SQL


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def newey_west(spark, sf):
    out = T.newey_west(P.rank_ic_series(spark, sf), "ic", "date", 4)
    return out.select("n", r6("mean").alias("mean"), r6("t").alias("t"))


NW_SQL = f"""with s as (select date, ic from ({P.IC_SQL})), d as (select *, ic - avg(ic) over () as d from s), l as (select *, lag(d, 1) over w as l1, lag(d, 2) over w as l2, lag(d, 3) over w as l3, lag(d, 4) over w as l4 from d window w as (order by date)),
g as (select count(*) as n, avg(ic) as mean, sum(d * d) + 2 * (0.8 * sum(d * l1) + 0.6 * sum(d * l2) + 0.4 * sum(d * l3) + 0.2 * sum(d * l4)) as v from l)
select n, {_r6('mean')} as mean, {_r6('mean / (sqrt(v) / n)')} as t from g"""


def summarize_periods(spark, sf):
    return T.summarize_periods(P.rank_tilt_periods(spark, sf), 4)


SUMMARY_SQL = f"""with p as ({P.TILT_SQL}), a as (select count(*) as n, avg(net) as m, stddev_pop(net) as sd, avg((net > 0)::int::double) as hit, sum(net) as cum, avg(turnover) as turnover, avg(net) filter (net > 0) as avg_win, avg(net) filter (net < 0) as avg_loss, max(net) as best, min(net) as worst from p)
select n, {_r6('(pow(1 + m, 63.0) - 1) / (sd * sqrt(63.0))')} as ann_sharpe, {_r6('m / sd * sqrt(n)')} as t, {_r6('hit')} as hit, {_r6('cum')} as cum, {_r6('turnover')} as turnover, {_r6('avg_win')} as avg_win, {_r6('avg_loss')} as avg_loss,
  {_r6('avg_win / -avg_loss')} as payoff, {_r6('best')} as best, {_r6('worst')} as worst from a"""


def _returns(spark, sf):
    b = S.bars(spark, sf)
    return b.withColumn("x", F.col("close") / F.col("open") - 1).withColumn("x", F.when(F.col("x").between(-0.5, 0.5), F.col("x"))).filter("x is not null").select("code", "date", "x")


RETURNS_SQL = f"{S.BARS_SQL}, rets as (select code, date, close / open - 1 as x from bars where close / open - 1 between -0.5 and 0.5)"


def max_drawdown(spark, sf):
    return T.drawdown(_returns(spark, sf), "x", ["date"], ["code"])


DD_SQL = f"""with {RETURNS_SQL}, g as (select code, date, x, sum(ln(1 + x)) over (partition by code order by date) as g from rets), p as (select *, greatest(max(g) over (partition by code order by date), 0) as peak from g)
select code, {_r6('min(exp(g - peak) - 1)')} as max_drawdown, {_r6('exp(sum(ln(1 + x))) - 1')} as growth, count(*) as n from p group by code"""


def sample_moments(spark, sf):
    m = T.moments(_returns(spark, sf), "x", ["code"])
    return m.select("code", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("skew").alias("skew"), r6("kurt").alias("kurt"))


MOMENTS_SQL = f"""with {RETURNS_SQL}, c as (select code, x, x - avg(x) over (partition by code) as d from rets), m as (select code, count(*) as n, avg(x) as mean, stddev_samp(x) as sd, avg(d * d) as m2, avg(d * d * d) as m3, avg(d * d * d * d) as m4 from c group by code)
select code, n, {_r6('mean')} as mean, {_r6('sd')} as sd, {_r6('m3 / pow(m2, 1.5)')} as skew, {_r6('m4 / (m2 * m2)')} as kurt from m"""


def deflated_sharpe(spark, sf):
    return T.deflated_sharpe(_returns(spark, sf), "x", ["code"], 20, 0.1)


def monster_share(spark, sf):
    return T.fragility(S.trades(spark, sf), "r", "trade_id", ["stratum"], 10)


MONSTER_SQL = f"""with {TRADES}, k as (select *, row_number() over (partition by stratum order by r desc, trade_id) as p from trades)
select stratum, count(*) as n, {_r6('sum(r)')} as total, {_r6('sum(r) filter (p <= 10 and r > 0) / sum(r) filter (r > 0)')} as monster_share, {_r6('avg(r) filter (p > 10)')} as mean_without_top, {_r6('sum(r) filter (p > 10)')} as sum_without_top,
  {_r6('median(r)')} as median, {_r6('avg((r > 0)::int::double)')} as win_rate, {_r6('avg(r) filter (r > 0)')} as avg_win, {_r6('avg(r) filter (r <= 0)')} as avg_loss from k group by stratum"""


def loss_streak(spark, sf):
    return T.loss_streaks(S.trades(spark, sf), "r", ["code"], ["entry_date", "trade_id"], -0.2)


STREAK_SQL = f"""with {TRADES}, i as (select *, sum((r > -0.2)::int) over (partition by code order by entry_date, trade_id) as isl from trades), s as (select code, isl, count(*) as n from i where r <= -0.2 group by code, isl)
select t.code, coalesce(max(s.n), 0) as max_streak from (select distinct code from trades) t left join s on s.code = t.code group by t.code"""


def expected_max_curve(spark, sf):
    t = S.trades(spark, sf)
    out = None
    for m in (1, 2, 5):
        one = T.expected_max_of(t, "r", m).withColumn("m", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


EMAX_SQL = " union all ".join(
    f"""select max(n) as n, {_r6('sum(r * w)')} as expected_max, {m}::int as m from (select r, n, case when i >= {m - 1} then {' * '.join([f'{float(m)} / n', *[f'(i - {j - 1})::double / (n - {j})' for j in range(1, m)]])} else 0 end as w
  from (select r, row_number() over (order by r) - 1 as i, count(*) over () as n from trades))"""
    for m in (1, 2, 5)
)
EMAX_SQL = f"with {TRADES} {EMAX_SQL}"

FOLDS = T.rolling_folds(1995, 1998, 1, 1)


def _folded(spark, sf):
    folds = spark.createDataFrame([tuple(f.values()) for f in FOLDS], "fold int, train_lo string, test_lo string, test_hi string")
    t = S.trades(spark, sf).withColumn("exit_date", F.date_add("entry_date", F.pmod(F.col("trade_id"), F.lit(45)).cast("int")))
    return T.purge_embargo(t, folds, "entry_date", "exit_date", 10)


_FOLD_VALUES = ", ".join(f"({f['fold']}, date '{f['train_lo']}', date '{f['test_lo']}', date '{f['test_hi']}')" for f in FOLDS)
FOLDED_SQL = f"""{TRADES}, folds(fold, train_lo, test_lo, test_hi) as (values {_FOLD_VALUES}),
folded as (select t.*, f.fold, entry_date >= test_lo and entry_date < test_hi as in_test, entry_date >= train_lo and entry_date < test_lo and entry_date + cast(trade_id % 45 as int) < test_lo and not (entry_date >= test_hi and entry_date < test_hi + 10) as in_train from trades t, folds f)"""


def purge_embargo_counts(spark, sf):
    return _folded(spark, sf).groupBy("fold").agg(F.sum(F.col("in_train").cast("long")).alias("n_train"), F.sum(F.col("in_test").cast("long")).alias("n_test"), r6(F.sum(F.when(F.col("in_train"), F.col("r")))).alias("train_sum"))


PURGE_SQL = f"with {FOLDED_SQL} select fold, sum(in_train::int)::bigint as n_train, sum(in_test::int)::bigint as n_test, {_r6('sum(r) filter (in_train)')} as train_sum from folded group by fold"


def fold_consistency(spark, sf):
    return T.fold_consistency(_folded(spark, sf).withColumn("feature", F.pmod(F.col("trade_id") * 37, F.lit(101)).cast("double")), "feature", "r", 0.2, 30)


FOLDC_SQL = f"""with {FOLDED_SQL}, x as (select *, (trade_id * 37) % 101::double as feature from folded), tr as (select fold, quantile_cont(feature, 0.8) as theta, count(*) as n_train from x where in_train group by fold),
te as (select x.fold, count(*) as n_test, avg(r) as m from x join tr using (fold) where in_test and feature >= theta group by x.fold)
select fold, {_r6('theta')} as theta, n_train, coalesce(n_test, 0) as n_test, {_r6('m')} as test_mean, case when n_train < 30 then 'train_short' when coalesce(n_test, 0) < 30 then 'sparse' else 'ok' end as status from tr left join te using (fold)"""


def performance_metrics(spark, sf):
    l = S.table(spark, sf, "lineitem").withColumn("pnl", (F.col("l_extendedprice") - 30000) / 100 - F.col("l_tax") * 100).withColumn("leave", F.when(F.col("l_quantity") > 1, F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int"))))
    return T.performance_metrics(l, F.col("pnl"), "l_shipdate", "leave", ["leave", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 1e6, ["l_suppkey"])


PERF_SQL = f"""with l as (select *, l_shipdate::date + l_quantity::int as l_receiptdate, ((l_extendedprice - 30000) / 100 - l_tax * 100)::decimal(20,4) as p from lineitem where l_quantity > 1),
e as (select *, 1e6 + (sum(p) over w)::double as eq from l window w as (partition by l_suppkey order by l_receiptdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
t as (select *, greatest(1e6, max(eq) over w) as top, eq / case when lag(eq) over w > 0 then lag(eq) over w end - 1 as r from e window w as (partition by l_suppkey order by l_receiptdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
g as (select l_suppkey, sum(p)::double as total, count(*) as n, count(*) filter (p > 0) as wins, count(*) filter (p < 0) as losses, coalesce(sum(p) filter (p > 0), 0)::double as won, coalesce(-sum(p) filter (p < 0), 0)::double as lost, max(1 - eq / top) as dd,
  avg(date_diff('day', l_shipdate::date, l_receiptdate::date) * 24.0::double) as hours, max(p)::double as best, min(p)::double as worst, avg(r) as r, stddev_samp(r) as sd, stddev_samp(r) filter (r < 0) as down,
  date_diff('day', min(l_shipdate)::date, max(l_receiptdate)::date) / 365.25::double as years from t group by 1)
select l_suppkey, total as total_return, {_r6('total / 1e6')} as total_return_pct, {_r6('case when years > 0 and total / 1e6 > -1 then pow(1 + total / 1e6, 1 / years) - 1 else 0 end')} as annualized_return,
  {_r6('case when sd > 0 then r * 252 / (sd * sqrt(252)) else 0 end')} as sharpe_ratio, {_r6('case when down > 0 then r * 252 / (down * sqrt(252)) else 0 end')} as sortino_ratio, {_r6('dd * 1e6')} as max_drawdown, {_r6('dd')} as max_drawdown_pct,
  {_r6('wins / n')} as win_rate, {_r6("case when lost > 0 then won / lost else 'infinity'::double end")} as profit_factor, n as total_trades, wins as winning_trades, losses as losing_trades,
  {_r6('case when wins > 0 then won / wins else 0 end')} as avg_win, {_r6('case when losses > 0 then lost / losses else 0 end')} as avg_loss, {_r6('hours')} as avg_trade_duration_hours, best as best_trade, worst as worst_trade from g"""


def r_distribution(spark, sf):
    return T.r_distribution(S.trades(spark, sf), "r", ["code"])


RDIST_SQL = f"""with {TRADES} select code, count(r) as n, {_r6('avg(r)')} as expectancy, {_r6('avg((r >= 3)::int::double)')} as tail3, {_r6('avg(r) filter (r > 0) / -avg(r) filter (r < 0)')} as payoff from trades group by code"""


def selection_pool(spark, sf):
    rows = S.trades(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("size"), F.avg("r").alias("m")).withColumn("key", r6("m"))
    return T.selection_pool(rows, "key", "size", 10)


POOL_SQL = f"""with {TRADES}, k as (select code, count(*) as size, {_r6('avg(r)')} as key from trades group by code having count(*) >= 10), q as (select *, floor((row_number() over (order by size, key) - 1) * 4 / count(*) over ())::int as quartile from k)
select quartile, count(*) as n, {_r6('avg(key)')} as mean, {_r6('max(key)')} as best, {_r6('max(key) - avg(key)')} as premium, {_r6('stddev_samp(key)')} as sd from q group by quartile"""


def regime_buckets(spark, sf):
    s = P.rank_ic_series(spark, sf)
    n = F.count(F.lit(1)).over(W.partitionBy())
    k = F.least(F.floor((F.row_number().over(W.orderBy("date")) - 1) / F.floor(n / 4)), F.lit(3))
    return s.withColumn("regime", k).groupBy("regime").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ic")).alias("mean"), F.signum(F.avg("ic")).alias("sign"))


REGIME_SQL = f"""with s as ({P.IC_SQL}), k as (select *, least((row_number() over (order by date) - 1) // (count(*) over () // 4), 3)::bigint as regime from s)
select regime, count(*) as n, {_r6('avg(ic)')} as mean, sign(avg(ic))::double as sign from k group by regime"""


def block_bootstrap(spark, sf):
    monthly = S.trades(spark, sf).groupBy(F.date_trunc("month", "entry_date").cast("date").alias("month")).agg(F.avg("r").alias("x"))
    return R.block_bootstrap(monthly, "x", "month", block=4, replicates=200, seed=11)


def _h32(x: str) -> str:
    a = f"xor(({x})::bigint & 4294967295, (({x})::bigint & 4294967295) >> 16)"
    b = f"({a} * 2146121005) & 4294967295"
    c = f"(xor({b}, ({b}) >> 15) * 1540483477) & 4294967295"
    return f"xor({c}, ({c}) >> 16)"


def _drawn(seed: int, row: str, k: str, n: str, source: str, keep: str) -> str:
    """Steps of the hash one at a time: keep, at = a number 0..n-1."""
    from quantweft.operators.resampling import seeded

    return f"""(select {keep}, (({_h32('z')}) * ({n})) >> 32 as spot from (select *, xor({_h32('y')}, {_h32(f'{k} * 3 + 1')}) as z from (select *, xor({seeded(seed)}::bigint, {_h32(f'{row} + 668265263')}) as y from {source})))"""


def boot_sql(series: str, block: int, replicates: int, seed: int, per_year: int) -> str:
    """series: rows (month, x)."""
    return f"""with {TRADES}, m as ({series}), s as (select x, row_number() over (order by month) - 1 as i, count(*) over () as n from m), nn as (select max(n) as n from s),
dr as (select rep, blk, n from range(0, {replicates}) a(rep), nn, lateral (select unnest(range(0, ceil(n / {block}.0)::bigint)) as blk)), st as {_drawn(seed, 'rep', 'blk', f'n - {block - 1}', 'dr', 'rep, blk, n')},
ix as (select rep, n, blk * {block} + o as pos, spot + o as i from st, range(0, {block}) r(o)), b as (select rep, avg(s.x) * {per_year} as mean from ix join s on s.i = ix.i where pos < ix.n group by rep)
select count(*) as replicates, {_r6('avg(mean)')} as mean, {_r6('quantile_cont(mean, 0.05)')} as lower, {_r6('quantile_cont(mean, 0.95)')} as upper from b"""


BOOT_SQL = boot_sql("select date_trunc('month', entry_date)::date as month, avg(r) as x from trades group by 1", 4, 200, 11, 12)


def _times(seed: int, key: str, replicates: int, source: str, keep: str) -> str:
    """keep, rep, times: how often each row of source is drawn in each replicate, by the hash's steps."""
    from quantweft.operators.resampling import POISSON, seeded

    m = 4294967295
    one = f"(select {keep}, k, {_h32('x')} as x from (select {keep}, k, ((k & {m}) + 668265263) & {m} as x from (select *, ({key})::bigint as k from {source})))"
    two = f"(select {keep}, {_h32('x')} as x from (select {keep}, xor(xor(x, {seeded(seed)}::bigint), (k >> 32) & {m}) as x from {one}))"
    each = f"(select {keep}, rep, {_h32('x')} as u from (select {keep}, rep, xor(x, {_h32('rep * 3 + 1')}) as x from {two}, range(0, {replicates}) rr(rep)))"
    return f"(select {keep}, rep, ({' + '.join(f'(u >= {t})::int' for t in POISSON)})::double as times from {each} where u >= {POISSON[0]})"


_MONTH = "date_trunc('month', entry_date)::date"


def _cluster_boot(rows: str, replicates: int, seed: int) -> str:
    """Steps after `rows` (cluster text, x): the interval of a mean by whole clusters."""
    return f"""cl as (select cluster, sum(x) as s, count(*)::double as w from ({rows}) group by cluster), bm as (select rep, sum(times * s) / sum(times * w) as m from {_times(seed, "'0x' || sha256(cluster)[1:15]", replicates, 'cl', 's, w')} group by rep),
bo as (select quantile_cont(m, 0.025) as lower, quantile_cont(m, 0.975) as upper, avg((m > 0)::int::double) as positive from bm), wh as (select count(*) as n_clusters, sum(s) / sum(w) as mean from cl)"""


CLUSTER_BOOT_SQL = f"""with {TRADES}, {_cluster_boot(f'select cast({_MONTH} as varchar) as cluster, r as x from trades', 2000, 3)}
select n_clusters, {_r6('mean')} as mean, {_r6('lower')} as lower, {_r6('upper')} as upper, {_r6('positive')} as positive from wh, bo"""
CLUSTER_DIFF_SQL = f"""with {TRADES}, cl as (select cast({_MONTH} as varchar) as cluster, coalesce(sum(r) filter (code < 25), 0) as sa, count(r) filter (code < 25) as na, coalesce(sum(r) filter (code >= 25), 0) as sb, count(r) filter (code >= 25) as nb from trades group by 1),
bm as (select rep, sum(times * sa) / nullif(sum(times * na), 0) - sum(times * sb) / nullif(sum(times * nb), 0) as m from {_times(3, "'0x' || sha256(cluster)[1:15]", 2000, 'cl', 'sa, na, sb, nb')} group by rep),
bo as (select quantile_cont(m, 0.025) as lower, quantile_cont(m, 0.975) as upper from bm where m is not null), wh as (select count(*) as n_clusters, sum(sa) / sum(na) - sum(sb) / sum(nb) as difference from cl)
select n_clusters, {_r6('difference')} as difference, {_r6('lower')} as lower, {_r6('upper')} as upper from wh, bo"""
IID_SQL = f"""with {TRADES}, d as {_times(7, 'trade_id', 500, '(select * from trades where r is not null)', 'stratum, r')}, bm as (select stratum, rep, sum(times * r) / sum(times) as m from d group by all),
bo as (select stratum, quantile_cont(m, 0.025) as lower, quantile_cont(m, 0.975) as upper from bm group by stratum), wh as (select stratum, count(r) as n, avg(r) as mean from trades group by stratum)
select stratum, n, {_r6('mean')} as mean, {_r6('lower')} as lower, {_r6('upper')} as upper from wh left join bo using (stratum)"""


def _paired_sql(block: int, replicates: int, seed: int, per_year: int) -> str:
    boot = boot_sql("m_", block, replicates, seed, per_year)
    steps = boot[: boot.index(", b as (select rep")].replace("(m_)", "(select entry_date, avg(r) filter (code < 25) / 100 as a, avg(r) filter (code >= 25) / 100 as b from trades group by 1 having count(*) filter (code < 25) > 0 and count(*) filter (code >= 25) > 0)")
    steps = steps.replace("select x, row_number() over (order by month)", "select a, b, row_number() over (order by entry_date)")
    ratio = lambda c: f"case when stddev_pop({c}) >= 1e-12 then avg({c}) / stddev_pop({c}) * sqrt({per_year}.0) end"
    growth = lambda c: f"exp(sum(ln(1 + {c})) * {per_year}.0 / max(ix.n)) - 1"
    return f"""{steps}, e as (select rep, {ratio('s.a')} - {ratio('s.b')} as sharpe, {growth('s.a')} - ({growth('s.b')}) as cagr from ix join s on s.i = ix.i where pos < ix.n group by rep)
select (select max(n) from s) as n, {_r6('quantile_cont(sharpe, 0.025)')} as sharpe_lower, {_r6('quantile_cont(sharpe, 0.975)')} as sharpe_upper, {_r6('quantile_cont(cagr, 0.025)')} as cagr_lower, {_r6('quantile_cont(cagr, 0.975)')} as cagr_upper, {_r6('avg((sharpe > 0)::int::double)')} as prob_better from e"""


PAIRED_BOOT_SQL = _paired_sql(6, 2000, 3, 252)


def matched_control(spark, sf):
    t = S.trades(spark, sf)
    return R.matched_control(t.filter("code < 5"), t.filter("code >= 5"), "trade_id", ["stratum"], "r", per=3, seed=5)


MATCH_SQL = f"""with {TRADES}, tr as (select * from trades where code < 5), po as (select *, row_number() over (partition by stratum order by trade_id) - 1 as rn, count(*) over (partition by stratum) as n from trades where code >= 5),
c as (select stratum, max(n) as n from po group by stratum), dr as (select tr.trade_id, tr.stratum, tr.r, k, c.n from tr join c using (stratum), range(0, 3) x(k)),
st as {_drawn(5, 'trade_id', 'k', 'n', 'dr', 'trade_id, stratum, r, n')}, m as (select st.stratum, st.trade_id, st.r, avg(po.r) as control from st join po on po.stratum = st.stratum and po.rn = st.spot group by 1, 2, 3)
select stratum, count(*) as n, {_r6('avg(r)')} as trade_mean, {_r6('avg(control)')} as control_mean, {_r6('avg(r - control)')} as alpha from m group by stratum"""

ALPHA_SQL = f"""with {TRADES}, tr as (select * from trades where code < 5), po as (select *, row_number() over (partition by stratum order by trade_id) - 1 as rn, count(*) over (partition by stratum) as n from trades where code >= 5),
c as (select stratum, max(n) as n from po group by stratum), dr as (select tr.trade_id, tr.stratum, tr.entry_date, tr.r, k, c.n from tr join c using (stratum), range(0, 3) x(k)),
st as {_drawn(5, 'trade_id', 'k', 'n', 'dr', 'trade_id, stratum, entry_date, r, n')}, ea as (select st.trade_id, st.entry_date, st.r - avg(po.r) as x from st join po on po.stratum = st.stratum and po.rn = st.spot group by st.trade_id, st.entry_date, st.r),
{_cluster_boot('select cast(entry_date as varchar) as cluster, x from ea', 2000, 5)}
select (select count(*) from ea) as n_trades, (select count(*) from tr) - (select count(*) from ea) as n_unmatched, n_clusters, {_r6('mean')} as alpha, {_r6('lower')} as lower, {_r6('upper')} as upper, {_r6('positive')} as p_greater from wh, bo"""


def _rounded(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def matched_alpha(spark, sf):
    t = S.trades(spark, sf)
    return _rounded(R.matched_alpha(t.filter("code < 5"), t.filter("code >= 5"), "trade_id", ["stratum"], "r", "entry_date", 3, 5))


def cluster_bootstrap(spark, sf):
    return _rounded(R.cluster_bootstrap(S.trades(spark, sf), F.col("r"), F.date_trunc("month", "entry_date").cast("date"), seed=3))


def cluster_difference_bootstrap(spark, sf):
    t = S.trades(spark, sf)
    return _rounded(R.cluster_bootstrap_difference(t.filter("code < 25"), t.filter("code >= 25"), F.date_trunc("month", "entry_date").cast("date"), "r", seed=3))


def paired_bootstrap(spark, sf):
    daily = S.trades(spark, sf).groupBy("entry_date").agg((F.avg(F.when(F.col("code") < 25, F.col("r"))) / 100).alias("a"), (F.avg(F.when(F.col("code") >= 25, F.col("r"))) / 100).alias("b"))
    return _rounded(R.paired_bootstrap(daily, "entry_date", "a", "b", seed=3))


def cluster_sums(spark, sf):
    t = S.trades(spark, sf)
    return R.cluster_difference(t.filter("code < 25"), t.filter("code >= 25"), F.date_trunc("month", "entry_date").cast("date"), "r")


CLUSTER_SQL = f"""with {TRADES}, a as (select date_trunc('month', entry_date)::date as cluster, sum(r) as s, count(*) as n from trades where code < 25 group by 1), b as (select date_trunc('month', entry_date)::date as cluster, sum(r) as s, count(*) as n from trades where code >= 25 group by 1)
select coalesce(a.cluster, b.cluster) as cluster, {_r6('coalesce(a.s, 0)')} as sum_a, coalesce(a.n, 0) as n_a, {_r6('coalesce(b.s, 0)')} as sum_b, coalesce(b.n, 0) as n_b from a full join b on a.cluster = b.cluster"""


def iid_bootstrap(spark, sf):
    """Percentile interval of the mean per stratum."""
    return _rounded(R.iid_bootstrap(S.trades(spark, sf), "r", "trade_id", ["stratum"], 500, 7))


def rolling_ic(spark, sf):
    """Non-overlapping observations (greedy, `horizon` apart) and their trailing statistics."""
    return R.rolling_ic(P.rank_ic_series(spark, sf), 4, 12)


QUERIES = {
    "newey_west": (newey_west, NW_SQL),
    "summarize_periods": (summarize_periods, SUMMARY_SQL),
    "max_drawdown": (max_drawdown, DD_SQL),
    "sample_moments": (sample_moments, MOMENTS_SQL),
    "deflated_sharpe": (deflated_sharpe, None),
    "monster_share": (monster_share, MONSTER_SQL),
    "loss_streak": (loss_streak, STREAK_SQL),
    "expected_max_curve": (expected_max_curve, EMAX_SQL),
    "purge_embargo_counts": (purge_embargo_counts, PURGE_SQL),
    "fold_consistency": (fold_consistency, FOLDC_SQL),
    "performance_metrics": (performance_metrics, PERF_SQL),
    "selection_pool": (selection_pool, POOL_SQL),
    "regime_buckets": (regime_buckets, REGIME_SQL),
    "block_bootstrap_h32": (block_bootstrap, BOOT_SQL),
    "matched_control_hash": (matched_control, MATCH_SQL),
    "cluster_sums": (cluster_sums, CLUSTER_SQL, "cluster"),
    "r_distribution": (r_distribution, RDIST_SQL, "code"),
    "matched_alpha": (matched_alpha, ALPHA_SQL),
    "cluster_bootstrap": (cluster_bootstrap, CLUSTER_BOOT_SQL),
    "cluster_difference_bootstrap": (cluster_difference_bootstrap, CLUSTER_DIFF_SQL),
    "paired_bootstrap": (paired_bootstrap, PAIRED_BOOT_SQL),
    "iid_bootstrap": (iid_bootstrap, IID_SQL),
    "rolling_ic": (rolling_ic, None, "date"),
}

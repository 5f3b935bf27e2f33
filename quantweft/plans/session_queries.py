"""Queries of session repair, base prices, exact rolling means and selection reports, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantweft.functions import market as M
from quantweft.operators import exact_sums as E
from quantweft.operators import selection_report as P
from quantweft.operators import sessions as O
from quantweft.operators import statistics as T
from quantweft.plans.market_queries import SQL_TICK
from quantweft.sources import shapes as S
from quantweft.sources.shapes import r6
from quantweft.sources.staging import written

#: Last second of the regular session, the closing auction, the date of later trading and that of today's ticks.
LAST, AUCTION, SINCE, REFORM = 55920, 55800, "1995-01-02", "1993-06-07"
BAR = (*O.PRICES, "volume", "trade_value", "last_sec")


def market(spark, sf):
    """The tables of a market from line items: a supplier is a code, a week a session, trades run from 9:00 to 20:00.

    Some sessions and some daily bars were scaled by later actions, some sessions lack their first bar, some rows are missing.
    """
    l = S.table(spark, sf, "lineitem")
    px = F.greatest(F.rint(F.col("l_extendedprice") / F.col("l_quantity")), F.lit(1.0))
    s = (F.col("l_orderkey") * 37 + F.col("l_partkey") * 11 + F.col("l_linenumber") * 1009) % 39600
    l = l.select(F.col("l_suppkey").alias("code"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"), O.nearest_tick(px).alias("p"), F.col("l_quantity").cast("double").alias("q"), "l_discount", "l_linenumber", F.struct(F.when(s % 4 == 1, F.lit(AUCTION)).otherwise(s + 32400).alias("sec"), "l_orderkey", "l_linenumber", "l_partkey", O.nearest_tick(px).alias("p")).alias("k"))

    def bars(prefix, only=None):
        mine = (lambda c: c) if only is None else (lambda c: F.when(only, c))
        first, last, p, q = F.min(mine(F.col("k"))), F.max(mine(F.col("k"))), mine(F.col("p")), mine(F.col("q"))
        made = {"open": first["p"], "high": F.max(p), "low": F.min(p), "close": last["p"], "volume": F.sum(q), "trade_value": r6(F.sum(p * q)), "last_sec": last["sec"]}
        return [c.alias(f"{prefix}{name}") for name, c in made.items()]

    # bars of whole days and of regular sessions by one pass, written: every table below reads them
    both = written(l.groupBy("code", "date").agg(*bars(""), *bars("r_", F.col("k.sec") <= LAST)), "market")
    traded = both.select("code", "date", *BAR)
    regular = both.filter("r_last_sec is not null").select("code", "date", *[F.col(f"r_{c}").alias(c) for c in BAR])

    actions = written(l.filter("q = 50 and l_discount <= 0.02").select("code", "date", (1 - (F.col("l_linenumber") * 3 + 5) / 100.0).alias("factor")), "actions")
    events = O.actions_by_code(actions)

    def scaled(rows, columns):
        by = O.action_factor(F.col("events"), F.col("date"))
        return rows.join(events, "code", "left").select(*[(F.rint(F.col(c) * by) if c in columns else F.col(c)).alias(c) for c in rows.columns])

    prices = F.col("code") % 5 == 3
    daily = scaled(traded.filter(prices), O.PRICES).unionByName(traded.filter(~prices)).drop("last_sec")
    late = F.col("code") % 4 == 1
    session = scaled(regular.filter(late), O.PRICES).unionByName(regular.filter(~late))
    session = session.withColumn("open", F.when((F.col("code") % 6 == 2) & (F.dayofmonth("date") % 5 == 0), F.col("open") + 37).otherwise(F.col("open")))
    known = both.select("code", "date", "close", F.col("r_close").alias("regular"))
    before = F.lag(F.coalesce("regular", "close")).over(W.partitionBy("code").orderBy("date"))
    changes = known.withColumn("before", before).select("code", "date", "close", F.coalesce(F.floor((F.col("close") / F.col("before") - 1) * 1e4 + 0.5), F.lit(0)).alias("change_bp")).filter("(code + dayofmonth(date)) % 9 <> 4")
    return {
        "daily": daily, "session": session, "raw": traded.filter("(code + dayofmonth(date)) % 7 <> 3").select("code", "date", "open", "close"), "changes": changes, "actions": actions,
        "equity": S.table(spark, sf, "supplier").filter("s_suppkey % 8 <> 6").select(F.col("s_suppkey").alias("code")),
    }


def _tick(p: str, fund: str = "false") -> str:
    return f"(case when {fund} then case when {p} <= 0 then null when {p} < 2000 then 1 else 5 end else {SQL_TICK.format(p=p)} end)::double"


def _near(p: str, fund: str = "false") -> str:
    return f"(round_even(({p}) / {_tick(f'({p})', fund)}, 0) * {_tick(f'({p})', fund)})"


def _grids(close: str, bp: str) -> str:
    v = lambda g: f"(round_even(abs({close}) / (1 + {bp} / 1e4::double) / {g}::double, 0) * {g}::double)"
    return "case " + " ".join(f"when abs({close}) > 0 and {v(g)} > 0 and abs((abs({close}) / nullif({v(g)}, 0) - 1) * 1e4 - {bp}) <= {O.CHANGE_TOLERANCE} then {v(g)}" for g in O.CHANGE_GRIDS) + " end"


def _product(events: str, test: str) -> str:
    return f"coalesce(list_aggregate([x.f for x in {events} if {test}], 'product'), 1.0::double)"


def _retro(ratio: str, date: str, events: str) -> str:
    """The candidate scale nearest in logarithms: a list of (error, position, scale)."""
    later = f"[x.f for x in coalesce({events}, []) if x.d > {date}]"
    scales = f"[{{'e': abs(ln({ratio}) - ln(s.v)), 'i': s.i, 'v': s.v}} for s in list_concat([{{'i': 0::bigint, 'v': 1.0::double}}], [{{'i': n, 'v': list_aggregate(({later})[1:n], 'product')}} for n in range(1, len({later}) + 1)])]"
    return f"case when {ratio} > 0 then list_sort({scales})[1] end"


def _bars(name: str, where: str) -> str:
    return f"""{name} as (select code, date, first(p order by sec, l_orderkey, l_linenumber, l_partkey, p) as open, max(p) as high, min(p) as low, last(p order by sec, l_orderkey, l_linenumber, l_partkey, p) as close, sum(q) as volume,
  floor(sum(p * q) * 1e6 + 0.5) / 1e6 as trade_value, max(sec) as last_sec from l where {where} group by code, date)"""


def _scaled(rows: str, test: str, more: str) -> str:
    by = lambda c: f"case when {test} then round_even({c} * {_product('e', 'x.d > t.date')}, 0) else {c} end"
    return f"select t.code, t.date, {', '.join(f'{by(c)} as {c}' for c in O.PRICES)}, volume, trade_value{more} from {rows} t left join ev on ev.code = t.code"


MARKET_SQL = f"""l0 as (select *, l_suppkey as code, cast(date_trunc('week', l_shipdate) as date) as date, l_quantity::double as q, greatest(round_even(l_extendedprice / l_quantity, 0), 1.0::double) as px, (l_orderkey * 37 + l_partkey * 11 + l_linenumber * 1009) % 39600 as s from lineitem),
l as (select *, {_near('px')} as p, case when s % 4 = 1 then {AUCTION} else s + 32400 end as sec from l0), {_bars('traded', 'true')}, {_bars('regular', f'sec <= {LAST}')},
act as (select code, date, product(1 - (l_linenumber * 3 + 5) / 100.0::double) as f from l where q = 50 and l_discount <= 0.02 group by code, date), ev as (select code, list({{'d': date, 'f': f}} order by date) as e from act group by code),
daily as ({_scaled('traded', 't.code % 5 = 3', '')}), sess0 as ({_scaled('regular', 't.code % 4 = 1', ', last_sec')}), sess as (select * replace (case when code % 6 = 2 and day(date) % 5 = 0 then open + 37 else open end as open) from sess0),
raw as (select code, date, open, close from traded where (code + day(date)) % 7 <> 3), eq as (select s_suppkey as code from supplier where s_suppkey % 8 <> 6),
known as (select t.code, t.date, t.close, lag(coalesce(r.close, t.close)) over (partition by t.code order by t.date) as before from traded t left join regular r on r.code = t.code and r.date = t.date),
ch as (select code, date, close, coalesce(floor((close / before - 1) * 1e4 + 0.5), 0) as bp from known where (code + day(date)) % 9 <> 4)"""


def session_repair(spark, sf):
    m = market(spark, sf)
    out = O.regular_bars(m["daily"], m["session"], m["raw"], m["changes"], m["actions"], m["equity"], SINCE, whole=True)
    return out.select("code", "date", *[r6(c).alias(c) for c in (*O.PRICES, "volume", "trade_value")], "regular_ok", "close_ok")


_BAND = tuple(repr((1 - s * M.LIMIT_RATE) / (1 + s * M.LIMIT_RATE)) for s in (1, -1))
_WHOLE = "case when kt <> 1 then round_even({x}, 0) else {x} end"
_NEW = {c: _WHOLE.format(x=f"(s_{c} * kt)") for c in ("high", "low", "close")} | {"volume": _WHOLE.format(x="(s_volume / kt)"), "trade_value": "s_trade_value"}
REPAIR_SQL = f"""with {MARKET_SQL}, days as (select date, lag(date) over (order by date) as prev from (select distinct date from ch)), nx as (select c.code, d.prev as date, c.date as next, {_grids('c.close', 'c.bp')} as base from ch c join days d on d.date = c.date where d.prev is not null),
j as (select d.*, {', '.join(f's.{c} as s_{c}' for c in (*O.PRICES, 'volume', 'trade_value'))}, r.open as r_open, c.close as c_close, nx.next, nx.base, ev.e, d.date >= date '{SINCE}' and eq.code is not null as late, abs(d.open) / nullif(abs(r.open), 0) as kt
  from daily d left join sess s on s.code = d.code and s.date = d.date left join raw r on r.code = d.code and r.date = d.date left join ch c on c.code = d.code and c.date = d.date left join nx on nx.code = d.code and nx.date = d.date left join ev on ev.code = d.code left join eq on eq.code = d.code),
k as (select *, {_retro('(s_open / nullif(abs(r_open), 0))', 'date', 'e')} as rs, base * (abs(close) / nullif(abs(c_close), 0)) as back from j),
h as (select *, coalesce(rs.e <= {O.SCALE_TOLERANCE} and rs.v = 1 and s_close = {_near('s_close')} and kt > 0, false) as hit, case when back > 0 and back / abs(close) between {_BAND[0]} and {_BAND[1]} and not coalesce(list_contains([x.d for x in e], next), false) then round_even(back, 0) end as restored from k),
o as (select code, date, open, {', '.join(f"case when late and hit then {v} else {'coalesce(case when late then restored end, close)' if c == 'close' else c} end as {c}" for c, v in _NEW.items())}, not late or hit as regular_ok, not late or hit or restored is not null as close_ok from h)
select code, date, {', '.join(f'floor({c} * 1e6 + 0.5) / 1e6 as {c}' for c in (*O.PRICES, 'volume', 'trade_value'))}, regular_ok, close_ok from o"""


def base_price(spark, sf):
    m = market(spark, sf)
    days = m["daily"].select("date").distinct()
    out = O.base_prices(days, m["daily"], m["session"], m["raw"], m["changes"], m["actions"], m["equity"], SINCE, REFORM, AUCTION)
    return out.select("code", "date", r6("base").alias("base"), "source", "prev", r6("adj").alias("adj"))


_FITS = "abs(({p}) * rs.v - price) <= 0.5::double + 1e-4::double * abs(price) + 1e-9::double"
_UP, _DOWN = (f"back {sign} {_tick('back', 'fund')}" for sign in "+-")
BASE_PRICE_SQL = f"""with {MARKET_SQL}, seen as (select distinct date from (select date from daily union all select date from ch union all select date from sess)), pv as (select d.date as day, max(s.date) as prev from (select distinct date from daily) d left join seen s on s.date < d.date group by d.date),
src as (select code, pv.day, pv.prev, 0 as place, {_grids('close', 'bp')} as price, null::double as ratio from ch join pv on pv.day = ch.date
  union all select s.code, pv.day, pv.prev, 1, s.close, coalesce(s.open / nullif(abs(r.open), 0), 0) from sess s join pv on pv.prev = s.date left join raw r on r.code = s.code and r.date = s.date where s.last_sec >= {AUCTION}
  {' '.join(f'union all select t.code, pv.day, pv.prev, {i}, abs(t.close), null from {t} t join pv on pv.prev = t.date' for i, t in ((2, 'ch'), (3, 'raw'), (4, 'daily')))}),
a as (select src.*, ev.e, eq.code is null as fund, {_retro('ratio', 'src.prev', 'ev.e')} as rs from src left join ev on ev.code = src.code left join eq on eq.code = src.code where src.place < 2 or eq.code is null or src.prev < date '{SINCE}'),
b as (select *, {_near('(price / rs.v)', 'fund')} as back from a),
c as (select *, case when place <> 1 then price when rs.e <= {O.SCALE_TOLERANCE} and rs.v = 1 then price when rs.e <= {O.SCALE_TOLERANCE} and {_FITS.format(p='back')} and not {_FITS.format(p=_UP)} and not {_FITS.format(p=_DOWN)} then back end as base,
  case when place = 0 then 1.0::double else {_product('coalesce(e, [])', 'x.d > prev and x.d <= day')} end as adj from b),
d as (select *, case when adj = 1 then base when day >= date '{REFORM}' and place <> 4 then {_near('(base * adj)', 'fund')} end as moved from c where place <> 1 or prev < date '{REFORM}' or base = {_near('base', 'fund')})
select code, day as date, floor(moved * 1e6 + 0.5) / 1e6 as base, (['identity', 'session', 'changes', 'raw', 'daily'])[place + 1] as source, prev, floor(adj * 1e6 + 0.5) / 1e6 as adj from d where moved > 0 qualify row_number() over (partition by code, day order by place) = 1"""


def previous_sessions(spark, sf):
    """Previous session of each order date over three tables, some of which lack days."""
    o, l = S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem")
    day = lambda df, c: df.select(F.col(c).cast("date").alias("date"))
    tables = {"orders": day(o, "o_orderdate").filter("dayofmonth(date) % 7 <> 0"), "ships": day(l, "l_shipdate").filter("dayofmonth(date) % 5 <> 0"), "returns": day(l.filter("l_returnflag = 'R'"), "l_shipdate")}
    return O.previous_sessions(day(o, "o_orderdate"), **tables).select("date", "prev", F.array_join("missing", ",").alias("missing"))


PREVIOUS_SQL = """with t as (select distinct 'orders' as name, cast(o_orderdate as date) as date from orders where day(o_orderdate) % 7 <> 0 union select 'ships', cast(l_shipdate as date) from lineitem where day(l_shipdate) % 5 <> 0 union select 'returns', cast(l_shipdate as date) from lineitem where l_returnflag = 'R'),
d as (select distinct cast(o_orderdate as date) as date from orders), p as (select d.date, max(t.date) as prev from d left join t on t.date < d.date group by d.date), n as (select unnest(['orders', 'returns', 'ships']) as name)
select p.date, prev, case when prev is not null then coalesce(string_agg(n.name, ',' order by n.name) filter (where t.date is null), '') end as missing from p cross join n left join t on t.date = p.prev and t.name = n.name group by p.date, prev"""


def exact_rolling_mean(spark, sf):
    """Mean of the last 60 values of a supplier; one in about 100 is 2**40 larger and must leave nothing behind."""
    l = S.table(spark, sf, "lineitem").filter("l_extendedprice is not null")
    spike = F.when(F.col("l_partkey") % 97 == 5, F.when(F.col("l_orderkey") % 2 == 0, 2.0**40).otherwise(-(2.0**40))).otherwise(0.0)
    v = spike + F.rint(F.col("l_extendedprice") * 100) / 1024
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return E.exact_rolling(l, v, ["l_suppkey"], order, 60, "depth").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("depth_n").alias("n"), r6("depth_mean").alias("mean"))


EXACT_SQL = """with v as (select *, (case when l_partkey % 97 <> 5 then 0 when l_orderkey % 2 = 0 then 1125899906842624 else -1125899906842624 end)::hugeint + round_even(l_extendedprice * 100, 0)::hugeint as k from lineitem),
w as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, sum(k) over f as total, count(*) over f as n from v window f as (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice rows between 59 preceding and current row))
select l_suppkey, l_orderkey, l_linenumber, l_partkey, n, floor(total::double / 1024 / n * 1e6 + 0.5) / 1e6 as mean from w"""


def _rules(spark, sf):
    """Candidates of each return flag: suppliers, their mean return by month (score) and by trade (pooled)."""
    l = S.table(spark, sf, "lineitem")
    value = F.rint(F.col("l_extendedprice") * (F.col("l_discount") - 0.05) / F.col("l_quantity"))
    months = l.groupBy("l_returnflag", F.col("l_suppkey").alias("rule"), F.date_trunc("month", "l_shipdate").alias("month")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    rules = months.groupBy("l_returnflag", "rule").agg((F.rint(F.avg(F.rint(F.col("total") / F.col("n") * 64) / 64) * 1024) / 1024).alias("score"), (F.rint(F.sum("total") / F.sum("n") * 1024) / 1024).alias("pooled"), F.sum("n").alias("trades"))
    return rules.withColumn("pooled", F.when(F.col("l_returnflag") != "A", F.col("pooled")).otherwise(F.when(F.col("rule") % 5 > 0, F.col("pooled"))))


RULES_SQL = """months as (select l_returnflag, l_suppkey as rule, date_trunc('month', l_shipdate) as month, sum(round_even(l_extendedprice * (l_discount - 0.05::double) / l_quantity, 0)) as total, count(*) as n from lineitem group by all),
rules0 as (select l_returnflag, rule, round_even(avg(round_even(total / n * 64, 0) / 64) * 1024, 0) / 1024 as score, round_even(sum(total) / sum(n) * 1024, 0) / 1024 as pooled, sum(n)::bigint as trades from months group by all),
el as (select * replace (case when l_returnflag <> 'A' or rule % 5 > 0 then pooled end as pooled) from rules0 where trades >= 8), g as (select *, score - pooled as gap from el)"""


def _rounded(df, names):
    return df.select(*[(r6(c) if c in names else F.col(c)).alias(c) for c in df.columns])


_REPORT = ("score_mean", "score_median", "score_sd", "score_max", "pooled_mean", "pooled_median", "gap_median", "gap_p90", "premium_vs_random", "premium_vs_median", "selected_gap", "selected_gap_pctile", "rho_n_vs_score", "rho_n_vs_absdev", "rho_n_vs_absgap", "delta_score", "delta_pooled", "delta_size")


def selection_report(spark, sf):
    return _rounded(P.selection_report(_rules(spark, sf), ["l_returnflag"], "rule", "score", "pooled", "trades", 8), _REPORT)


_RANK = "rank() over (partition by l_returnflag order by {x}) + (count(*) over (partition by l_returnflag, {x}) - 1) / 2.0"
REPORT_SQL = f"""with {RULES_SQL}, c as (select l_returnflag, count(*) as n_rows from rules0 group by 1),
m as (select l_returnflag, count(*) as n_eligible, avg(score) as score_mean, quantile_cont(score, 0.5) as score_median, stddev_samp(score) as score_sd, max(score) as score_max, avg(pooled) as pooled_mean, quantile_cont(pooled, 0.5) as pooled_median,
  quantile_cont(gap, 0.5) as gap_median, quantile_cont(gap, 0.9) as gap_p90, count(gap) as gaps from g group by 1),
a as (select * from g qualify row_number() over (partition by l_returnflag order by score desc, rule) = 1), b as (select * from g where pooled is not null qualify row_number() over (partition by l_returnflag order by pooled desc, rule) = 1),
x as (select g.*, abs(g.score - score_median) as dev, abs(g.gap) as ag, a.gap as ga from g join m using (l_returnflag) join a using (l_returnflag)),
r as (select l_returnflag, gap, ga, {', '.join(f'{_RANK.format(x=x)} as r_{x}' for x in ('trades', 'score', 'dev', 'ag'))} from x),
k as (select l_returnflag, corr(r_trades, r_score) as rho_n_vs_score, corr(r_trades, r_dev) as rho_n_vs_absdev, corr(r_trades, r_ag) as rho_ag, avg((gap <= ga)::int) as selected_gap_pctile from r group by 1),
o as (select l_returnflag, n_rows, n_eligible, m.* exclude (l_returnflag, n_eligible, gaps), a.rule as selected, b.rule as selected_by_pooled, a.rule = b.rule as same_selection, a.score - score_mean as premium_vs_random, a.score - score_median as premium_vs_median, a.gap as selected_gap,
  case when a.gap is not null then selected_gap_pctile end as selected_gap_pctile, rho_n_vs_score, rho_n_vs_absdev, case when gaps = n_eligible then rho_ag end as rho_n_vs_absgap, b.score - a.score as delta_score, b.pooled - a.pooled as delta_pooled, (b.trades - a.trades)::double as delta_size
  from c join m using (l_returnflag) join a using (l_returnflag) left join b using (l_returnflag) join k using (l_returnflag))
select * replace ({', '.join(f'floor({x} * 1e6 + 0.5) / 1e6 as {x}' for x in _REPORT)}) from o"""


def size_quartiles(spark, sf):
    return _rounded(P.size_quartiles(_rules(spark, sf), ["l_returnflag"], "rule", "score", "pooled", "trades", 8), ("score_mean", "score_sd", "absgap_median"))


QUARTILES_SQL = f"""with {RULES_SQL}, q as (select l_returnflag, {', '.join(f'quantile_cont(trades, {i / 4}) as q{i}' for i in (1, 2, 3))} from g group by 1), p as (select g.*, 1 + (trades > q1)::int + (trades > q2)::int + (trades > q3)::int as quartile from g join q using (l_returnflag))
select l_returnflag, quartile, min(trades)::double as n_lo, max(trades)::double as n_hi, count(*) as k, floor(avg(score) * 1e6 + 0.5) / 1e6 as score_mean, floor(stddev_samp(score) * 1e6 + 0.5) / 1e6 as score_sd, max(score) as score_max, floor(quantile_cont(abs(gap), 0.5) * 1e6 + 0.5) / 1e6 as absgap_median
from p group by 1, 2"""


def monthly_sums(spark, sf):
    o = S.table(spark, sf, "orders").select((F.col("o_custkey") % 60).alias("code"), F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("o_orderdate").alias("time"), F.rint("o_totalprice").alias("v"))
    return T.monthly_sums(o, ["code"], "month", "time", "v")


MONTHLY_SQL = "select o_custkey % 60 as code, cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n, sum(round_even(o_totalprice, 0)) as total from orders group by 1, 2"


def previous_weekdays(spark, sf):
    """Weekday before each order and whether its day was over on a given one."""
    return S.table(spark, sf, "orders").select("o_orderkey", M.previous_weekday("o_orderdate").alias("before"), M.is_closed_day("o_orderdate", "1997-01-01").alias("closed"))


WEEKDAY_SQL = """select o_orderkey, cast(o_orderdate as date) - (case isodow(o_orderdate) when 7 then 2 when 1 then 3 else 1 end)::int as before, cast(o_orderdate as date) < date '1997-01-01' as closed from orders"""


QUERIES = {
    "monthly_sums": (monthly_sums, MONTHLY_SQL, "month"),
    "previous_weekdays": (previous_weekdays, WEEKDAY_SQL, "before"),
    "selection_report": (selection_report, REPORT_SQL),
    "size_quartiles": (size_quartiles, QUARTILES_SQL),
    "exact_rolling_mean": (exact_rolling_mean, EXACT_SQL),
    "session_repair": (session_repair, REPAIR_SQL, "date"),
    "base_price": (base_price, BASE_PRICE_SQL, "date prev"),
    "previous_sessions": (previous_sessions, PREVIOUS_SQL, "date prev"),
}

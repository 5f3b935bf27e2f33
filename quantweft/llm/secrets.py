"""Secret scan by sliding-window entropy (operator 5); SQL functions only, no shuffle.

Base spans: assignments to secret-like names, access key ids, long hexadecimal runs.  The method adds `entropy` spans:
candidate strings are runs of CANDIDATE characters; a window of WINDOW characters slides over each and keeps the counts
of its characters, changing two of them and the sum of n log2 n a step.  A window counts when its Shannon entropy
reaches the threshold of the candidate's character class (hexadecimal, letters and digits, or with symbols); the span
goes from the first such window to the end of the last.  Allow-listed candidates (no digit or no letter, UUIDs, paths and
names of plain words, placeholders) and those inside a base span add nothing.

Offsets are code points.  A match's start is the length of all texts between and of all matches before it, which
split() and regexp_extract_all() give for one pattern.

Defined cases: null and empty text have no spans; null doc_id stays null; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C

WINDOW = 20
#: Candidates' characters lie between + and z.
LOWEST, KINDS_OF_CHARACTERS = ord("+"), ord("z") - ord("+") + 1
#: Matches of a text are placed in blocks of so many.
BLOCK = 256


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(?:" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
KINDS = ("assign", "access", "hex", "entropy")
#: Bits a character, by character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "symbols": 3.8}
#: A candidate that matches one of these is no secret.
ALLOWED = ("^[^0-9]*$", "^[^A-Za-z]*$", "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", "^[A-Za-z]*([/_-][A-Za-z]+)*([/_-][0-9]{1,4})+$", "(EXAMPLE|example|XXXX|xxxx|0123456789|abcdefgh)")


def scanned(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states after each item, state 0 being `start`; kind: their type.  Appending copies what is there, so items go in blocks."""
    none, blocks = f"cast(array() as array<{kind}>)", f"cast(array() as array<struct<last:{kind},out:array<{kind}>>>)"

    def item(acc: Column, x: Column) -> Column:
        return let(step(acc["last"], x), lambda now: F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out")))

    def block(done: Column, xs: Column) -> Column:
        before = F.coalesce(F.get(done, F.size(done) - 1)["last"], start)
        return F.concat(done, F.array(F.aggregate(xs, F.struct(before.alias("last"), F.expr(none).alias("out")), item)))

    def all_of(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.transform(F.aggregate(parts, F.expr(blocks), block), lambda x: x["out"]))

    return let(items, lambda xs: F.when(F.size(xs) > 0, all_of(xs)).otherwise(F.expr(none)))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, though lambdas in `use` have it several times."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


SPAN = "struct<start:int,stop:int,value:string>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, stop, value>> of the leftmost non-overlapping matches; value: the group."""
    # a text between is before each match, and one is left over, with no match (null)
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def step(last: Column, x: Column) -> Column:
        at = last["stop"] + F.length(x["gap"])
        return F.struct(at.alias("start"), (at + F.coalesce(F.length(x["match"]), F.lit(0))).alias("stop"), F.when(x["match"].isNotNull(), x["value"]).alias("value"))

    spans = scanned(found, F.expr(f"cast(named_struct('start', 0, 'stop', 0, 'value', null) as {SPAN})"), step, SPAN)
    return F.when(text.rlike(pattern), F.filter(spans, lambda x: x["stop"] > x["start"])).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def outside(hits: Column, base: Column) -> Column:
    """The hits (struct<start, kind, stop>) that no span of base holds: in the order of starts, none before reaches as far."""
    marked = F.concat(F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("hit"), x["stop"].alias("stop"))), F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("hit"), x["stop"].alias("stop"))))
    kind = "struct<start:int,stop:int,hit:int,reach:int>"

    def step(last: Column, x: Column) -> Column:
        reach = F.when(x["hit"] == 0, F.greatest(last["reach"], x["stop"])).otherwise(last["reach"])
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["hit"].alias("hit"), reach.alias("reach"))

    walked = scanned(F.array_sort(marked), F.expr(f"cast(named_struct('start', 0, 'stop', 0, 'hit', 0, 'reach', -1) as {kind})"), step, kind)
    free = F.filter(walked, lambda x: (x["hit"] == 1) & (x["reach"] < x["stop"]))
    return F.when(F.size(hits) > 0, F.transform(free, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["stop"].alias("stop")))).otherwise(hits)


def _n_log_n(n: int) -> float:
    return n * math.log2(n) if n else 0.0


def _limit(bits: float) -> float:
    """The window has at least `bits` of entropy if the sum of n log2 n over its characters is at most this."""
    return WINDOW * (math.log2(WINDOW) - bits) + 1e-9


def entropy_range(value: Column) -> Column:
    """struct<first, last>: starts of the first and last window of enough entropy; -1 if none."""
    table = F.array(*[F.lit(_n_log_n(n)) for n in range(WINDOW + 1)])
    limit = F.when(value.rlike("^[0-9A-Fa-f]*$"), F.lit(_limit(THRESHOLDS["hex"]))).when(value.rlike("^[0-9A-Za-z]*$"), F.lit(_limit(THRESHOLDS["alnum"]))).otherwise(F.lit(_limit(THRESHOLDS["symbols"])))
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - LOWEST)
    # (entering, leaving, position) of each step; the first WINDOW characters enter and none leaves
    steps = F.transform(codes, lambda c, i: F.struct(c.alias("come"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(-1).alias("go"), i.alias("i")))
    zero = F.struct(F.array_repeat(F.lit(0), KINDS_OF_CHARACTERS).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), limit.alias("limit"))

    def step(acc: Column, x: Column) -> Column:
        same = x["come"] == x["go"]
        come, go = F.get(acc["n"], x["come"]), F.when(x["go"] >= 0, F.get(acc["n"], x["go"])).otherwise(F.lit(0))
        total = F.when(same, acc["sum"]).otherwise(
            acc["sum"] + F.get(table, come + 1) - F.get(table, come) + F.when(x["go"] >= 0, F.get(table, go - 1) - F.get(table, go)).otherwise(F.lit(0.0))
        )
        counts = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda n, k: n + (k == x["come"]).cast("int") - (k == x["go"]).cast("int")))
        hit = (x["i"] >= WINDOW - 1) & (total <= acc["limit"])
        start = x["i"] - (WINDOW - 1)
        return F.struct(counts.alias("n"), total.alias("sum"), F.when(hit & (acc["first"] < 0), start).otherwise(acc["first"]).alias("first"), F.when(hit, start).otherwise(acc["last"]).alias("last"), acc["limit"].alias("limit"))

    return F.aggregate(steps, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop")))


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, entropy): arrays of struct<start, kind, stop>, one row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select(
        "doc_id",
        _spans(F.filter(located(text, ASSIGN, 1), lambda x: F.length(x["value"]) >= 6), 0).alias("assign"),
        _spans(located(text, ACCESS), 1).alias("access"),
        _spans(located(text, HEX), 2).alias("hex"),
        F.filter(located(text, CANDIDATE), lambda x: ~_any([x["value"].rlike(p) for p in ALLOWED])).alias("candidates"),
    )
    base = F.concat("assign", "access", "hex")
    scored = F.transform("candidates", lambda x: F.struct(x["start"].alias("start"), entropy_range(x["value"]).alias("range")))
    rows = rows.withColumn("scored", scored)
    hits = F.transform(
        F.filter("scored", lambda x: x["range"]["first"] >= 0),
        lambda x: F.struct((x["start"] + x["range"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + x["range"]["last"] + WINDOW).alias("stop")),
    )
    rows = rows.select("doc_id", "assign", "access", "hex", hits.alias("hits"))
    return rows.select("doc_id", "assign", "access", "hex", outside(F.col("hits"), base).alias("entropy"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(C.table(spark, sf_dir, "documents"))
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    base = F.concat("assign", "access", "hex")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("entropy"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(base, F.col("entropy"))).alias("spans"))


def _sql_located(name: str, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
{name}_m as (select doc_id, string_split_regex(text, '{quoted}') as gaps, regexp_extract_all(text, '{quoted}') as found, regexp_extract_all(text, '{quoted}', {group}) as vals from d where regexp_matches(text, '{quoted}')),
{name}_u as (select doc_id, unnest(range(1, len(found) + 1)) as i, gaps, found, vals from {name}_m),
{name} as (select doc_id, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) as bigint) as start, length(found[i]) as n, vals[i] as val from {name}_u)"""


def op5_sql() -> str:
    allowed = " or ".join(f"regexp_matches(val, '{p}')" for p in ALLOWED)
    limits = {k: repr(_limit(v)) for k, v in THRESHOLDS.items()}
    return rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),{_sql_located('assign_all', ASSIGN, 1)},{_sql_located('access', ACCESS, 0)},{_sql_located('hex', HEX, 0)},{_sql_located('cand', CANDIDATE, 0)},
base as (select doc_id, start, 0 as kind, start + n as stop from assign_all where length(val) >= 6
  union all select doc_id, start, 1, start + n from access union all select doc_id, start, 2, start + n from hex),
win as (select doc_id, start, val, i, val[i+1:i+{WINDOW}] as w from (select *, unnest(range(0, n - {WINDOW} + 1)) as i from cand where not ({allowed}))),
ch as (select doc_id, start, val, i, unnest(string_split(w, '')) as c from win),
cnt as (select doc_id, start, val, i, c, count(*) as k from ch group by all),
ent as (select doc_id, start, val, i, sum(k * log2(k)) as s from cnt group by all),
hit as (select doc_id, start + min(i) as start, 3 as kind, start + max(i) + {WINDOW} as stop from ent
  where s <= case when regexp_matches(val, '^[0-9A-Fa-f]*$') then {limits['hex']} when regexp_matches(val, '^[0-9A-Za-z]*$') then {limits['alnum']} else {limits['symbols']} end
  group by doc_id, ent.start, val),
fresh as (select h.* from hit h where not exists (select 1 from base b where b.doc_id = h.doc_id and b.start <= h.start and b.stop >= h.stop)),
allspans as (select * from base union all select * from fresh),
txt as (select doc_id, kind, start, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop as t from allspans)
select documents.doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind = 3) as n_entropy,
  sha256(coalesce(string_agg(t, ',' order by start, kind) filter (kind < 3), '')) as base_sha256, coalesce(string_agg(t, ',' order by start, kind), '') as spans
from documents left join txt on txt.doc_id = documents.doc_id group by documents.doc_id
"""

"""Market rules as column expressions: ticks, price limits, codes, titles.

Every function takes and returns Spark columns, so rules run inside code generation next to the query that uses them.
NULL stands for unknown; a comparison with NULL counts as false where a rule needs a decision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price bands (below this price, this tick) of shares, and the tick above them.
STOCK_BANDS = ((2000, 1), (5000, 5), (20000, 10), (50000, 50), (200000, 100), (500000, 500))
STOCK_TOP = 1000
#: The same for exchange-traded funds.
FUND_BANDS = ((2000, 1),)
FUND_TOP = 5
#: Shifts and multipliers of the 32-bit hash; those that mix the seed, the replicate and the block of a bootstrap.
HASH32_STEPS = ((16, 0x7FEB352D), (15, 0x5BD1E995))
SEED_FACTOR, SEED_ADDEND, REPLICATE_ADDEND = 0x2545F491, 0x1B873593, 0x27D4EB2F
#: Daily price limit.
LIMIT_RATE = 0.30


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _banded(price: Column, bands: tuple, top: int) -> Column:
    out = None
    for bound, tick in bands:
        out = F.when(price < bound, F.lit(tick)) if out is None else out.when(price < bound, F.lit(tick))
    return out.otherwise(F.lit(top))


def tick_size(price: Column | str, fund: bool = False) -> Column:
    """Tick of a price; NULL where the price is not positive."""
    p = _col(price)
    return F.when((p > 0) & ~F.isnan(p.cast("double")), _banded(p, FUND_BANDS, FUND_TOP) if fund else _banded(p, STOCK_BANDS, STOCK_TOP))


def tick_size_or_one(price: Column | str) -> Column:
    """Tick of a share price; 1 where the price is not positive."""
    return F.coalesce(tick_size(price), F.lit(1))


def round_to_tick(price: Column | str) -> Column:
    """Down to the tick grid (decimal)."""
    p = _col(price).cast("decimal(20,6)")
    return (F.floor(p / tick_size(p)) * tick_size(p)).cast("decimal(20,6)")


def round_to_tick_up(price: Column | str) -> Column:
    """Up to the tick grid (decimal)."""
    p = _col(price).cast("decimal(20,6)")
    return (F.ceil(p / tick_size(p)) * tick_size(p)).cast("decimal(20,6)")


def is_tick_valid(price: Column | str) -> Column:
    p = _col(price).cast("decimal(20,6)")
    return F.coalesce((p > 0) & (p % tick_size(p) == 0), F.lit(False))


def _bands_from_zero() -> list[tuple[int, int, int]]:
    """(first price, tick, number of ticks below it) of each band."""
    out, price, below = [], 0, 0
    for bound, tick in (*STOCK_BANDS, (None, STOCK_TOP)):
        out.append((price, tick, below))
        if bound:
            below += (bound - price) // tick
            price = bound
    return out


def shift_ticks(price: Column | str, n: Column | int) -> Column:
    """The valid price n ticks away; NULL for prices off the grid and for results below the lowest price.

    Band bounds are ticks of both bands, so the grid numbers its prices from zero and a shift is an addition.
    """
    p, n = _col(price).cast("long"), n if isinstance(n, Column) else F.lit(n)
    index = to = None
    for start, tick, below in reversed(_bands_from_zero()):
        here = F.floor((p - start) / tick) + below
        index = F.when(p >= start, here) if index is None else index.when(p >= start, here)
    at = index + n
    for start, tick, below in reversed(_bands_from_zero()):
        there = (at - below) * tick + start
        to = F.when(at >= below, there) if to is None else to.when(at >= below, there)
    return F.when(is_tick_valid(price) & (at > 0), to)


def limit_up(prev_close: Column | str) -> Column:
    """Previous close times 1.3, down to the tick of the result."""
    raw = _col(prev_close).cast("double") * F.lit(1.3)
    tick = tick_size_or_one(raw)
    return (F.floor(raw / tick + F.lit(1e-9)) * tick).cast("double")


def limit_down(prev_close: Column | str) -> Column:
    """Previous close less 30 % of it, that width down to the tick of the close."""
    base = _col(prev_close).cast("double")
    tick = tick_size_or_one(base)
    return base - F.floor(base * F.lit(LIMIT_RATE) / tick + F.lit(1e-9)) * tick


def near_limit_up(price: Column | str, prev_close: Column | str, ticks: int = 3) -> Column:
    """Whether the price is within some ticks of the upper limit, or above it."""
    p, prev = _col(price), _col(prev_close)
    top = limit_up(prev)
    return F.coalesce((p > 0) & (prev > 0) & (p >= top - F.lit(ticks) * tick_size_or_one(top)), F.lit(False))


def normalize_code(code: Column | str) -> Column:
    """Six-character code: capitals, letters and digits only, one leading letter of seven dropped, digits padded."""
    text = F.regexp_replace(F.upper(F.trim(F.coalesce(_col(code).cast("string"), F.lit("")))), r"[^\p{L}\p{N}]", "")
    text = F.when((F.length(text) == 7) & text.rlike(r"^\p{L}"), F.substring(text, 2, 6)).otherwise(text)
    text = F.when(F.length(text) > 6, F.right(text, F.lit(6))).otherwise(text)
    return F.when(text.rlike(r"^\d+$"), F.lpad(text, 6, "0")).otherwise(text)


def is_valid_code(code: Column | str) -> Column:
    return F.coalesce(_col(code).rlike("^[0-9A-Z]{6}$"), F.lit(False))


#: Names of the markets.
MARKETS = {
    "KOSPI": "KOSPI", "거래소": "KOSPI", "유가증권": "KOSPI", "코스피": "KOSPI",
    "KOSDAQ": "KOSDAQ", "코스닥": "KOSDAQ",
    "KONEX": "KONEX", "코넥스": "KONEX",
}


def parse_market(name: Column | str, strict: bool = True) -> Column:
    """Market of a name in either language; unknown names raise, or give NULL if not strict."""
    key = F.upper(F.trim(_col(name)))
    out = None
    for alias, market in MARKETS.items():
        out = F.when(key == alias, F.lit(market)) if out is None else out.when(key == alias, F.lit(market))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown market: "), _col(name)))) if strict else out


def strip_sign(text: Column | str) -> Column:
    """Whole number without its signs; blank is 0."""
    t = F.regexp_replace(F.trim(F.coalesce(_col(text), F.lit(""))), "^[+-]+", "")
    return F.when(t == "", F.lit(0)).otherwise(t.cast("double").cast("long"))


def strip_sign_float(text: Column | str) -> Column:
    """Number without signs and thousands separators; blank is 0."""
    t = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(_col(text), F.lit(""))), ",", ""), "^[+-]+", "")
    return F.when(t == "", F.lit(0.0)).otherwise(t.cast("double"))


def normalize_order_no(number: Column | str) -> Column:
    """Order number without leading zeros; one of zeros alone stays."""
    t = F.trim(_col(number).cast("string"))
    bare = F.regexp_replace(t, "^0+", "")
    return F.when(bare == "", t).otherwise(bare)


def version_parts(version: Column | str) -> Column:
    """Leading numeric parts of a version as an array of integers."""
    head = F.regexp_extract(_col(version), r"^v?(\d+(?:\.\d+)*)", 1)
    return F.when(head == "", F.expr("cast(array() as array<int>)")).otherwise(F.split(head, r"\.").cast("array<int>"))


#: Words of filing titles that are severe by themselves.
SEVERE_TITLES = (
    "상장폐지",
    "관리종목지정",
    "매매거래정지",
    "감사의견거절",
    "의견거절",
    "감사범위제한",
    "부적정",
    "횡령",
    "배임",
    "회생절차개시신청",
    "파산신청",
    "부도발생",
    "은행거래정지",
)
#: The halt title, and the reasons that make a halt severe.
HALT_TITLE = "매매거래정지"
SEVERE_HALT_REASONS = (
    "상장폐지",
    "상장적격성",
    "개선기간",
    "관리종목",
    "투자자 보호",
    "투자자보호",
    "회생",
    "파산",
    "부도",
    "횡령",
    "배임",
    "의견거절",
    "부적정",
    "감사범위제한",
)


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def title_severity(title: Column | str, severe: tuple = SEVERE_TITLES, halt: str = HALT_TITLE, reasons: tuple = SEVERE_HALT_REASONS) -> Column:
    """HARD or UNCLASSIFIED.  A halt is judged by the reason in parentheses; without one it is HARD."""
    t = F.coalesce(_col(title), F.lit(""))
    at = F.locate(halt, t)
    after = F.substring(t, at + len(halt), F.length(t))
    paren = F.locate("(", after)
    reason = F.when(paren > 0, F.substring(after, paren + 1, F.length(after))).otherwise(F.lit(""))
    bare = F.regexp_replace(reason, r"^[ )]+|[ )]+$", "") == ""
    hard = F.when(at > 0, bare | _has_any(reason, reasons)).otherwise(_has_any(t, severe))
    return F.when(hard, F.lit("HARD")).otherwise(F.lit("UNCLASSIFIED"))


def gate_action(severity: Column, score: Column, confidence: Column, has_position: Column, is_new_entry: Column, bearish: Column, score_at_most: float = -0.5, confidence_from: float = 0.6) -> Column:
    """PASS, REJECT, HALT_ENTRY or FORCE_EXIT.  Severe titles force an exit; bad sentiment only blocks entries."""
    block = F.when(is_new_entry, F.lit("REJECT")).otherwise(F.lit("HALT_ENTRY"))
    bad = F.coalesce(bearish & (score <= score_at_most) & (confidence >= confidence_from), F.lit(False))
    return F.when((severity == "HARD") & has_position, F.lit("FORCE_EXIT")).when((severity == "HARD") | bad, block).otherwise(F.lit("PASS"))


def in_regular_session(ts: Column | str) -> Column:
    """Weekday, 09:00 to 15:30 (exclusive)."""
    t = _col(ts)
    minute = F.hour(t) * 60 + F.minute(t)
    return F.dayofweek(t).between(2, 6) & (minute >= 540) & (minute < 930)


def previous_weekday(date: Column | str) -> Column:
    """The last Monday to Friday before a date; holidays are not known here."""
    d = _col(date).cast("date")
    return F.date_sub(d, F.when(F.dayofweek(d) == 1, 2).when(F.dayofweek(d) == 2, 3).otherwise(1))


def is_closed_day(date: Column | str, today: str) -> Column:
    """Whether a date is before today, so that its data no longer change; an unknown date is not."""
    return F.coalesce(_col(date).cast("date") < F.lit(today).cast("date"), F.lit(False))


def past_cutoff(ts: Column | str, hhmm: str) -> Column:
    """Whether the clock has reached hhmm; a malformed cut-off never blocks."""
    parts = hhmm.split(":")
    if len(parts) != 2 or not all(p.isdigit() for p in parts) or int(parts[0]) > 23 or int(parts[1]) > 59:
        return F.lit(False)
    t = _col(ts)
    return F.hour(t) * 60 + F.minute(t) >= int(parts[0]) * 60 + int(parts[1])


def ieee_divide(a: Column | str, b: Column | str) -> Column:
    """a / b of doubles as the hardware has it: infinite or NaN where b is 0; NULL where either is unknown."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    limit = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(x.isNotNull() & (y == 0), F.when(F.isnan(x), x).otherwise(limit)).otherwise(F.try_divide(x, y))


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, though `use` has it several times."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def hash32(x: Column | str) -> Column:
    """A 32-bit integer mixed from an integer.  Both multipliers are below 2**31, so bigints never overflow."""
    m = F.lit((1 << 32) - 1)
    v = _col(x).cast("long").bitwiseAND(m)

    def step(shift: int, factor: int) -> Callable[[Column], Column]:
        return lambda v: (v.bitwiseXOR(F.shiftrightunsigned(v, shift)) * F.lit(factor)).bitwiseAND(m)

    for shift, factor in HASH32_STEPS:
        v = _let(v, step(shift, factor))
    return _let(v, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 16)))


def hash32_of(x: int) -> int:
    """The same of a number on the driver."""
    v = x & 0xFFFFFFFF
    for shift, factor in HASH32_STEPS:
        v = (v ^ v >> shift) * factor & 0xFFFFFFFF
    return v ^ v >> 16

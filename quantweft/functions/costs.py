"""Trading costs as column expressions: dated taxes, commission, slippage, square-root impact, fill rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantweft.functions.market import _col, round_to_tick, round_to_tick_up, tick_size

#: Sell tax by effective date, per cent: securities tax and rural tax of KOSPI, securities tax of the others.
TAX_PERIODS = (
    ("0001-01-01", "0.15", "0.15", "0.30"),
    ("2019-06-03", "0.10", "0.15", "0.25"),
    ("2021-01-01", "0.08", "0.15", "0.23"),
    ("2023-01-01", "0.05", "0.15", "0.20"),
    ("2024-01-01", "0.03", "0.15", "0.18"),
    ("2025-01-01", "0.00", "0.15", "0.15"),
    ("2026-01-01", "0.05", "0.15", "0.20"),
)
#: Default rates.
COMMISSION, MAIN_SLIPPAGE, OTHER_SLIPPAGE, CONFIGURED_TAX = "0.00015", "0.0005", "0.0015", "0.0020"
#: A daily turnover below this is taken for a wrong unit.
LEAST_ADV = 1e6


def sell_tax(on: Column | str, market: Column | str) -> Column:
    """Rate of the tax on a sale (decimal), by date and market (KOSPI, KOSDAQ, KONEX)."""
    day, m = _col(on).cast("date"), _col(market)
    out = None
    for since, main, rural, other in reversed(TAX_PERIODS):
        rate = F.when(m == "KOSPI", F.expr(f"(cast('{main}' as decimal(10,6)) + cast('{rural}' as decimal(10,6))) / 100")).otherwise(F.expr(f"cast('{other}' as decimal(10,6)) / 100"))
        rate = rate.cast("decimal(10,6)")
        out = F.when(day >= F.lit(since).cast("date"), rate) if out is None else out.when(day >= F.lit(since).cast("date"), rate)
    return out


def round_trip_cost(on: Column | str, market: Column | str, commission: float = float(COMMISSION), slippage: float = 0.0) -> Column:
    """Two commissions, one sell tax, two slippages, as a share of turnover."""
    return F.lit(2 * commission) + sell_tax(on, market).cast("double") + F.lit(2 * slippage)


def fill_price(side: Column, price: Column, market: Column) -> Column:
    """Adverse slippage, then down to the tick grid (decimal)."""
    slip = F.when(market == "KOSDAQ", F.expr(f"cast('{OTHER_SLIPPAGE}' as decimal(10,6))")).otherwise(F.expr(f"cast('{MAIN_SLIPPAGE}' as decimal(10,6))"))
    factor = F.when(side == "BUY", F.lit(1).cast("decimal(10,6)") + slip).otherwise(F.lit(1).cast("decimal(10,6)") - slip)
    moved = (price.cast("decimal(20,6)") * factor).cast("decimal(24,8)")
    tick = tick_size(moved)
    return (F.floor(moved / tick) * tick).cast("decimal(20,6)")


def trade_cost(side: Column, price: Column, quantity: Column, market: Column, minimum: str = "0") -> Column:
    """struct(fill_price, commission, tax): commission and tax of the slipped turnover; the tax on sales alone."""
    fill = fill_price(side, price, market)
    turnover = (fill * quantity.cast("decimal(18,0)")).cast("decimal(28,6)")
    fee = F.greatest((turnover * F.expr(f"cast('{COMMISSION}' as decimal(10,6))")).cast("decimal(28,8)"), F.lit(minimum).cast("decimal(28,8)"))
    tax = F.when(side == "SELL", (turnover * F.expr(f"cast('{CONFIGURED_TAX}' as decimal(10,6))")).cast("decimal(28,8)")).otherwise(F.lit(0).cast("decimal(28,8)"))
    return F.struct(fill.alias("fill_price"), fee.alias("commission"), tax.alias("tax"))


def participation(notional: Column, adv_value: Column) -> Column:
    """Share of the average daily turnover; a turnover below LEAST_ADV raises, NULL stays NULL."""
    checked = F.when(adv_value < LEAST_ADV, F.raise_error(F.lit("average daily turnover must be in won"))).otherwise(adv_value)
    return F.abs(notional) / checked


def sqrt_impact_bp(notional: Column, adv_value: Column, daily_vol: Column, y: float = 1.0) -> Column:
    """Y * volatility * sqrt(participation), in basis points; a volatility outside 0..1 raises."""
    if y < 0:
        raise ValueError("y must not be negative")
    vol = F.when((daily_vol < 0) | (daily_vol > 1), F.raise_error(F.lit("daily volatility must be a fraction"))).otherwise(daily_vol)
    return F.lit(float(y)) * vol * F.sqrt(participation(notional, adv_value)) * F.lit(1e4)


def trade_cost_bp(side: Column, notional: Column, adv_value: Column, daily_vol: Column, market: Column, on: Column, half_spread_bp: Column, y: float = 1.0) -> Column:
    """One-way cost in basis points: commission, sell tax, half spread, impact."""
    which = F.upper(side)
    tax = F.when(which == "SELL", sell_tax(on, market).cast("double")).when(which == "BUY", F.lit(0.0)).otherwise(F.raise_error(F.lit("side must be BUY or SELL")))
    spread = F.when(half_spread_bp < 0, F.raise_error(F.lit("half spread must not be negative"))).otherwise(half_spread_bp)
    return (F.lit(float(COMMISSION)) + tax) * F.lit(1e4) + spread + sqrt_impact_bp(notional, adv_value, daily_vol, y)


def limit_filled(side: str, limit: Column, extreme: Column, basis: str = "through") -> Column:
    """Whether a limit order filled: its price was passed ('through') or reached ('touch') by the low (buy) or high (sell)."""
    if basis not in ("through", "touch"):
        raise ValueError(f"unknown basis: {basis}")
    gap = (limit - extreme) if side == "BUY" else (extreme - limit)
    return F.coalesce(gap > 1e-9 if basis == "through" else gap >= -1e-9, F.lit(False))


def size_multiplier(turnover: Column, threshold: float, thin: float) -> Column:
    """1, or `thin` for names below the turnover threshold and for unknown turnover; a threshold of 0 or less never thins."""
    if threshold <= 0:
        return F.lit(1.0)
    return F.when(turnover >= threshold, F.lit(1.0)).otherwise(F.lit(float(thin)))


__all__ = ["fill_price", "limit_filled", "participation", "round_to_tick", "round_to_tick_up", "round_trip_cost", "sell_tax", "size_multiplier", "sqrt_impact_bp", "trade_cost", "trade_cost_bp"]

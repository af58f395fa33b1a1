"""Exchange rules as column expressions: boards, lots, ticks, limits, fees, floors and auction prices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boards by code prefix, lots (minimum, increment), tick.
STAR, CHINEXT, BSE, MAIN = "STAR", "CHINEXT", "BSE", "MAIN"
TICK = 0.01

# Fee schedule (component, first day, last day, rate on value).
FEES: list[tuple[str, str, str | None, float]] = [
    ("stamp", "1900-01-01", "2023-08-27", 0.001),
    ("stamp", "2023-08-28", None, 0.0005),
    ("handling_SH", "1900-01-01", "2012-05-31", 0.0001100),
    ("handling_SH", "2012-06-01", "2012-08-31", 0.0000870),
    ("handling_SH", "2012-09-01", "2015-07-31", 0.0000696),
    ("handling_SH", "2015-08-01", "2023-08-27", 0.0000487),
    ("handling_SH", "2023-08-28", None, 0.0000341),
    ("handling_SZ", "1900-01-01", "2012-05-31", 0.0001220),
    ("handling_SZ", "2012-06-01", "2012-08-31", 0.0000870),
    ("handling_SZ", "2012-09-01", "2015-07-31", 0.0000696),
    ("handling_SZ", "2015-08-01", "2023-08-27", 0.0000487),
    ("handling_SZ", "2023-08-28", None, 0.0000341),
    ("handling_BSE", "2021-11-15", "2022-11-30", 0.0005),
    ("handling_BSE", "2022-12-01", "2023-08-27", 0.00025),
    ("handling_BSE", "2023-08-28", None, 0.000125),
    ("transfer_SH", "1900-01-01", "2015-07-31", 0.0),
    ("transfer_SH", "2015-08-01", "2022-04-28", 0.00002),
    ("transfer_SH", "2022-04-29", None, 0.00001),
    ("transfer_SZ", "1900-01-01", "2015-07-31", 0.0000255),
    ("transfer_SZ", "2015-08-01", "2022-04-28", 0.00002),
    ("transfer_SZ", "2022-04-29", None, 0.00001),
    ("transfer_BSE", "1900-01-01", "2022-04-28", 0.00002),
    ("transfer_BSE", "2022-04-29", None, 0.00001),
    ("par_SH", "1900-01-01", "2012-05-31", 0.0005),
    ("par_SH", "2012-06-01", "2012-08-31", 0.000375),
    ("par_SH", "2012-09-01", "2015-07-31", 0.0003),
    ("par_SH", "2015-08-01", None, 0.0),
    ("regulatory", "1900-01-01", "2011-12-31", 0.00004),
    ("regulatory", "2012-01-01", None, 0.00002),
]


def board(code: Column) -> Column:
    return F.when(code.rlike("^(688|689)"), STAR).when(code.rlike("^(300|301)"), CHINEXT).when(code.rlike("^(8|4|920)"), BSE).otherwise(MAIN)


def exchange(code: Column) -> Column:
    return F.when(board(code) == BSE, "BSE").when(code.startswith("6"), "SH").otherwise("SZ")


def minimum_lot(code: Column) -> Column:
    return F.when(board(code) == STAR, 200).otherwise(100)


def lot_increment(code: Column) -> Column:
    return F.when(board(code).isin(STAR, BSE), 1).otherwise(100)


def legal_shares(code: Column, shares: Column) -> Column:
    """The largest legal number of shares that is not above the wanted one."""
    low, step = minimum_lot(code), lot_increment(code)
    return F.when(shares >= low, low + F.floor((shares - low) / step) * step).otherwise(F.lit(0)).cast("long")


def tick_price(price: Column, side: Column) -> Column:
    """Buyers round up to a tick, sellers down, with slack for floating error."""
    return F.round(F.when(side == "BUY", F.ceil(price / TICK - 1e-10)).otherwise(F.floor(price / TICK + 1e-10)) * TICK, 2)


def limit_rate(code: Column, day: Column, is_st: Column) -> Column:
    kind = board(code)
    return (
        F.when(kind == BSE, 0.30)
        .when(kind == STAR, 0.20)
        .when(kind == CHINEXT, F.when(day >= F.lit("2020-08-24").cast("date"), 0.20).otherwise(F.when(is_st, 0.05).otherwise(0.10)))
        .when(is_st, 0.05)
        .otherwise(0.10)
    )


def limit_blocked(side: Column, open_: Column, prev_close: Column, rate: Column, limit_up: Column, limit_down: Column, no_limit: Column, buffer: float = 0.002) -> Column:
    """Buys at an upper limit and sells at a lower one do not trade; stated limit prices come first."""
    move = open_ / prev_close - 1
    at_top = F.when(limit_up > 0, open_ >= limit_up * (1 - buffer)).otherwise(move >= rate - buffer)
    at_bottom = F.when(limit_down > 0, open_ <= limit_down * (1 + buffer)).otherwise(move <= -rate + buffer)
    priced = (open_ > 0) & (prev_close > 0) & (F.coalesce(no_limit, F.lit(0)) == 0)
    return F.coalesce(priced & F.when(side == "BUY", at_top).otherwise(at_bottom), F.lit(False))


def scheduled_rate(component: str, day: Column) -> Column:
    """Rate of the first row that covers the day, else of the last row: a date-effective lookup as one expression."""
    rows = [r for r in FEES if r[0] == component]
    out = F.lit(rows[-1][3])
    for _, start, end, rate in reversed(rows):
        out = F.when((day >= F.lit(start).cast("date")) & (day <= F.lit(end or "9999-12-31").cast("date")), rate).otherwise(out)
    return out


def trade_cost(gross: Column, side: Column, code: Column, day: Column, shares: Column, commission: float = 0.0, minimum: float = 0.0) -> Column:
    """Fees on value by side, exchange and day, the old par-value transfer fee, and a commission with a minimum."""
    at = exchange(code)
    by_exchange = lambda name: F.when(at == "BSE", scheduled_rate(f"{name}_BSE", day)).when(at == "SH", scheduled_rate(f"{name}_SH", day)).otherwise(scheduled_rate(f"{name}_SZ", day))
    rate = F.when(side == "SELL", scheduled_rate("stamp", day)).otherwise(0.0) + by_exchange("handling") + scheduled_rate("regulatory", day) + by_exchange("transfer")
    par = F.when(at == "SH", shares * scheduled_rate("par_SH", day)).otherwise(0.0)
    fee = F.greatest(gross * commission, F.lit(minimum)) if commission > 0 else F.lit(0.0)
    return F.when(gross > 0, gross * rate + par + fee).otherwise(0.0)


def risk_floor(floor: Column, value: Column, side: Column, current: Column, target: Column, band: float, reduce: float, increase: float) -> Column:
    """A lower floor for orders that bring total exposure back into its band."""
    relaxed = F.when((side == "SELL") & (current > target + band), value * reduce).when((side == "BUY") & (current < target - band), value * increase)
    return F.coalesce(F.least(floor, relaxed), floor)


def trade_floor(transition: Column, value: Column, minimum: float, entry_minimum: float, fraction: float = 0.0, entry_fraction: float = 0.0) -> Column:
    """Least value worth trading: entries have their own, exits none."""
    entry = F.greatest(F.lit(entry_minimum), value * entry_fraction)
    return F.when(transition == "EXIT", 0.0).when(transition == "ENTRY", entry).otherwise(F.greatest(F.lit(minimum), value * fraction))


def commission_floor(minimum: float, fraction: float) -> float:
    """Order value at which the minimum commission is that fraction."""
    return minimum / fraction if minimum > 0 and fraction > 0 else 0.0


def slipped(price: Column, side: Column, bps: float) -> Column:
    return price * F.when(side == "BUY", 1 + bps / 1e4).otherwise(1 - bps / 1e4)


def auction_limit(close: Column, low_gap: Column, high_gap: Column, side: Column, buffer_bps: float) -> Column:
    buffer = buffer_bps / 1e4
    return tick_price(close * F.when(side == "BUY", 1 + high_gap + buffer).otherwise(1 + low_gap - buffer), side)


def marketable(side: Column, limit: Column, open_: Column) -> Column:
    return F.when(side == "BUY", open_ <= limit).otherwise(open_ >= limit)


def share_factor(capital_return: Column, prev_close: Column, close: Column) -> Column:
    """Shares after a corporate action per share before; 1 within 2 % of it or out of bounds."""
    f = (1 + capital_return) * prev_close / close
    return F.when(f.between(0.1, 10) & (F.abs(f - 1) >= 0.02), f).otherwise(1.0)


def action_cash(prev_close: Column, total_return: Column, capital_return: Column, shares: Column) -> Column:
    return F.coalesce(prev_close * (total_return - capital_return) * shares, F.lit(0.0))


def round_trip_cost(value: Column, sell_code: Column, buy_code: Column, day: Column, commission: float = 0.0, minimum: float = 0.0) -> Column:
    """Cost of selling one name and buying another for the same value, as a share of it; infinite without a value."""
    none = F.lit(0.0)
    both = trade_cost(value, F.lit("SELL"), sell_code, day, none, commission, minimum) + trade_cost(value, F.lit("BUY"), buy_code, day, none, commission, minimum)
    return F.when(value > 0, both / value).otherwise(float("inf"))

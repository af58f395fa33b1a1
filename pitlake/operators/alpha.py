"""Fundamental inputs of scores per date: earnings yield, quality and growth, and the market's group weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions import columns as C
from pitlake.operators.crosssection import wide_robust_z

# Weights of the parts of each blend. Accruals and leverage count against quality.
EARNINGS_YIELD = {"earnings_to_price": 0.67, "cashflow_to_price": 0.33}
QUALITY = {"roe": 0.35, "cash_conversion": 0.30, "accruals": 0.20, "leverage": 0.15}
AGAINST = {"accruals", "leverage"}
GROWTH = {"revenue_growth": 0.45, "earnings_growth": 0.55}


def market_cap(float_cap: str = "float_market_cap", total_cap: str = "total_market_cap"):
    """Float capitalisation, else the total one, else 0."""
    return F.coalesce(C.positive(F.col(float_cap)), C.positive(F.col(total_cap)), F.lit(0.0))


def group_weights(rows: DataFrame, date: str, group: str, name: str = "market_industry_weight") -> DataFrame:
    """(date, group, weight): each group's share of a date's capitalisation; none where nothing has one."""
    sums = rows.groupBy(date, group).agg(F.sum(market_cap()).alias("_cap"))
    total = F.sum("_cap").over(Window.partitionBy(date))
    return sums.select(date, group, F.when(total > 0, F.col("_cap") / total).alias(name))


def alpha_inputs(rows: DataFrame, date: str = "model_date", group: str = "industry_group") -> DataFrame:
    """``rows`` (one a date and code, statements attached as of the date) with earnings_yield_raw, quality_raw and growth_raw.

    Blends are over the parts that are there. Ratios to price, equity and assets need a positive denominator;
    quality's parts are robust z-scores of the date, null in cross-sections below 20 values. ``rows`` are read several times.
    """
    profit, cash = F.col("parent_net_profit_ttm"), F.col("operating_cashflow_ttm")
    cap, assets = F.col("total_market_cap"), F.col("total_assets")
    ratios = {
        "earnings_to_price": C.ratio(profit, cap, True), "cashflow_to_price": C.ratio(cash, cap, True), "roe": C.ratio(profit, F.col("parent_equity"), True),
        "cash_conversion": C.ratio(cash, F.abs(profit)), "accruals": C.ratio(profit - cash, assets, True), "leverage": C.ratio(F.col("total_liabilities"), assets, True),
    }
    out = rows.withColumns({f"_{k}": v for k, v in ratios.items()} | {f"_{k}": F.col(k) for k in GROWTH})
    parts = {k: C.finite(F.col(f"_{k}")) for k in (*ratios, *GROWTH)}  # step by step, as code in one piece grows too large to be compiled
    out = out.withColumns({f"_{k}": -v if k in AGAINST else v for k, v in parts.items()}).withColumn("_cash_conversion", C.clip(F.col("_cash_conversion"), -3.0, 3.0))
    out = wide_robust_z(out, {f"_{k}": f"_z_{k}" for k in QUALITY}, [date])
    out = out.withColumns({
        "earnings_yield_raw": C.weighted_available([(F.col(f"_{k}"), w) for k, w in EARNINGS_YIELD.items()]),
        "quality_raw": C.weighted_available([(F.col(f"_z_{k}"), w) for k, w in QUALITY.items()]),
        "growth_raw": C.weighted_available([(F.col(f"_{k}"), w) for k, w in GROWTH.items()]),
    })
    return out.drop(*[f"_{k}" for k in parts], *[f"_z_{k}" for k in QUALITY])


def weekly_alpha(rows: DataFrame, market: DataFrame | None = None, date: str = "model_date", group: str = "industry_group") -> DataFrame:
    """Alpha inputs with the market weight of each row's group; ``market`` has all capitalised rows of the dates, by default ``rows``."""
    weights = group_weights(rows if market is None else market, date, group)
    return alpha_inputs(rows, date, group).join(F.broadcast(weights), [date, group], "left")  # a row a date and group


def dates_to_build(wanted: DataFrame, built: DataFrame, date: str = "model_date") -> DataFrame:
    """Dates after the last one built; all of them where none is, and the whole schedule again where it no longer holds what was built."""
    w, b = wanted.select(date).distinct(), built.select(date).distinct()
    state = b.agg(F.max(date).alias("_last")).crossJoin(b.join(w, date, "left_anti").agg(F.count("*").alias("_lost")))  # one row
    return w.crossJoin(F.broadcast(state)).where(F.col("_last").isNull() | (F.col("_lost") > 0) | (F.col(date) > F.col("_last"))).select(date)

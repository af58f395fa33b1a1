"""Which rows and dates count: universes, floors, as-of dates and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_special(name: Column) -> Column:
    """Names of companies under special treatment."""
    return F.coalesce(F.upper(name).contains("ST"), F.lit(False))


def tradable(stats: DataFrame, decision, least_days: int, least_amount: float) -> DataFrame:
    """Codes with history, turnover, a price on the decision day, normal state and a capitalisation."""
    ok = (F.col("days") >= least_days) & (F.col("avg_amount_60") >= least_amount) & (F.col("listed_state") == "Norm") & (F.col("latest_trade_date") == decision)
    return stats.where(ok & F.col("close").isNotNull() & ~is_special(F.col("name")) & F.col("market_cap").isNotNull())


def quantile_floor(df: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """Rows at or above the q-quantile of their group."""
    if q <= 0:
        return df
    return df.withColumn("_floor", F.percentile(value, F.lit(q)).over(Window.partitionBy(*by))).where(F.col(value) >= F.col("_floor")).drop("_floor")


def modelled(df: DataFrame, least_history: int = 126, least_amount: float = 5e6, exclude_special: bool = True) -> DataFrame:
    """Rows of a risk model's universe."""
    out = df.where((F.col("market_cap") > 0) & (F.col("history_days") >= least_history) & (F.col("avg_amount_60") >= least_amount))
    return out.where(~is_special(F.col("listed_state"))) if exclude_special else out


def market_types(df: DataFrame, allowed: list[int], key: list[str]) -> DataFrame:
    """Rows of the allowed market types whose key is complete."""
    out = df.where(F.col("market_type").isin(allowed))
    for c in key:
        out = out.where(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return out


def resolve_dates(days: DataFrame, day: str, *asked: str) -> DataFrame:
    """One row: for each asked day the last known one at or before it, and the first and last of all."""
    d = F.col(day)
    return days.agg(*[F.max(F.when(d <= F.lit(a).cast("date"), d)).alias(f"as_of_{i}") for i, a in enumerate(asked)], F.min(d).alias("first_day"), F.max(d).alias("last_day"))


def with_previous(dates: DataFrame, date: str, name: str = "previous_date") -> DataFrame:
    """Distinct dates with the one before; a calendar has a row a date."""
    return dates.select(date).distinct().withColumn(name, F.lag(date).over(Window.orderBy(date)))


def first_decision_of_month(week_ends: DataFrame, as_of: DataFrame, date: str, asked: str) -> DataFrame:
    """For each asked day the first week's end of its month up to it, else the day itself."""
    month = week_ends.groupBy(F.trunc(date, "MM").alias("_m")).agg(F.min(date).alias("_first"))
    out = as_of.withColumn("_m", F.trunc(asked, "MM")).join(month, "_m", "left")
    return out.withColumn("decision_date", F.when(F.col("_first") <= F.col(asked), F.col("_first")).otherwise(F.col(asked))).drop("_m", "_first")


def build_checks(rows: DataFrame) -> DataFrame:
    """One row: rows, codes, and rows that break the order of open, high, low and close, repeat or have no group."""
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    return rows.agg(
        F.count("*").alias("rows"), F.countDistinct("code").alias("codes"), F.count_if(bad).alias("price_order_violations"), F.count_if(F.least("open", "high", "low", "close") <= 0).alias("nonpositive_prices"),
        F.count_if(F.coalesce(F.col("industry_group"), F.lit("UNKNOWN")) == "UNKNOWN").alias("unknown_industry"), F.avg(F.col("close").isNotNull().cast("double")).alias("close_coverage"),
    )


def status(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, rows, first_day, last_day) of each named table with its date column."""
    out = None
    for name, (df, date) in tables.items():
        row = df.agg(F.count("*").alias("rows"), F.min(date).cast("date").alias("first_day"), F.max(date).cast("date").alias("last_day")).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.union(row)
    return out

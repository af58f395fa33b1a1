"""Financial statements point in time: consolidation, trailing twelve months and growth by self-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consolidate(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """All keys of any table, with the columns of each where it has the key."""
    out = reduce(lambda a, b: a.union(b), [t.select(*keys) for t in tables]).distinct()
    for t in tables:
        out = out.join(t, keys, "left")
    return out


def trailing_twelve_months(ytd: DataFrame, by: str, year: str, part: str, last_part, values: list[str], available: str) -> DataFrame:
    """Current year-to-date + prior full year - prior same period, null if one is missing.

    Joins on the shifted period rather than lagged rows: periods may be missing. A full year is its own
    sum. The result is available when all that it is made of is, and never if one has no date.
    """
    annual = ytd.where(F.col(part) == last_part).select(by, (F.col(year) + 1).alias(year), *[F.col(v).alias(f"_a_{v}") for v in values], F.col(available).alias("_a_at"))
    same = ytd.select(by, (F.col(year) + 1).alias(year), part, *[F.col(v).alias(f"_s_{v}") for v in values], F.col(available).alias("_s_at"))
    out = ytd.join(annual, [by, year], "left").join(same, [by, year, part], "left")
    full = F.col(part) == last_part
    ttm = [F.when(full, F.col(v)).otherwise(F.col(v) + F.col(f"_a_{v}") - F.col(f"_s_{v}")).alias(f"{v}_ttm") for v in values]
    all_dates = F.col(available).isNotNull() & F.col("_a_at").isNotNull() & F.col("_s_at").isNotNull()
    at = F.when(full, F.col(available)).when(all_dates, F.greatest(available, "_a_at", "_s_at"))
    return out.select(by, year, part, *values, available, *ttm, at.alias("ttm_available"))


def growth(ttm: DataFrame, by: str, year: str, part: str, value: str, available: str) -> DataFrame:
    """Growth on the same period a year before, over its absolute value."""
    before = ttm.select(by, (F.col(year) + 1).alias(year), part, F.col(value).alias("_before"), F.col(available).alias("_before_at"))
    out = ttm.join(before, [by, year, part], "left")
    g = F.when(F.abs("_before") > 1e-12, (F.col(value) - F.col("_before")) / F.abs("_before"))
    at = F.when(F.col(available).isNotNull() & F.col("_before_at").isNotNull(), F.greatest(available, "_before_at"))
    return out.withColumn(f"{value}_growth", g).withColumn("growth_available", at).drop("_before", "_before_at")

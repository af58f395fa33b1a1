"""Data quality, look-ahead audits and status: one pass of conditional aggregates each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def panel_checks(panel: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, keys, repeated keys, days, and rows that break price and volume rules."""
    per_key = panel.groupBy(*key).agg(F.count("*").alias("_n"), F.count_if(F.col("close").isNull()).alias("_null"), F.count_if(F.col("close") <= 0).alias("_bad"), F.count_if(F.col("amount") < 0).alias("_neg"), F.min("trade_date").alias("_d"), F.max("trade_date").alias("_e"))
    return per_key.agg(
        F.sum("_n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("_n") > 1).alias("repeated_keys"), F.sum("_null").alias("missing_close"),
        F.sum("_bad").alias("nonpositive_close"), F.sum("_neg").alias("negative_amount"), F.min("_d").alias("first_day"), F.max("_e").alias("last_day"),
    )


def lookahead_audit(rows: DataFrame, date: str, strictly_before: list[str], not_after: list[str]) -> DataFrame:
    """One row: rows whose sources were not known at their date, by source column."""
    return rows.agg(*[F.count_if(F.col(c) >= F.col(date)).alias(f"{c}_violations") for c in strictly_before], *[F.count_if(F.col(c) > F.col(date)).alias(f"{c}_violations") for c in not_after])


def out_of_order(rows: DataFrame, by: list[str], order: str, date: str) -> DataFrame:
    """Rows whose date is not after the row before them in file order."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_before", F.lag(date).over(w)).where(F.col("_before") >= F.col(date)).drop("_before")


def rejected(rows: DataFrame, rules: list[tuple[str, object]]) -> DataFrame:
    """Rows with the first reason against them, null for accepted ones."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(True)), F.lit(name)).otherwise(reason)
    return rows.withColumn("reason", reason)


def coverage_by(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Share of rows that have each column, per group."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_coverage") for c in columns])


def require_coverage(rows: DataFrame, columns: list[str], least: float = 0.5) -> None:
    """Fail where a required column is there for too few rows."""
    shares = rows.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns]).first().asDict()
    short = {c: s for c, s in shares.items() if (s or 0.0) < least}
    if short:
        raise ValueError(f"columns with too little coverage: {short}")

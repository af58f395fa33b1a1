"""Point-in-time joins: as-of attachment, strict availability, staleness, and latest rows per group."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an explicit order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], max_days: int | None = None, strict: bool = False) -> DataFrame:
    """``left`` with the values of the last right row at or before (``strict``: before) its time, per ``by``.

    One shuffle on ``by``: both sides are stacked and the last right row is carried forward. Of several
    right rows at one time the greatest values win. Rows older than ``max_days`` count as absent. Right rows
    without a time or a key match nothing, and neither do left rows: those without a key are spread over all tasks.
    """
    carried = F.struct(F.col(right_on).alias("_at"), *values)
    known = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in by])
    r = right.where(known & F.col(right_on).isNotNull()).groupBy(*by, right_on).agg(F.max(F.struct(*values)).alias("_v")).select(*by, right_on, "_v.*")
    r = r.select(*by, F.col(right_on).alias("_t"), F.lit(1 if strict else 0).alias("_side"), carried.alias("_r"), F.lit(None).cast(_row_type(left)).alias("_row"))
    rows = left.select(*by, F.col(left_on).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_row"))
    spread = F.when(~known, F.xxhash64("_row"))
    w = Window.partitionBy(*by, spread).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = r.union(rows).withColumn("_found", F.last("_r", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    fresh = F.lit(True) if max_days is None else F.datediff(F.col("_t"), F.col("_found._at")) <= max_days
    found = [F.when(fresh, F.col(f"_found.{v}")).alias(v) for v in values]
    return out.select("_row.*", F.when(fresh, F.col("_found._at")).alias(f"{right_on}_asof"), *found)


def _row_type(df: DataFrame) -> str:
    return df.schema.simpleString()


def next_trading_day(events: DataFrame, available: str, calendar: DataFrame, day: str = "trade_date", name: str = "effective_date") -> DataFrame:
    """Events with the first calendar day strictly after they became available; null after the last."""
    days = Window.orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)
    known = events.select(F.to_date(available).alias("_d")).where("_d is not null").distinct().withColumn("_day", F.lit(None).cast("date"))
    # One row a day on both sides: the calendar's day, or that of an event, carried back to the days before.
    stacked = calendar.select(F.col(day).cast("date").alias("_d")).distinct().withColumn("_day", F.col("_d")).union(known).groupBy("_d").agg(F.max("_day").alias("_day"))
    following = stacked.select("_d", F.min("_day").over(days).alias(name))
    return events.withColumn("_d", F.to_date(available)).join(following, "_d", "left").drop("_d")


def newest_period_asof(dates: DataFrame, events: DataFrame, by: list[str], date: str, effective: str, period: str, values: list[str]) -> DataFrame:
    """Per date and entity the values of the newest period effective by then: a late restatement of an older period never wins."""
    best = F.struct(F.col(period), F.col(effective), *values)
    w = Window.partitionBy(*by).orderBy(effective, period).rowsBetween(Window.unboundedPreceding, 0)
    running = events.where(F.col(effective).isNotNull()).withColumn("_best", F.max(best).over(w))
    running = running.groupBy(*by, effective).agg(F.max("_best").alias("_best"))
    flat = running.select(*by, effective, F.col(f"_best.{period}").alias(period), *[F.col(f"_best.{v}").alias(v) for v in values])
    return asof_join(dates, flat, by, date, effective, [period, *values])


def prioritised_group_asof(dates: DataFrame, history: DataFrame, by: str, date: str, classes: list[tuple[str, str | None]], digits: int) -> DataFrame:
    """Group of an entity at a date from the first classification that has one.

    ``classes``: (classification_id, first day it may be used). A group is the first ``digits`` of the
    industry code; UNKNOWN where no classification has one. A row without an implementation date is never in force.
    """
    out = dates
    names = []
    for k, (cls, since) in enumerate(classes):
        own = history.where(F.col("classification_id") == cls)
        start = F.when(F.col("implement_date").isNotNull(), F.greatest("implement_date", F.lit(since).cast("date"))) if since else F.col("implement_date")
        own = own.select(by, start.alias("_start"), F.col("industry_code").alias(f"_c{k}"))
        out = asof_join(out, own, [by], date, "_start", [f"_c{k}"]).drop("_start_asof")
        names.append(f"_c{k}")
    return out.withColumn("industry_group", F.coalesce(*[F.substring(n, 1, digits) for n in names], F.lit("UNKNOWN"))).drop(*names)


def usable_snapshots(snapshots: DataFrame, date: str, *others: DataFrame) -> DataFrame:
    """Snapshot dates that all other tables have as well."""
    out = snapshots.select(date).distinct()
    for o in others:
        out = out.join(o.select(date), date, "left_semi")
    return out


def coverage(left: DataFrame, right: DataFrame, on: list[str], compare: str | None = None) -> DataFrame:
    """One row: matched, unmatched on either side and, of the matched, those that differ in ``compare``."""
    matched = left.join(right, on, "left_semi").agg(F.count("*").alias("matched"))
    out = matched.crossJoin(left.join(right, on, "left_anti").agg(F.count("*").alias("left_only"))).crossJoin(right.join(left, on, "left_anti").agg(F.count("*").alias("right_only")))
    if compare:
        r = right.withColumnRenamed(compare, "_other")
        out = out.crossJoin(left.join(r, on).agg(F.count_if(~F.col(compare).eqNullSafe(F.col("_other"))).alias("mismatched")))
    return out

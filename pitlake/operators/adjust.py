"""Adjusted prices: factors in force from one ex-date to the next, joined by bucketed date ranges; no-limit days and closing views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators.asof import latest_per_group

OPEN_END = "9999-12-31"


def interval_join(left: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, values: list[str], bucket_days: int = 366) -> DataFrame:
    """``left`` with the values of each interval of its key that holds its date (``start`` included, ``end`` not); rows without one have nulls.

    Intervals may overlap: a row then comes once for each. Both sides are dealt by key and bucket of ``bucket_days`` days, so a key with a long
    history is spread over its buckets and a row meets the intervals of its own bucket alone; an interval is repeated for each
    bucket of days that it covers and in which there may be rows. A row without a date or key, and an interval without a key or start, match nothing;
    an interval without an end is open.
    """
    days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    bucket = lambda c: F.floor(days(c) / bucket_days).cast("int")
    # Open intervals need no more buckets than the rows have.
    last = left.agg(F.max(at).alias("_last"), F.min(at).alias("_first"))
    spans = intervals.where(F.col(start).isNotNull()).select(*by, F.col(start).alias("_start"), F.coalesce(F.col(end), F.lit(OPEN_END).cast("date")).alias("_end"), *values).where("_end > _start").crossJoin(F.broadcast(last))  # one row
    spans = spans.where((F.col("_start") <= F.col("_last")) & (F.col("_end") > F.col("_first")))
    cover = F.sequence(bucket(F.greatest("_start", "_first")), bucket(F.least(F.date_sub("_end", 1), F.col("_last"))))
    spans = spans.withColumn("_bucket", F.explode(cover)).drop("_last", "_first")
    row = left.withColumn("_bucket", bucket(F.col(at)))
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*by, "_bucket"]]
    inside = (F.col(f"l.{at}") >= F.col("r._start")) & (F.col(f"l.{at}") < F.col("r._end"))
    condition = inside
    for x in on:
        condition = condition & x
    out = row.alias("l").join(spans.alias("r"), condition, "left")
    return out.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{v}") for v in values])


def in_force(events: DataFrame, by: list[str], ex_date: str, factor: str) -> DataFrame:
    """(by, start, end, cumulative, total): after each ex-date the product of all factors up to it, until the next; and the product of all.

    Factors of one day are multiplied. Those that are missing or not positive change nothing.
    """
    ok = events.where((F.col(factor) > 0) & F.col(ex_date).isNotNull())
    day = ok.groupBy(*by, F.col(ex_date).cast("date").alias("start")).agg(F.sum(F.ln(factor)).alias("_log"))
    w = Window.partitionBy(*by).orderBy("start")
    upto = F.sum("_log").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return day.select(*by, "start", F.lead("start").over(w).alias("end"), F.exp(upto).alias("cumulative"), F.exp(F.sum("_log").over(Window.partitionBy(*by))).alias("total"))


def adjusted_prices(prices: DataFrame, events: DataFrame, by: list[str], date: str, price: str, ex_date: str, factor: str) -> DataFrame:
    """``prices`` with backward_factor, backward_price (the first price as it was) and forward_price (the last as it is).

    Before a key's first ex-date the cumulative factor is 1; keys without events keep their prices.
    """
    spans = in_force(events, by, ex_date, factor)
    # The time before the first ex-date is an interval too, so that the total reaches those rows.
    first = spans.groupBy(*by).agg(F.lit("0001-01-01").cast("date").alias("start"), F.min("start").alias("end"), F.lit(1.0).alias("cumulative"), F.first("total").alias("total"))
    out = interval_join(prices, spans.unionByName(first), by, date, "start", "end", ["cumulative", "total"])
    factor_now = F.coalesce("cumulative", F.lit(1.0))
    return out.select(*prices.columns, factor_now.alias("backward_factor"), (F.col(price) * factor_now).alias("backward_price"), (F.col(price) * factor_now / F.coalesce("total", F.lit(1.0))).alias("forward_price"))


def with_no_limit(days: DataFrame, no_limit: DataFrame, by: list[str], date: str) -> DataFrame:
    """``days`` with no_limit (0 or 1) and its reason, the first in order where a day has several."""
    known = no_limit.groupBy(*by, date).agg(F.min("reason").alias("no_limit_reason"), F.lit(1).alias("no_limit"))
    return days.join(known, [*by, date], "left").fillna(0, ["no_limit"])


def closing_views(daily: DataFrame, code: str = "code", date: str = "trade_date") -> dict[str, DataFrame]:
    """What a build ends with: ``latest_prices``, each code's last row; ``stock_meta``, its describing columns under their closing names; ``returns``, the rows that have one."""
    last = latest_per_group(daily, [code], [F.desc(date)])
    kept = [c for c in ("name", "listed_state", "currency", "industry_1", "industry_2") if c in daily.columns]
    return {"latest_prices": last, "stock_meta": last.select(code, F.col(date).alias("latest_trade_date"), F.col("close").alias("latest_close"), *kept), "returns": daily.where("daily_return is not null")}

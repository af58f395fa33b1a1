"""Attaching model outputs by time: snapshots, calibrations, realised returns and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators.asof import asof_join


def augment(rows: DataFrame, snapshots: DataFrame, date: str, snapshot_date: str, code: str, values: list[str], max_days: int, covered: float = 0.8) -> DataFrame:
    """Rows with the values of the last snapshot before their date, and whether it was applied, partial or missing.

    The date is resolved among snapshot dates first, so all codes of a date see the same snapshot.
    """
    dates = asof_join(rows.select(date).distinct().withColumn("_k", F.lit(0)), snapshots.select(F.col(snapshot_date).alias("_s")).distinct().withColumns({"_k": F.lit(0), "_used": F.col("_s")}), ["_k"], date, "_s", ["_used"], max_days, strict=True)
    found = rows.join(dates.select(date, "_used"), date, "left")
    own = snapshots.select(F.col(snapshot_date).alias("_used"), code, *values)
    out = found.join(own, ["_used", code], "left")
    share = F.avg(F.greatest(*[F.col(v).isNotNull().cast("double") for v in values]) if len(values) > 1 else F.col(values[0]).isNotNull().cast("double")).over(Window.partitionBy(date))
    state = F.when(F.col("_used").isNull(), "no_causal_snapshot").when(share >= covered, "applied").otherwise("partial")
    return out.withColumns({"snapshot_coverage": share, "snapshot_status": state}).withColumnRenamed("_used", "snapshot_date_used")


def calibration_at(dates: DataFrame, schedule: DataFrame, date: str, as_of: str, default: float = 1.0) -> DataFrame:
    """The multiplier of the last calibration at or before each date; the default before the first."""
    out = asof_join(dates.withColumn("_k", F.lit(0)), schedule.withColumn("_k", F.lit(0)), ["_k"], date, as_of, ["multiplier"])
    return out.select(date, F.coalesce("multiplier", F.lit(default)).alias("multiplier"), F.when(F.col("multiplier").isNull(), "default").otherwise("schedule").alias("source"))


def exposure_with_realised(exposures: DataFrame, returns: DataFrame, date: str = "model_date") -> DataFrame:
    """Exposures of one model date with the returns of the next."""
    calendar = exposures.select(date).union(returns.select(date)).distinct().withColumn("_next", F.lead(date).over(Window.orderBy(date)))  # a row a date
    nxt = returns.withColumnRenamed(date, "_next").withColumnRenamed("weekly_return", "realised_return")
    return exposures.join(calendar, date).join(nxt, ["code", "_next"]).withColumnRenamed("_next", "realised_date")


def forecast_pairs(realised: DataFrame, covariance: DataFrame, specific: DataFrame) -> DataFrame:
    """Distinct (exposure_date, model_date) for whose exposure date covariance and specific risk exist."""
    out = realised.select("exposure_date", "model_date").distinct()
    for other in (covariance, specific):
        out = out.join(other.select(F.col("model_date").alias("exposure_date")).distinct(), "exposure_date", "left_semi")
    return out


def forecast_observations(weights: DataFrame, predicted: DataFrame, returns: DataFrame, least_covered: float = 0.95) -> DataFrame:
    """Realised returns of portfolios formed at one date against their predicted variance, where enough weight has a return.

    ``weights``: exposure_date, portfolio_name, code, weight; ``predicted``: exposure_date, portfolio_name,
    predicted_weekly_variance; ``returns``: exposure_date, code, realised_return.
    """
    by = ["exposure_date", "portfolio_name"]
    joined = weights.join(returns, ["exposure_date", "code"], "left")
    has = F.col("realised_return").isNotNull()
    seen = joined.groupBy(*by).agg(
        (F.sum(F.when(has, F.col("weight"))) / F.sum("weight")).alias("covered"), (F.sum(F.col("weight") * F.col("realised_return")) / F.sum(F.when(has, F.col("weight")))).alias("realized_weekly_return")
    )
    return seen.where(F.col("covered") >= least_covered).join(predicted, by)

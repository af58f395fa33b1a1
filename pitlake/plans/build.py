"""The weekly risk model as tables: every date's regressions and covariances in parallel, appended for new dates alone."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlake.operators import factors, risk
from pitlake.operators.alpha import dates_to_build

@dataclass(frozen=True)
class Model:
    styles: tuple[str, ...]
    window: int = 252
    least: int = 60
    half_life: float = 90.0
    lags: int = 2
    least_specific: int = 20


def _built(spark: SparkSession, folder: str, name: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.parquet(os.path.join(folder, name))
    except AnalysisException:  # nothing written yet
        return like.limit(0)


def build(spark: SparkSession, exposures: DataFrame, folder: str, model: Model) -> list:
    """Append what is missing to the tables under ``folder``; returns the dates it was done for.

    ``exposures``: model_date, code, industry_group, cap, forward_return (realised at the next model date) and styles. Returns are
    filed under the date they are realised at, so a covariance of a date uses none that lie ahead. No date waits for another.
    Each run is a partition named by its last date and overwrites it when rerun; where built dates have left the schedule, all is built anew.
    """
    dates = exposures.select("model_date").distinct()
    following = dates.select("model_date", F.lead("model_date").over(Window.orderBy("model_date")).alias("realised_date"))  # a row a week
    last = dates.agg(F.max("model_date")).first()[0]
    done = _built(spark, folder, "factor_return", dates.withColumn("run", F.lit(None).cast("date"))).where(F.col("run") < F.lit(last)).select("model_date").distinct()
    days = [r[0] for r in dates_to_build(dates, done).orderBy("model_date").collect()]  # one a week
    if not days:
        return []
    newest = done.agg(F.max("model_date")).first()[0]
    mode = "dynamic" if newest is None or days[0] > newest else "static"
    todo = spark.createDataFrame([(d,) for d in days], "model_date date")

    def save(df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(folder, name)
        df.withColumn("run", F.lit(last)).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("run").parquet(path)
        return spark.read.parquet(path).drop("run")

    wanted = following.join(todo.withColumnRenamed("model_date", "realised_date"), "realised_date", "left_semi")
    fresh = factors.factor_returns(exposures.join(wanted.select("model_date"), "model_date", "left_semi"), factors.RegressionSpec(model.styles))
    fresh = fresh.join(wanted, "model_date").select(F.col("realised_date").alias("model_date"), "kind", "name", "value", "r2")
    returns = save(fresh, "factor_return")
    save(factors.factor_covariance(returns, todo, model.window, model.least, model.half_life, model.lags), "factor_covariance")
    own = returns.where("kind = 'specific'").select("model_date", F.col("name").alias("code"), "value")
    groups = exposures.select("model_date", F.col("code").cast("string").alias("code"), "industry_group")
    variances = risk.specific_variance_by_date(own, groups, model.half_life, model.least_specific)
    save(variances.join(todo, "model_date", "left_semi"), "specific_variance")
    return days

"""Specific risk and portfolio risk of a factor model, on long tables; its factor returns and covariances are in ``factors``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators.adjust import interval_join
from pitlake.operators.asof import asof_join
from pitlake.operators.factors import MARKET


def specific_variance(specific: DataFrame, groups: DataFrame, as_of, half_life: float, least: int = 20, shrink: float = 0.2, periods: int = 52) -> DataFrame:
    """(code, industry_group, specific_variance): weighted variance of a code's returns, shrunk to its group's median."""
    rows = specific.where(F.col("model_date") <= F.lit(as_of)).where(F.col("value").isNotNull())
    rows = rows.withColumn("_age", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("model_date"))) - 1).withColumn("_w", F.pow(F.lit(0.5), F.col("_age") / half_life))
    w, x = F.col("_w"), F.col("value")
    own = rows.groupBy("code").agg(F.count("*").alias("_n"), (F.sum(w * x * x) / F.sum(w) - F.pow(F.sum(w * x) / F.sum(w), 2)).alias("_v"))
    own = own.where(F.col("_n") >= least).withColumn("_v", F.col("_v") * periods).join(groups, "code")
    mid = F.median("_v").over(Window.partitionBy("industry_group"))
    return own.select("code", "industry_group", ((1 - shrink) * F.col("_v") + shrink * mid).alias("specific_variance"))


def specific_variance_by_date(specific: DataFrame, groups: DataFrame, half_life: float, least: int = 20, shrink: float = 0.2, periods: int = 52) -> DataFrame:
    """(model_date, code, industry_group, specific_variance) of every date on which a code has a return.

    Weights that halve with age are a common factor times weights that double with the row number, so running
    sums serve all dates at once: a row costs the same for any history.
    """
    by = Window.partitionBy("code").orderBy("model_date")
    x = F.col("value")
    rows = specific.where(x.isNotNull()).withColumn("_n", F.row_number().over(by)).withColumn("_w", F.pow(F.lit(2.0), F.col("_n") / half_life))
    past = by.rowsBetween(Window.unboundedPreceding, 0)
    w = F.col("_w")
    rows = rows.select("model_date", "code", "_n", F.sum(w).over(past).alias("_s"), F.sum(w * x).over(past).alias("_x"), F.sum(w * x * x).over(past).alias("_xx"))
    own = rows.where(F.col("_n") >= least).withColumn("_v", (F.col("_xx") / F.col("_s") - F.pow(F.col("_x") / F.col("_s"), 2)) * periods)
    own = own.join(groups, ["model_date", "code"])
    mid = F.median("_v").over(Window.partitionBy("model_date", "industry_group"))
    return own.select("model_date", "code", "industry_group", ((1 - shrink) * F.col("_v") + shrink * mid).alias("specific_variance"))


def long_exposures(exposures: DataFrame, styles: list[str]) -> DataFrame:
    """(code, factor, value): the market, each style, and one for the code's group."""
    styled = exposures.select("code", F.explode(F.map_from_arrays(F.array(*map(F.lit, styles)), F.array(*styles))).alias("factor", "value"))
    return styled.union(exposures.select("code", F.lit(MARKET), F.lit(1.0))).union(exposures.select("code", "industry_group", F.lit(1.0)))


def portfolio_risk(weights: DataFrame, exposures: DataFrame, covariance: DataFrame, specific: DataFrame, by: list[str]) -> DataFrame:
    """(by, common_variance, specific_variance, total_variance): x'Fx plus squared weights on specific variances.

    Every input is long and stays so: weights (by, code, weight), exposures (code, factor, value),
    covariance (factor_1, factor_2, covariance), specific (code, specific_variance).
    """
    x = weights.join(exposures, "code").groupBy(*by, "factor").agg(F.sum(F.col("weight") * F.col("value")).alias("x"))
    a = x.select(*by, F.col("factor").alias("factor_1"), F.col("x").alias("x1"))
    b = x.select(*by, F.col("factor").alias("factor_2"), F.col("x").alias("x2"))
    common = a.join(covariance, "factor_1").join(b, [*by, "factor_2"]).groupBy(*by).agg(F.sum(F.col("x1") * F.col("covariance") * F.col("x2")).alias("common_variance"))
    own = weights.join(specific, "code").groupBy(*by).agg(F.sum(F.col("weight") * F.col("weight") * F.col("specific_variance")).alias("specific_variance"))
    return common.join(own, by).withColumn("total_variance", F.col("common_variance") + F.col("specific_variance"))


def stock_contributions(weights: DataFrame, exposures: DataFrame, covariance: DataFrame, specific: DataFrame) -> DataFrame:
    """(code, variance_contribution): contributions that sum to the portfolio's variance."""
    x = weights.join(exposures, "code").groupBy("factor").agg(F.sum(F.col("weight") * F.col("value")).alias("x"))
    pull = covariance.join(x.withColumnRenamed("factor", "factor_2"), "factor_2").groupBy(F.col("factor_1").alias("factor")).agg(F.sum(F.col("covariance") * F.col("x")).alias("pull"))
    common = weights.join(exposures, "code").join(pull, "factor").groupBy("code").agg(F.sum(F.col("weight") * F.col("value") * F.col("pull")).alias("common"))
    return common.join(weights.join(specific, "code"), "code").select("code", (F.col("common") + F.col("weight") * F.col("weight") * F.col("specific_variance")).alias("variance_contribution"))


def complete_specific(codes: DataFrame, known: DataFrame) -> DataFrame:
    """Specific variance of every code: unknown ones take the 90 % quantile; with where it comes from."""
    high = known.agg(F.percentile("specific_variance", F.lit(0.9)).alias("_high"))
    out = codes.join(known, "code", "left").crossJoin(F.broadcast(high))  # one row
    return out.select("code", F.coalesce("specific_variance", "_high").alias("specific_variance"), F.when(F.col("specific_variance").isNull(), "completed").otherwise("model").alias("exposure_source"))


def expanding_calibration(observations: DataFrame, as_of: DataFrame, least: int) -> DataFrame:
    """(as_of_date, multiplier, forecast_weeks): from all forecasts realised by each date.

    Returns are centred per portfolio and date: sum r^2 - (sum r)^2 / n. Running sums per portfolio
    stand for the self-join: each date takes the last ones at or before it.
    """
    w = Window.partitionBy("portfolio_name").orderBy("realized_date").rangeBetween(Window.unboundedPreceding, 0)
    r, p = F.col("realized_weekly_return"), F.col("predicted_weekly_variance")
    run = observations.select("portfolio_name", "realized_date", F.sum(r * r).over(w).alias("rr"), F.sum(r).over(w).alias("r"), F.count("*").over(w).alias("n"), F.sum(p).over(w).alias("p"))
    run = run.dropDuplicates(["portfolio_name", "realized_date"])
    grid = as_of.select("as_of_date").distinct().crossJoin(F.broadcast(run.select("portfolio_name").distinct()))  # dates x portfolios of a schedule
    last = asof_join(grid, run, ["portfolio_name"], "as_of_date", "realized_date", ["n", "rr", "r", "p"]).where("n is not null")
    last = last.select("as_of_date", "portfolio_name", F.struct("rr", "r", "n", "p").alias("s"))
    total = last.groupBy("as_of_date").agg(F.sum(F.col("s.rr") - F.col("s.r") * F.col("s.r") / F.col("s.n")).alias("_rr"), F.sum("s.n").alias("_n"), F.sum("s.p").alias("_p"), F.max("s.n").alias("forecast_weeks"))
    ratio = F.sqrt(F.try_divide(F.col("_rr") / F.col("_n"), F.col("_p") / F.col("_n")))
    return total.select("as_of_date", F.when(F.col("forecast_weeks") >= least, ratio).otherwise(1.0).alias("multiplier"), "forecast_weeks")


def rolling_calibration(observations: DataFrame, as_of: DataFrame, least: int, last: int) -> DataFrame:
    """(as_of_date, multiplier, forecast_weeks): as ``expanding_calibration``, from the last ``last`` forecast dates that each date knows alone.

    ``observations`` also has forecast_date; later forecasts are realised later. A forecast date is in use from the day it is realised until
    ``last`` later ones are: an interval, joined with the dates of the schedule. Returns are centred per portfolio over what is in use.
    """
    known = observations.where((F.col("predicted_weekly_variance") > 0) & F.col("realized_weekly_return").isNotNull())
    dates = known.groupBy("forecast_date").agg(F.min("realized_date").alias("_from"))  # a row a week
    dates = dates.withColumn("_to", F.lead("_from", last).over(Window.orderBy("forecast_date")))
    r, p = F.col("realized_weekly_return"), F.col("predicted_weekly_variance")
    sums = known.groupBy("portfolio_name", "forecast_date", "realized_date").agg(F.sum(r * r).alias("rr"), F.sum(r).alias("r"), F.count("*").alias("n"), F.sum(p).alias("p"))
    spans = sums.join(dates, "forecast_date").withColumns({"_k": F.lit(0), "_from": F.col("realized_date")})
    grid = as_of.select(F.lit(0).alias("_k"), "as_of_date").distinct()
    used = interval_join(grid, spans, ["_k"], "as_of_date", "_from", "_to", ["portfolio_name", "forecast_date", "rr", "r", "n", "p"]).where("portfolio_name is not null")
    each = used.groupBy("as_of_date", "portfolio_name").agg((F.sum("rr") - F.sum("r") * F.sum("r") / F.sum("n")).alias("rr"), F.sum("n").alias("n"), F.sum("p").alias("p"))
    weeks = used.groupBy("as_of_date").agg(F.countDistinct("forecast_date").alias("forecast_weeks"))
    total = each.groupBy("as_of_date").agg(F.sum("rr").alias("_rr"), F.sum("n").alias("_n"), F.sum("p").alias("_p")).join(weeks, "as_of_date")
    ratio = F.sqrt(F.try_divide(F.col("_rr") / F.col("_n"), F.col("_p") / F.col("_n")))
    return total.select("as_of_date", F.when(F.col("forecast_weeks") >= least, ratio).otherwise(1.0).alias("multiplier"), "forecast_weeks")


def calibration_summary(observations: DataFrame, by: list[str]) -> DataFrame:
    """Variance ratio, multiplier and breach rates of forecasts per group."""
    r, v = F.col("realized_weekly_return"), F.col("predicted_weekly_variance")
    z = F.abs(r) / F.sqrt(v)
    return observations.groupBy(*by).agg(
        F.count("*").alias("n"), F.try_divide(F.var_samp(r), F.avg(v)).alias("variance_ratio"), F.sqrt(F.avg(r * r) / F.avg(v)).alias("multiplier"),
        F.avg((z > 1.645).cast("double")).alias("breach_90"), F.avg((z > 1.96).cast("double")).alias("breach_95"),
    )


def test_portfolios(exposures: DataFrame, styles: list[str], quantile: float = 0.2, least_group: int = 30) -> DataFrame:
    """(portfolio_name, code, weight): market by cap and equal, low and high of each style, and large groups."""
    everything = Window.partitionBy("model_date")
    rows = [F.struct(F.lit("MARKET_EW").alias("name"), F.col("_ew").alias("weight")), F.struct(F.lit("MARKET_CAP").alias("name"), F.col("_cw").alias("weight"))]
    market = exposures.withColumn("_ew", 1.0 / F.count("*").over(everything)).withColumn("_cw", F.col("cap") / F.sum("cap").over(everything))
    out = market.select("model_date", "code", F.inline(F.array(*rows)))
    for s in styles:
        w = Window.partitionBy("model_date").orderBy(s, "code")
        pct = F.row_number().over(w) / F.count("*").over(Window.partitionBy("model_date"))
        side = F.when(pct <= quantile, F.lit(f"{s}_LOW")).when(pct > 1 - quantile, F.lit(f"{s}_HIGH"))
        own = exposures.select("model_date", "code", side.alias("name")).where("name is not null")
        out = out.union(own.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("model_date", "name"))))
    group = exposures.select("model_date", "code", F.concat(F.lit("INDUSTRY_"), "industry_group").alias("name"), F.count("*").over(Window.partitionBy("model_date", "industry_group")).alias("_n"))
    out = out.union(group.where(F.col("_n") >= least_group).select("model_date", "code", "name", (1.0 / F.col("_n")).alias("weight")))
    return out.withColumnRenamed("name", "portfolio_name")

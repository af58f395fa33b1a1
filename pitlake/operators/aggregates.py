"""Market, industry, performance and trade aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.columns import clip
from pitlake.operators import windows as W


def daily_market(panel: DataFrame, above_average: str, bound: float = 0.12) -> DataFrame:
    """Per day: mean clipped return, share above average and share rising (missing comparisons count as no, missing returns not at all)."""
    r = clip(F.col("daily_return"), -bound, bound)
    return panel.groupBy("trade_date").agg(
        F.avg(r).alias("market_return"),
        F.avg(F.coalesce(F.col("close") > F.col(above_average), F.lit(False)).cast("double")).alias("breadth"),
        F.avg((F.col("daily_return") > 0).cast("double")).alias("up_share"),
        F.countDistinct("code").alias("names"),
    )


def market_regime(panel: DataFrame, average: int = 20, least: int = 10) -> DataFrame:
    """Daily market table: index, its averages, returns, volatility and breadth, and a discrete regime."""
    w = W.series("code")
    daily = daily_market(panel.withColumn("average", W.rolling(F.avg, F.col("close"), w, average, least)), "average")
    # From here on there is one row a day.
    d = Window.orderBy("trade_date")
    out = daily.withColumn("market_index", W.cumulative_index(F.coalesce("market_return", F.lit(0.0)), d))
    out = out.withColumns({
        "average_60": W.rolling(F.avg, F.col("market_index"), d, 60, 30),
        "return_20": W.row_return(F.col("market_index"), d, 20),
        "volatility_20": W.rolling(F.stddev_samp, F.col("market_return"), d, 20, 10) * F.sqrt(F.lit(244.0)),
        "up_5": W.rolling(F.avg, F.col("up_share"), d, 5, 5),
        "drawdown": W.drawdown(F.col("market_index"), d),
    })
    return out.withColumn("regime", regime(F.col("return_20"), F.col("breadth"), F.col("market_index") / F.col("average_60") - 1))


def regime(return_20: Column, breadth: Column, gap: Column) -> Column:
    """First of crash, bear, bull, neutral that holds, else defensive."""
    return (
        F.when((return_20 <= -0.12) & (breadth <= 0.3), "crash")
        .when((gap < 0) & (breadth < 0.4), "bear")
        .when((gap > 0) & (breadth > 0.55), "bull")
        .when(gap > 0, "neutral")
        .otherwise("defensive")
    )


def compound(r: Column) -> Column:
    """Compounded return of returns above -1."""
    return F.expm1(F.sum(F.when(r > -1, F.log1p(r))))


def industry_strength(panel: DataFrame, group: str, n: int, least: int) -> DataFrame:
    """Equal-weight return of each group over its last n days, compounded, with volatility and the excess over all groups' mean."""
    daily = panel.groupBy(group, "trade_date").agg(F.avg("daily_return").alias("r"))
    last = W.tail(daily.where("r is not null"), n, group)
    r = clip(F.col("r"), -0.12, 0.12)
    out = last.groupBy(group).agg(F.expm1(F.sum(F.log1p(r))).alias("compounded"), (F.stddev_samp("r") * F.sqrt(F.lit(244.0))).alias("volatility"), F.count("*").alias("days")).where(F.col("days") >= least)
    return out.withColumn("relative", F.col("compounded") - F.avg("compounded").over(Window.partitionBy(F.lit(0))))


def performance(equity: DataFrame, value: str, by: list[str], date: str = "trade_date") -> DataFrame:
    """Total and yearly return, volatility, Sharpe ratio and worst drawdown of value series."""
    w = Window.partitionBy(*by).orderBy(date)
    rows = equity.withColumn("_r", F.col(value) / F.lag(value).over(w) - 1).withColumn("_dd", W.drawdown(F.col(value), w))
    out = rows.groupBy(*by).agg(
        (F.max_by(value, date) / F.min_by(value, date) - 1).alias("total_return"), F.count("_r").alias("days"),
        (F.stddev_samp("_r") * F.sqrt(F.lit(244.0))).alias("volatility"), F.avg("_r").alias("_mean"), F.min("_dd").alias("max_drawdown"),
    )
    yearly = F.pow(1 + F.col("total_return"), F.lit(244.0) / F.col("days")) - 1
    return out.withColumn("annual_return", yearly).withColumn("sharpe", F.try_divide(F.col("_mean") * 244, F.col("volatility"))).drop("_mean")


def trade_metrics(trades: DataFrame, rate: float, minimum: float, by: list[str] | None = None) -> DataFrame:
    """Order sizes, minimum-commission hits, commission and participation."""
    share = F.col("gross_amount") / F.col("avg_amount")
    return trades.groupBy(*(by or [])).agg(
        F.count("*").alias("orders"), F.avg("gross_amount").alias("mean_order"), F.median("gross_amount").alias("median_order"),
        F.count_if(F.col("gross_amount") * rate < minimum).alias("minimum_hits"), F.avg((F.col("gross_amount") * rate < minimum).cast("double")).alias("minimum_share"),
        F.sum(F.greatest(F.col("gross_amount") * rate, F.lit(minimum))).alias("commission"), F.percentile(share, F.lit(0.95)).alias("participation_p95"), F.max(share).alias("participation_max"),
    )


def robust_rank(runs: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Rank of each run by every metric within its group (nulls last), their mean, and the rank of that."""
    ranks = [F.rank().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(m))) for m in metrics]
    mean = sum(ranks[1:], ranks[0]) / len(metrics)
    return runs.withColumn("mean_rank", mean).withColumn("robust_rank", F.rank().over(Window.partitionBy(by).orderBy("mean_rank")))


def positions(rows: DataFrame) -> DataFrame:
    """Shares by code with the last name and cost; the cash row apart."""
    stock = rows.where("code <> 'CASH'").groupBy("code").agg(F.sum("shares").alias("shares"), F.max_by("name", "line").alias("name"), F.max_by("cost_price", "line").alias("cost_price"))
    cash = rows.where("code = 'CASH'").groupBy("code").agg(F.sum("cost_price").alias("cost_price"))
    return stock.unionByName(cash, allowMissingColumns=True)

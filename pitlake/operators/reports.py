"""Account risk reports, model validation and comparisons of runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import aggregates, risk


def account_weights(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """(code, shares, price, value, weight): at the last price, else at cost; cash is a row of its own."""
    last = prices.groupBy("code").agg(F.max_by("close", "trade_date").alias("close"))
    rows = positions.join(last, "code", "left").withColumn("price", F.coalesce("close", "cost_price"))
    rows = rows.withColumn("value", F.when(F.col("code") == "CASH", F.col("cost_price")).otherwise(F.col("shares") * F.col("price")))
    total = rows.agg(F.sum("value").alias("_total"))
    return rows.crossJoin(F.broadcast(total)).select("code", "shares", "price", "value", (F.col("value") / F.col("_total")).alias("weight"))  # one row


def account_risk(weights: DataFrame, exposures: DataFrame, covariance: DataFrame, specific: DataFrame) -> DataFrame:
    """One row: yearly volatility, one-day normal value at risk, and the weight that the model covers."""
    stock = weights.where("code <> 'CASH'").withColumn("account", F.lit(0))
    total = risk.portfolio_risk(stock.select("account", "code", "weight"), exposures, covariance, specific, ["account"])
    covered = stock.join(specific, "code", "left_semi").agg(F.sum("weight").alias("covered"))
    invested = stock.agg(F.sum("weight").alias("invested"))
    vol = F.sqrt("total_variance")
    day = vol / F.sqrt(F.lit(244.0))
    out = total.crossJoin(covered).crossJoin(invested)  # one row each
    return out.select(vol.alias("volatility"), (1.645 * day).alias("var_95"), (2.326 * day).alias("var_99"), "invested", (F.col("covered") / F.col("invested")).alias("coverage"))


def validate_covariance(covariance: DataFrame) -> DataFrame:
    """(model_date, factors, complete, symmetric, least_eigenvalue) of every date's matrix."""

    def run(pdf):
        wide = pdf.pivot_table(index="factor_1", columns="factor_2", values="covariance", aggfunc="last").sort_index().sort_index(axis=1)
        m = wide.to_numpy()
        complete = list(wide.index) == list(wide.columns) and not np.isnan(m).any()
        least = float(np.linalg.eigvalsh((m + m.T) / 2).min()) if complete else float("nan")
        return pdf.iloc[:1][["model_date"]].assign(factors=len(wide), complete=complete, symmetric=bool(complete and np.allclose(m, m.T)), least_eigenvalue=least)

    return covariance.groupBy("model_date").applyInPandas(run, "model_date date, factors long, complete boolean, symmetric boolean, least_eigenvalue double")


def compare_runs(equity: DataFrame, by: list[str], holdout_from: str) -> DataFrame:
    """Performance of each run over all days and from the holdout day on."""
    whole = aggregates.performance(equity, "equity", by)
    later = aggregates.performance(equity.where(F.col("trade_date") >= F.lit(holdout_from).cast("date")), "equity", by)
    return whole.join(later.select(*by, *[F.col(c).alias(f"holdout_{c}") for c in later.columns if c not in by]), by, "left")


def factor_summary(returns: DataFrame, periods: int = 52) -> DataFrame:
    """Count, mean, deviation, extremes, yearly return and volatility of each factor, and their ratio."""
    r = F.col("factor_return")
    out = returns.groupBy("factor_name").agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.min(r).alias("least"), F.max(r).alias("most"))
    out = out.withColumns({"annual_return": F.col("mean") * periods, "annual_volatility": F.col("sd") * F.sqrt(F.lit(float(periods)))})
    return out.withColumn("return_to_risk", F.try_divide("annual_return", "annual_volatility"))


def group_rollup(holdings: DataFrame, group: str) -> DataFrame:
    """Stocks, value and weight of each group of holdings; a missing group is a group."""
    return holdings.groupBy(group).agg(F.count("code").alias("stock_count"), F.sum("market_value").alias("market_value"), F.sum("weight").alias("portfolio_weight"))


def derived_metrics(summary: DataFrame) -> DataFrame:
    """Fees and traded value over the initial cash, and commission's share of the fees."""
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return summary.withColumns({
        "fees_pct_initial_cash": ratio("total_fees", "initial_cash"), "gross_traded_multiple": ratio("total_gross_traded", "initial_cash"), "commission_pct_total_fees": ratio("commission", "total_fees"),
    })


def run_progress(records: DataFrame, stage: str = "stage", item: str = "item", status: str = "status", at: str = "updated_at") -> DataFrame:
    """(stage, items, complete, running, failed, last_item, last_update): how far each stage of a build is; an item counts by its last record."""
    last = records.groupBy(stage, item).agg(F.max_by(status, at).alias("_status"), F.max(at).alias("_at"))
    share = lambda name: F.count_if(F.col("_status") == name)
    return last.groupBy(stage).agg(F.count("*").alias("items"), share("complete").alias("complete"), share("running").alias("running"), share("error").alias("failed"), F.max(item).alias("last_item"), F.max("_at").alias("last_update"))


def date_diagnostics(rows: DataFrame, date: str, columns: list[str], group: str, code: str = "code") -> DataFrame:
    """One row a date: rows, codes, groups, the share without a group, the share that has each column, and rows that have all."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    unknown = F.col(group).isNull() | (F.col(group) == "UNKNOWN")
    return rows.groupBy(date).agg(
        F.count("*").alias("rows"), F.countDistinct(code).alias("codes"), F.countDistinct(F.when(~unknown, F.col(group))).alias("groups"), F.avg(unknown.cast("double")).alias("unknown_share"),
        *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_coverage") for c in columns], F.count_if(complete).alias("complete_rows"),
    )

"""Weekly features per entity for a risk model, and component scores of a feature snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import windows as W
from pitlake.operators.crosssection import neutral_z, plain_z


def weekly_stock_features(
    panel: DataFrame, weeks: DataFrame, window: int = 252, least: int = 126, half_life: float = 63.0, skip: int = 21, liquidity: tuple[int, ...] = (21, 63, 252), stale: int = 10
) -> DataFrame:
    """Features of each code at each model date, from its last row at most ``stale`` days before.

    ``panel``: code, trade_date, daily_return, market_return, turnover, amount. Exponential weights are
    powers of the count of valid rows, which any frame normalises: so beta and residual volatility are ratios
    of running sums' differences, with neither arrays nor a self-join, and a row costs the same for any window.
    """
    w = W.series("code")
    r, m = F.col("daily_return"), F.col("market_return")
    valid = r.isNotNull() & m.isNotNull()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    known = F.count(F.when(valid, 1))
    kept, used = F.when(r > -1, F.log1p(r)), F.when(F.col("turnover") >= 0, F.col("turnover"))
    rows = panel.withColumn("_w", F.when(valid, F.pow(F.lit(0.5), (known.over(Window.partitionBy("code")) - known.over(running)) / half_life)))
    e = F.col("_w")
    # Running sums once; what any frame holds is the difference of two of them.
    sums = {"w": e, "x": e * m, "y": e * r, "xx": e * m * m, "xy": e * m * r, "yy": e * r * r, "n": F.when(valid, 1.0), "kept": kept, "used": used, "uses": F.when(used.isNotNull(), 1.0), "amount": F.col("amount"), "amounts": F.when(F.col("amount").isNotNull(), 1.0)}
    rows = rows.withColumns({f"_s_{k}": F.sum(F.coalesce(c, F.lit(0.0))).over(running) for k, c in sums.items()} | {"history_days": F.row_number().over(w), "_next": F.lead("trade_date").over(w)})

    def within(k: str, first: int, last: int = 0) -> Column:
        """Sum over the rows from ``first`` to ``last`` rows back."""
        upto = F.col(f"_s_{k}") if last == 0 else F.lag(f"_s_{k}", last).over(w)
        return upto - F.coalesce(F.lag(f"_s_{k}", first + 1).over(w), F.lit(0.0))

    mean = {k: F.try_divide(within(k, window - 1), within("w", window - 1)) for k in ("x", "y", "xx", "xy", "yy")}
    rows = rows.withColumns({f"_m_{k}": c for k, c in mean.items()} | {"_valid": F.round(within("n", window - 1))})
    xx, xy, yy = (F.col(f"_m_{a}{b}") - F.col(f"_m_{a}") * F.col(f"_m_{b}") for a, b in ("xx", "xy", "yy"))
    parts = [F.when(F.round(within("uses", n - 1)) >= max(10, n // 2), F.log(F.greatest(within("used", n - 1) / 100, F.lit(1e-8)))) for n in liquidity]
    there = F.filter("_parts", lambda x: x.isNotNull())
    rows = rows.withColumns({
        "beta_raw": F.when((F.col("_valid") >= least) & (xx > 1e-12), xy / xx), "avg_amount_60": F.try_divide(within("amount", 59), F.round(within("amounts", 59))),
        "momentum_raw": F.when(F.col("history_days") >= window, F.expm1(within("kept", window - 1, skip))), "_parts": F.array(*parts),
    })
    rows = rows.withColumn("liquidity_raw", F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)))
    rows = rows.withColumn("residual_volatility_raw", F.when(F.col("beta_raw").isNotNull(), F.sqrt(F.greatest(yy - 2 * F.col("beta_raw") * xy + F.pow("beta_raw", F.lit(2.0)) * xx, F.lit(0.0)) * 244)))
    # A row serves the model dates from its own to the next row's, within the stale limit: two weeks at most.
    ahead = F.explode(F.sequence(F.lit(0), F.lit(-(-stale // 7))))
    rows = rows.withColumn("_ahead", ahead).withColumn("week", F.date_add(W.week_key(F.col("trade_date")), F.col("_ahead") * 7)).join(F.broadcast(weeks), "week")  # a row a week
    d, model = F.col("trade_date"), F.col("model_date")
    rows = rows.where((d <= model) & (F.col("_next").isNull() | (F.col("_next") > model)) & (F.datediff(model, d) <= stale))
    own = panel.withColumn("week", W.week_key(d)).groupBy("code", "week").agg(F.expm1(F.sum(kept)).alias("weekly_return"))
    out = rows.join(own, ["code", "week"], "left")
    return out.select("code", "model_date", d.alias("observation_date"), "weekly_return", "beta_raw", "residual_volatility_raw", "momentum_raw", "liquidity_raw", "avg_amount_60", "history_days")


# Parts of the composite scores as (column, weight, within groups); a negative weight turns a column around.
COMPONENTS: dict[str, list[tuple[str, float, bool]]] = {
    "quality_score": [
        ("profitability_score", 0.22, True), ("weighted_roe", 0.15, True), ("gross_margin", 0.12, True), ("cashflow_quality_score", 0.16, True),
        ("ocf_to_profit", 0.10, True), ("investment_score", 0.10, True), ("accrual_quality_score", 0.08, True), ("leverage_score", 0.07, True),
    ],
    "growth_score_ranked": [("growth_score", 0.45, True), ("net_profit_yoy", 0.30, True), ("revenue_yoy", 0.25, True)],
    "value_score": [("earnings_yield_proxy", 0.65, True), ("shareholder_yield_score", 0.35, True)],
    "momentum_score": [("mom_252_skip_20", 0.60, False), ("mom_120", 0.25, False), ("mom_60", 0.15, False)],
    "low_volatility_score": [("volatility_120", -1.0, False)],
    "low_beta_score": [("beta_120", -1.0, False)],
    "low_turnover_score": [("turnover_20", -1.0, False)],
    "lower_drawdown_score": [("drawdown_120", 1.0, False)],
    "reversal_score": [("reversal_20", 1.0, False)],
    "medium_reversal_score": [("mom_60", -0.60, False), ("mom_120", -0.40, False)],
    "industry_trend_score": [("industry_relative_20", 0.45, False), ("industry_relative_60", 0.35, False), ("industry_volatility_60", -0.20, False)],
    "defensive_score": [("volatility_120", -0.45, False), ("turnover_20", -0.30, False), ("drawdown_120", 0.25, False)],
}
# The structural second version within groups, and its pure trend.
STRUCTURAL: dict[str, list[tuple[str, float, bool]]] = {
    "low_beta_score": [("beta_120", -1.0, True)], "low_volatility_score": [("volatility_120", -1.0, True)], "low_turnover_score": [("turnover_20", -1.0, True)],
    "lower_drawdown_score": [("drawdown_120", 1.0, True)], "industry_trend_score": [("industry_relative_20", 0.50, False), ("industry_relative_60", 0.50, False)],
}
# The third version's further components, and its trend.
THIRD: dict[str, list[tuple[str, float, bool]]] = {
    **STRUCTURAL, "industry_trend_score": [("industry_relative_20", 0.55, False), ("industry_relative_60", 0.45, False)],
    "earnings_yield_score": [("earnings_yield_raw", 1.0, True)], "quality_score_v31": [("quality_raw", 1.0, True)], "growth_score_v31": [("growth_raw", 1.0, True)],
    "residual_momentum_score": [("residual_momentum_raw", 1.0, True)],
}
# Score profiles over the components.
PROFILES: dict[str, dict[str, float]] = {
    "low_risk_only": {"low_volatility_score": 0.42, "low_turnover_score": 0.28, "lower_drawdown_score": 0.20, "quality_score": 0.10},
    "low_beta_defensive": {"low_beta_score": 0.30, "low_volatility_score": 0.24, "low_turnover_score": 0.20, "reversal_score": 0.16, "lower_drawdown_score": 0.10},
}


def component_scores(features: DataFrame, table: dict[str, list[tuple[str, float, bool]]], date: list[str], group: str) -> DataFrame:
    """One column per component; a part whose column is not there, or not known for a row, counts 0."""

    def part(c: str, weight: float, within: bool) -> Column:
        if c not in features.columns:
            return F.lit(0.0)
        return weight * (neutral_z(F.col(c), date, group) if within else plain_z(F.col(c), date))

    return features.withColumns({name: sum((part(*p) for p in parts), F.lit(0.0)) for name, parts in table.items()})


def weighted_score(components: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """Sum of the components with these weights; missing ones count 0."""
    return components.withColumn(name, sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items() if c in components.columns), F.lit(0.0)))


def tilted(components: DataFrame, score: str, alpha: str, tilt: float, date: list[str], event: str | None = None, event_cap: float = 0.0, name: str = "score_tilted") -> DataFrame:
    """z-scores of score and alpha blended, plus an event score within its cap."""
    out = (1 - tilt) * plain_z(F.col(score), date) + tilt * plain_z(F.col(alpha), date)
    if event:
        out = out + F.greatest(F.lit(-event_cap), F.least(F.lit(event_cap), F.coalesce(F.col(event), F.lit(0.0))))
    return components.withColumn(name, out)


def snapshot(panel: DataFrame) -> DataFrame:
    """Features of each code over its rows: days, amounts, momenta, reversal, volatility, beta, turnover, drawdown.

    ``panel``: code, trade_date, close, daily_return, market_return, amount, turnover. One window pass by code,
    then one aggregate of its last rows.
    """
    w, last = W.series("code"), Window.partitionBy("code").orderBy(F.desc("trade_date"))
    priced = F.col("close").isNotNull()
    rows = panel.withColumn("_back", F.row_number().over(last)).withColumn("_c", F.count(F.when(priced, 1)).over(last.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_peak", F.max(F.when(F.col("_c") <= 120, F.col("close"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda k: F.max(F.when(priced & (F.col("_c") == k + 1), F.col("close")))
    upto = lambda n, c: F.when(F.col("_back") <= n, c)
    r, m = upto(120, F.col("daily_return")), upto(120, F.col("market_return"))
    paired = r.isNotNull() & m.isNotNull()
    return rows.groupBy("code").agg(
        F.count("*").alias("days"), F.max("trade_date").alias("latest_trade_date"), at(0).alias("close"), F.avg(upto(60, F.col("amount"))).alias("avg_amount_60"),
        (at(20) / at(252) - 1).alias("mom_252_skip_20"), (at(0) / at(120) - 1).alias("mom_120"), (at(0) / at(60) - 1).alias("mom_60"), (1 - at(0) / at(20)).alias("reversal_20"),
        (F.stddev_samp(r) * F.sqrt(F.lit(244.0))).alias("volatility_120"), F.avg(upto(20, F.col("turnover"))).alias("turnover_20"),
        F.when(F.count(F.when(paired, 1)) >= 60, F.try_divide(F.covar_samp(F.when(paired, r), F.when(paired, m)), F.var_samp(F.when(paired, m)))).alias("beta_120"),
        F.when(F.count(F.when(priced & (F.col("_c") <= 120), 1)) >= 20, F.min(F.when(priced & (F.col("_c") <= 120), F.col("close") / F.col("_peak") - 1))).alias("drawdown_120"),
    )

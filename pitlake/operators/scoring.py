"""Scores, satellites and learning weights from realised rank ICs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.columns import weighted_available
from pitlake.operators import windows as W
from pitlake.operators.asof import asof_join
from pitlake.operators.crosssection import neutral_z, zscore


def composite(df: DataFrame, weights: dict[str, float], date: list[str], group: str | None, name: str = "score") -> DataFrame:
    """Weighted sum of z-scores, within groups where one is given; weights may be negative."""
    z = {c: neutral_z(F.col(c), date, group) if group else F.coalesce(zscore(F.col(c), date), F.lit(0.0)) for c in weights}
    return df.withColumn(name, sum((z[c] * w for c, w in weights.items()), F.lit(0.0)))


def ranked(df: DataFrame, score: str, date: list[str], code: str = "code") -> DataFrame:
    """Rank 1 for the highest score of a date, ties by code."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*date).orderBy(F.desc_nulls_last(score), code)))


def leadership(groups: DataFrame, date: list[str], relative_20: str, relative_60: str) -> DataFrame:
    """z-scores of the groups' relative returns, their blend, and a strength in [0, 1]."""
    z20, z60 = zscore(F.col(relative_20), date), zscore(F.col(relative_60), date)
    out = groups.withColumn("leadership", weighted_available([(z20, 0.5), (z60, 0.5)]))
    return out.withColumn("strength", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("leadership") / 2)))


def satellites(groups: DataFrame, date: list[str], group: str, relative_20: str, relative_60: str, k: int) -> DataFrame:
    """The k leading groups of each date with both returns above the market's."""
    ok = groups.where((F.col(relative_20) > 0) & (F.col(relative_60) > 0) & (F.col("leadership") > 0))
    w = Window.partitionBy(*date).orderBy(F.desc("leadership"), group)
    return ok.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)


def monthly_frozen(snapshots: DataFrame, date: str, value: str) -> DataFrame:
    """The first snapshot seen in each calendar month, for all of the month's dates."""
    w = Window.partitionBy(F.trunc(date, "MM")).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return snapshots.withColumn(value, F.first(value).over(w))


def matured_ic_weights(ics: DataFrame, decisions: DataFrame, static: dict[str, float], window: int = 78, least: int = 16, blend: float = 0.70, cap: float = 0.35, floor: float = 0.02) -> DataFrame:
    """(decision_date, component, weight) from rank ICs (entry_date, exit_date, component, ic) that ended by the decision.

    Strength is mean IC times the share of positive ones over their deviation; the learned weights are
    blended with the static ones, capped and normalised again. Too few matured ICs: the static weights.
    """
    last = Window.partitionBy("component").orderBy("exit_date", "entry_date").rowsBetween(-(window - 1), 0)
    stats = F.struct(F.avg("ic").over(last).alias("m"), F.avg((F.col("ic") > 0).cast("double")).over(last).alias("up"), F.stddev_samp("ic").over(last).alias("sd"), F.count("*").over(last).alias("n"))
    run = ics.select("component", "exit_date", "entry_date", stats.alias("_v")).groupBy("component", "exit_date").agg(F.max_by("_v", "entry_date").alias("_v")).select("component", "exit_date", "_v.*")
    fixed = F.create_map(*[F.lit(x) for kv in static.items() for x in kv])
    grid = decisions.select("decision_date").distinct().select("decision_date", F.explode(fixed).alias("component", "static"))
    found = asof_join(grid, run, ["component"], "decision_date", "exit_date", ["n", "m", "up", "sd"])
    strength = F.greatest(F.lit(0.0), F.col("m")) * F.col("up") / F.greatest(F.coalesce("sd", F.lit(floor)), F.lit(floor))
    out = found.withColumn("_s", F.when(F.col("n") >= least, strength))
    w = Window.partitionBy("decision_date")
    total = F.sum("_s").over(w)
    mixed = F.when(total > 0, (1 - blend) * F.col("static") + blend * F.coalesce("_s", F.lit(0.0)) / total).otherwise(F.col("static"))
    capped = F.least(mixed, F.lit(cap))
    return out.withColumn("_w", capped).withColumn("weight", F.col("_w") / F.sum("_w").over(w)).select("decision_date", "component", "weight")


def component_ics(panel: DataFrame, components: list[str], label: str, date: str, least: int = 40) -> DataFrame:
    """(date, component, ic, names): rank IC of every component per date, in one pass over long rows."""
    rows = panel.select(date, label, F.explode(F.map_from_arrays(F.array(*map(F.lit, components)), F.array(*components))).alias("component", "x"))
    # Cross-sections are dealt by their number: by bytes, which compress well, a task would get many of them.
    pairs = rows.where(F.col("x").isNotNull() & F.col(label).isNotNull()).repartition(256, date, "component")
    r = W.with_average_rank(W.with_average_rank(pairs, "x", [date, "component"], "_x"), label, [date, "component"], "_y")
    # Ranks that do not vary give NaN, as corr does in SQL; Spark's own would divide by zero.
    ic = F.coalesce(F.try_divide(F.covar_pop("_x", "_y"), F.sqrt(F.var_pop("_x") * F.var_pop("_y"))), F.lit(float("nan")))
    return r.groupBy(date, "component").agg(ic.alias("ic"), F.count("*").alias("names")).where(F.col("names") >= least)


def equity_target(state: DataFrame, base: float, target_volatility: float, least: float, band: float = 0.05, breadth_band: float = 0.2, tilt: float = 0.3, soft_crash: float = -0.06, hard_crash: float = -0.12, soft_cap: float = 0.5, off_cap: float = 0.7, hard_cap: float = 0.2) -> DataFrame:
    """Market part of a continuous risk budget: trend of gaps and breadth, scaled to a volatility, with caps in falls."""
    part = lambda c, b: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c / b))
    trend = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.35 * part(F.col("short_gap"), band) + 0.45 * part(F.col("long_gap"), band) + 0.20 * part(F.col("breadth") - 0.5, breadth_band)))
    scale = F.greatest(F.lit(0.5), F.least(F.lit(1.2), F.lit(target_volatility) / F.greatest(F.col("volatility"), F.lit(1e-6))))
    raw = F.greatest(F.lit(least), F.least(F.lit(base), base * scale * (1 + tilt * trend)))
    capped = F.when(trend < 0, F.when(F.col("return_20") <= soft_crash, F.least(raw, F.lit(soft_cap))).otherwise(F.least(raw, F.lit(off_cap)))).otherwise(raw)
    crash = (F.col("return_20") <= hard_crash) & (F.col("breadth") <= 0.3)
    return state.withColumn("trend", trend).withColumn("equity_target", F.when(crash, F.least(capped, F.lit(hard_cap))).otherwise(capped))


def risk_on_strength(return_20, gap, full: float = 0.05):
    """0 in a falling market, 1 where both return and gap reach ``full``."""
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / full))
    return F.least(part(return_20), part(gap))


def equity_throttle(target: Column, floor: float, ceiling: float) -> Column:
    """How far a target equity lies between the least and the most equity, 0 to 1; where these are the same, whether it is reached."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(target, F.lit(floor))))
    floor = min(max(floor, 0.0), 1.0)
    ceiling = min(max(ceiling, floor), 1.0)
    if ceiling <= floor + 1e-12:
        return F.when(bounded >= ceiling, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (bounded - floor) / (ceiling - floor)))


def fast_rebound(return_5: Column, return_10: Column, return_20: Column, up_breadth_5: Column, least_5: float, least_10: float, most_20: float, least_breadth: float) -> Column:
    """1 where a market that has fallen over twenty days rises over five and ten on a broad front, else 0; 0 where a measure is missing."""
    active = (return_5 >= least_5) & (return_10 >= least_10) & (return_20 <= most_20) & (up_breadth_5 >= least_breadth)
    finite = [~F.isnan(c) for c in (return_5, return_10, return_20, up_breadth_5)]
    return F.when(F.coalesce(active & finite[0] & finite[1] & finite[2] & finite[3], F.lit(False)), 1.0).otherwise(0.0)


def score_slopes(panel: DataFrame, score: str, label: str, date: str, least: int = 40, tail: float = 0.01, part: float = 0.20) -> DataFrame:
    """(date, names, slope, spread): what a unit of the score earned, and the top part of the names over the bottom part.

    Labels are cut to their ``tail`` quantiles of the date. Parts are by percentile ranks with ties at their mean. No slope where the score does not vary.
    """
    rows = panel.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")) & ~F.isnan(F.col(label).cast("double"))).select(date, F.col(score).alias("_s"), F.col(label).cast("double").alias("_y"))
    w = Window.partitionBy(date)
    edges = F.percentile("_y", F.array(F.lit(tail), F.lit(1 - tail))).over(w)
    ranked = W.with_average_rank(rows.withColumn("_e", edges).withColumn("_n", F.count("*").over(w)), "_s", [date], "_r")
    y = F.greatest(F.col("_e")[0], F.least(F.col("_e")[1], F.col("_y")))
    rank = F.col("_r") / F.col("_n")
    out = ranked.withColumn("_y", y).groupBy(date).agg(
        F.count("*").alias("names"), F.when(F.var_pop("_s") * F.count("*") > 1e-12, F.covar_pop("_s", "_y") / F.var_pop("_s")).alias("slope"),
        (F.avg(F.when(rank >= 1 - part, F.col("_y"))) - F.avg(F.when(rank <= part, F.col("_y")))).alias("spread"),
    )
    return out.where(F.col("names") >= least)


def blend_satellite(scored: DataFrame, satellite: DataFrame, date: str, group: str, base: str, tilt: str, cap: float, risk_on) -> DataFrame:
    """Core and satellite z-scores blended by cap x strength x risk-on; groups without a satellite keep the core."""
    s = satellite.select(date, group, F.col("strength").alias("_strength"))
    out = scored.join(s, [date, group], "left")  # at most k groups a date
    w = cap * F.coalesce("_strength", F.lit(0.0)) * risk_on
    core, side = F.coalesce(zscore(F.col(base), [date]), F.lit(0.0)), F.coalesce(zscore(F.col(tilt), [date]), F.lit(0.0))
    return out.withColumn("satellite_weight", w).withColumn("score", (1 - w) * core + w * side).drop("_strength")


def keep_or_replace(candidates: DataFrame, date: str, expected: str, cost: float, count: int, policy: str = "cost_aware") -> DataFrame:
    """Held names and new ones by expected return; a new name enters for a held one only past the round-trip cost.

    ``policy``: none (rank alone), always (held names stay), cost_aware (held names get the cost as a bonus).
    """
    bonus = {"none": F.lit(0.0), "always": F.lit(1e9), "cost_aware": F.lit(cost)}[policy]
    value = F.col(expected) + F.when(F.coalesce("held", F.lit(False)), bonus).otherwise(F.lit(0.0))
    w = Window.partitionBy(date).orderBy(F.desc_nulls_last(value), "code")
    return candidates.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= count).drop("_k")


def expected_return(decisions: DataFrame, slopes: DataFrame, window: int = 52, least: int = 16, cap: float = 0.03, fallback: float = 0.005) -> DataFrame:
    """(decision_date, expected, observations, source): mean realised slope of the last ``window`` weeks that ended by the decision,
    shrunk by the share of positive ones; the fallback with too few.

    ``slopes``: exit_date (distinct), slope. One row a week, carried to the decisions by an as-of join.
    """
    w = Window.partitionBy("_k").orderBy("exit_date").rowsBetween(-(window - 1), 0)
    s = F.col("slope")
    bounded = F.when(s.isNotNull(), F.greatest(F.lit(-cap), F.least(F.lit(cap), s)))
    run = slopes.withColumn("_k", F.lit(0)).select("_k", "exit_date", F.count(s).over(w).alias("n"), F.avg(bounded).over(w).alias("mean"), F.avg((s > 0).cast("double")).over(w).alias("up"))
    out = asof_join(decisions.select("decision_date").distinct().withColumn("_k", F.lit(0)), run, ["_k"], "decision_date", "exit_date", ["n", "mean", "up"])
    enough = F.coalesce(F.col("n"), F.lit(0)) >= least
    estimate = F.least(F.greatest(F.lit(0.0), F.col("mean")) * F.col("up"), F.lit(cap))
    return out.select(
        "decision_date", F.when(enough, estimate).otherwise(fallback).alias("expected"), F.coalesce("n", F.lit(0)).cast("long").alias("observations"),
        F.when(enough, "causal_realized_labels").otherwise("fallback_warmup").alias("source"),
    )


# Weights of factor returns in the two baskets of the monthly state.
DEFENSIVE = {"BETA": -0.40, "RESIDUAL_VOLATILITY": -0.40, "LIQUIDITY": -0.20}
OFFENSIVE = {"EARNINGS_YIELD": 0.35, "GROWTH": 0.35, "MOMENTUM": 0.30}


def monthly_factor_state(returns: DataFrame, lookback: int = 52, least: int = 26, blend: float = 0.7, base: float = 0.5, tilt: float = 0.2, low: float = 0.3, high: float = 0.7, step: float = 0.05) -> DataFrame:
    """(month, offensive_weight, factor_signal, industry_signal, combined, observations) for every month from the first to the one after the last.

    ``returns``: model_date, factor_name, factor_return, with industries as ``INDUSTRY:name``. A month uses
    weeks strictly before it. Signals are windows over weeks; only the bounded step from month to month is a
    fold, over one array with an element a month.
    """
    names = [r["factor_name"] for r in returns.where(~F.col("factor_name").startswith("INDUSTRY:")).select("factor_name").distinct().collect()]  # some dozens of factors

    def basket(weights: dict[str, float]):
        known = {k: v for k, v in weights.items() if k in names}
        total = sum(abs(v) for v in known.values())
        one = lambda k: F.coalesce(F.max(F.when(F.col("factor_name") == k, F.col("factor_return"))), F.lit(0.0))
        return sum((one(k) * v for k, v in known.items()), F.lit(0.0)) / total if total else F.lit(None).cast("double")

    weeks = returns.groupBy("model_date").agg((basket(OFFENSIVE) - basket(DEFENSIVE)).alias("d"))
    order = Window.partitionBy(F.lit(0)).orderBy("model_date")  # a row a week
    last = order.rowsBetween(-(lookback - 1), 0)
    n, sd = F.count("*").over(last), F.stddev_samp("d").over(last)
    scale = F.avg("d").over(last) / sd * F.sqrt(F.count("d").over(last))
    weeks = weeks.select("model_date", F.row_number().over(order).alias("p"), n.alias("observations"), F.when(sd > 1e-8, F.tanh(scale)).otherwise(0.0).alias("factor_signal"))
    industry = returns.where(F.col("factor_name").startswith("INDUSTRY:"))
    grid = weeks.select("model_date", "p").crossJoin(F.broadcast(industry.select("factor_name").distinct()))  # weeks x industries, some thousands
    grid = grid.join(industry, ["model_date", "factor_name"], "left")
    own = Window.partitionBy("factor_name").orderBy("p")
    up = lambda k: (F.coalesce(F.sum("factor_return").over(own.rowsBetween(-(k - 1), 0)), F.lit(0.0)) > 0).cast("double")
    breadth = grid.select("p", up(4).alias("s"), up(12).alias("m")).groupBy("p").agg((0.5 * F.avg("s") + 0.5 * F.avg("m")).alias("breadth"))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("breadth") - 0.5) * 2))
    weeks = weeks.join(breadth, "p", "left").withColumn("industry_signal", F.coalesce(bounded, F.lit(0.0)))
    span = returns.agg(F.trunc(F.min("model_date"), "MM").alias("a"), F.add_months(F.trunc(F.max("model_date"), "MM"), 1).alias("b"))
    months = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).withColumn("_k", F.lit(0))
    known = asof_join(months, weeks.withColumn("_k", F.lit(0)), ["_k"], "month", "model_date", ["observations", "factor_signal", "industry_signal"], strict=True)
    enough = F.coalesce(F.col("observations"), F.lit(0)) >= least
    part = lambda c: F.when(enough, F.col(c)).otherwise(0.0)
    known = known.select("month", F.coalesce("observations", F.lit(0)).cast("long").alias("observations"), part("factor_signal").alias("factor_signal"), part("industry_signal").alias("industry_signal"))
    known = known.withColumn("combined", blend * F.col("factor_signal") + (1 - blend) * F.col("industry_signal"))
    wanted = F.least(F.lit(high), F.greatest(F.lit(low), base + tilt * F.col("combined")))
    rows = known.agg(F.array_sort(F.collect_list(F.struct("month", wanted.alias("wanted"), "factor_signal", "industry_signal", "combined", "observations"))).alias("rows"))
    start = F.struct(F.lit(base).cast("double").alias("at"), F.lit([]).cast("array<double>").alias("path"))

    def bounded_step(s, x):
        now = F.greatest(s["at"] - step, F.least(s["at"] + step, x["wanted"]))
        return F.struct(now.alias("at"), F.concat(s["path"], F.array(now)).alias("path"))

    path = rows.select("rows", F.aggregate("rows", start, bounded_step, lambda s: s["path"]).alias("path"))
    flat = path.select(F.explode(F.arrays_zip("rows", "path")).alias("z"))
    return flat.select("z.rows.month", F.col("z.path").alias("offensive_weight"), "z.rows.factor_signal", "z.rows.industry_signal", "z.rows.combined", "z.rows.observations")


def forces_alignment(current, target, band: float, mode: str):
    """Strict alignment acts on any distance beyond the band."""
    return F.abs(current - target) > band if mode == "strict" else F.lit(False)


def unscheduled_rebalance(current, target, band: float, schedule: str):
    """Daily schedules sell down what lies above the band."""
    return current > target + band if schedule == "daily" else F.lit(False)

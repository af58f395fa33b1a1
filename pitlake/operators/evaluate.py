"""Factor evaluation: rank ICs, partial slopes, gates, ablation, reversal retest and quantile profiles."""

from __future__ import annotations

import functools
import operator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import windows as W
from pitlake.operators.crosssection import quantile_bucket

LEAST_NAMES = 80


def bonferroni_bar(tests: int, alpha: float = 0.05) -> float:
    """Two-sided |t| that the best of so many tests must pass."""
    return NormalDist().inv_cdf(1 - alpha / (2 * tests))


def rank_ic(panel: DataFrame, factor: str, label: str = "forward_return", date: str = "date", least: int = LEAST_NAMES) -> DataFrame:
    """(date, names, ic): correlation of average ranks of pairs, where there are enough names and both vary."""
    pairs = panel.where(F.col(factor).isNotNull() & F.col(label).isNotNull()).select(date, factor, label)
    ranked = W.with_average_rank(W.with_average_rank(pairs, factor, [date], "_x"), label, [date], "_y")
    out = ranked.groupBy(date).agg(F.count("*").alias("names"), F.corr("_x", "_y").alias("ic"), F.max("_x").alias("_a"), F.min("_x").alias("_b"), F.max("_y").alias("_c"), F.min("_y").alias("_d"))
    return out.where((F.col("names") >= least) & (F.col("_a") > F.col("_b")) & (F.col("_c") > F.col("_d"))).select(date, "names", "ic")


def ic_summary(ic: DataFrame, date: str = "date", lags: int = 4) -> DataFrame:
    """One row: weeks, mean, median, deviation, positive rate, mean names and HAC t."""
    one = ic.withColumn("_all", F.lit(0))
    t = W.hac_t(one, "ic", ["_all"], date, lags).select("_all", F.col("t").alias("hac_t"))
    agg = one.groupBy("_all").agg(
        F.count("*").alias("weeks"), F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"), F.stddev_samp("ic").alias("sd_ic"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"), F.avg("names").alias("mean_names"),
    )
    return agg.join(t, "_all").drop("_all")


def residual_on(panel: DataFrame, factor: str, on: str, date: str = "date", name: str = "residual") -> DataFrame:
    """Residual of the factor on one control per date; where the control is constant, the factor less its mean."""
    w = Window.partitionBy(date)
    ok = F.col(factor).isNotNull() & F.col(on).isNotNull()
    x, y = F.when(ok, F.col(on)), F.when(ok, F.col(factor))
    slope = F.coalesce(F.try_divide(F.covar_samp(x, y).over(w), F.var_samp(x).over(w)), F.lit(0.0))
    return panel.withColumn(name, y - F.avg(y).over(w) - slope * (x - F.avg(x).over(w)))


def _layer_sums(factor: str, controls: list[str], label: str, kinds: dict[str, str]):
    """A struct of a date's complete rows: their number, extremes of factor and controls, and covariances of all with the label last."""
    columns = [factor, *controls, label]
    ok = functools.reduce(operator.and_, [F.col(c).isNotNull() & ~F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNotNull() for c in columns])
    v = [F.when(ok, F.col(c).cast("double")) for c in columns]
    covariances = F.array(*[F.covar_pop(x, y) for i, x in enumerate(v) for y in v[i:]])
    return F.struct(F.count_if(ok).alias("n"), F.array(*[(F.max(x) > F.min(x)) for x in v]).alias("varies"), covariances.alias("c"))


def _slope(n: int, varies: list[bool], c: list[float], least: int) -> float | None:
    """The label's slope on the standardised factor beside the varying controls; None where they have no full rank."""
    k = len(varies)
    if n is None or n < least or not varies[0]:
        return None
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = c
    full += np.triu(full, 1).T
    used = [i for i in range(k - 1) if varies[i]]
    sd = np.sqrt(np.diag(full)[used])
    if (sd <= 0).any():
        return None
    r = full[np.ix_(used, used)] / np.outer(sd, sd)
    if np.linalg.eigvalsh(r)[0] < 1e-12:
        return None
    return float(np.linalg.solve(r, full[used, -1] / sd)[0])


def layer_slopes(panel: DataFrame, factor: str, layers: dict[str, list[str]], label: str = "forward_return", date: str = "date", least: int = LEAST_NAMES) -> DataFrame:
    """(date, layer, slope): per date, regressions of the label on the standardised factor and each layer's controls, from one aggregation.

    A cross-section is summed up before it leaves its tasks; a solve sees covariances of a date, not its rows. Constant
    controls are left out; dates with fewer than ``least`` complete rows, a constant factor or controls of no full rank have no row.
    """
    kinds = dict(panel.dtypes)
    names = list(layers)
    sums = panel.groupBy(date).agg(*[_layer_sums(factor, list(layers[k]), label, kinds).alias(f"_{i}") for i, k in enumerate(names)])

    def run(batches):
        for pdf in batches:
            rows = [(d, k, s) for i, k in enumerate(names) for d, x in zip(pdf[date], pdf[f"_{i}"], strict=True) if (s := _slope(x["n"], x["varies"], x["c"], least)) is not None]
            yield pd.DataFrame(rows, columns=[date, "layer", "slope"])

    return sums.mapInPandas(run, f"{date} {kinds[date]}, layer string, slope double")


def partial_slopes(panel: DataFrame, factor: str, controls: list[str], label: str = "forward_return", date: str = "date", least: int = LEAST_NAMES) -> DataFrame:
    """(date, slope) of one layer."""
    return layer_slopes(panel, factor, {"all": controls}, label, date, least).drop("layer")


def partial_t(panel: DataFrame, factor: str, controls: list[str], label: str = "forward_return", date: str = "date", lags: int = 4, least: int = LEAST_NAMES) -> DataFrame:
    """(weeks, mean_slope, t) of the slopes."""
    return ablation_ladder(panel, factor, [("all", controls)], label=label, date=date, lags=lags, least=least).select("weeks", "mean_slope", "t")


def ablation_ladder(panel: DataFrame, factor: str, layers: list[tuple[str, list[str]]], label: str = "forward_return", date: str = "date", lags: int = 4, least: int = LEAST_NAMES) -> DataFrame:
    """(layer, controls, weeks, mean_slope, t): for each layer the factor's t with all controls up to it; one pass over the panel."""
    upto, controls = {}, []
    for name, more in layers:
        controls = [*controls, *more]
        upto[name] = controls
    t = W.hac_t(layer_slopes(panel, factor, upto, label, date, least), "slope", ["layer"], date, lags)
    count = F.create_map(*[x for k, c in upto.items() for x in (F.lit(k), F.lit(len(c)))])
    return t.select(F.col("n").alias("weeks"), F.col("mean").alias("mean_slope"), "t", "layer", count[F.col("layer")].alias("controls"))


def groupability(panel: DataFrame, factor: str, date: str = "date", least_distinct: int = 5, most_tied: float = 0.5) -> DataFrame:
    """One row: share of dates on which the factor has enough values and no value dominates."""
    values = panel.where(F.col(factor).isNotNull()).groupBy(date, factor).agg(F.count("*").alias("n"))
    per_date = values.groupBy(date).agg(F.count("*").alias("distinct"), (F.max("n") / F.sum("n")).alias("tied"))
    ok = (F.col("distinct") >= least_distinct) & (F.col("tied") <= most_tied)
    return per_date.agg(F.count("*").alias("dates"), F.avg(ok.cast("double")).alias("usable_share"), F.avg("tied").alias("mean_tied"), F.avg("distinct").alias("mean_distinct"))


def control_audit(panel: DataFrame, controls: list[str], era: str = "era") -> DataFrame:
    """(era, control, distinct, sd, constant): controls that do not vary in an era."""
    aggs = [a for c in controls for a in (F.countDistinct(c).alias(f"{c}_n"), F.stddev_samp(c).alias(f"{c}_sd"))]
    wide = panel.groupBy(era).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("control"), F.col(f"{c}_n").alias("distinct"), F.col(f"{c}_sd").alias("sd")) for c in controls])
    return wide.select(era, F.inline(rows)).withColumn("constant", (F.col("distinct") <= 1) | (F.coalesce("sd", F.lit(0.0)) < 1e-12))


def collinear_controls(panel: DataFrame, controls: list[str], bar: float = 0.98, least: int = 50) -> DataFrame:
    """(a, b, rho): pairs of controls whose ranks nearly coincide over the panel."""
    ranked = W.with_global_average_ranks(panel.select(*controls), {c: f"_{c}" for c in controls})
    pairs = [(a, b) for i, a in enumerate(controls) for b in controls[i + 1 :]]
    wide = ranked.agg(*[x for a, b in pairs for x in (F.corr(f"_{a}", f"_{b}").alias(f"{a}|{b}"), F.count(F.col(f"_{a}") + F.col(f"_{b}")).alias(f"{a}|{b}|n"))])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho"), F.col(f"`{a}|{b}|n`").alias("n")) for a, b in pairs])
    return wide.select(F.inline(rows)).where((F.abs("rho") >= bar) & (F.col("n") >= least))


def reversal_retest(panel: DataFrame, factor: str, past: str, styles: list[str], tests: int, era: str = "era", date: str = "date", least: int = LEAST_NAMES) -> DataFrame:
    """One row: does the factor hold on the test era with the sign of the train era, beyond past return and styles?"""
    bar = bonferroni_bar(tests)
    both = residual_on(panel, factor, past, date, "residual")
    train = ic_summary(rank_ic(both.where(F.col(era) == "train"), "residual", date=date, least=least), date).select(F.col("mean_ic").alias("train_ic"), F.col("hac_t").alias("train_t"))
    test = ic_summary(rank_ic(both.where(F.col(era) == "test"), "residual", date=date, least=least), date).select(F.col("mean_ic").alias("test_ic"), F.col("hac_t").alias("test_t"))
    style = partial_t(both.where(F.col(era) == "test"), "residual", styles, date=date, least=least).select(F.col("t").alias("style_t"))
    row = train.crossJoin(test).crossJoin(style)  # one row each
    sign = F.signum("train_ic")
    row = row.withColumns({"test_t": sign * F.col("test_t"), "style_t": sign * F.col("style_t")})
    passed = (F.abs("train_t") >= bar) & (F.col("test_t") >= bar / 2)
    return row.withColumn("bar", F.lit(bar)).withColumn("pass_screen", passed).withColumn("survived", passed & (F.col("style_t") >= 3.0))


def quantile_profile(panel: DataFrame, factor: str, n: int = 5, label: str = "forward_return", date: str = "date", least: int = 100) -> DataFrame:
    """(bucket, dates, mean_return, excess): mean over dates of each bucket's mean label, and over the pool's."""
    rows = panel.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(date))).where(F.col("_n") >= least)
    bucketed = quantile_bucket(rows, factor, [date], n)
    pool = rows.groupBy(date).agg(F.avg(label).alias("_pool"))
    daily = bucketed.groupBy(date, "bucket").agg(F.avg(label).alias("_r")).join(pool, date)
    return daily.groupBy("bucket").agg(F.count("*").alias("dates"), F.avg("_r").alias("mean_return"), F.avg(F.col("_r") - F.col("_pool")).alias("excess"))


def decoupling(panel: DataFrame, factor: str, n: int = 5, label: str = "forward_return", date: str = "date", least: int = 100) -> DataFrame:
    """One row: what the top and bottom buckets earn beside the whole pool, how far bucket means rise in order, and whether the
    factor only tells what to avoid: the top beats the pool by less than a quarter of what the bottom lacks.
    """
    profile = quantile_profile(panel, factor, n, label, date, least)
    rows = panel.where(F.col(factor).isNotNull() & F.col(label).isNotNull()).groupBy(date).agg(F.count("*").alias("_n"), F.avg(label).alias("_pool")).where(F.col("_n") >= least)
    pool = rows.agg(F.count("*").alias("weeks"), F.avg("_pool").alias("pool_mean"))
    ranked = W.with_average_rank(W.with_average_rank(profile.withColumn("_all", F.lit(0)), "bucket", ["_all"], "_x"), "mean_return", ["_all"], "_y")  # a row a bucket
    ends = ranked.agg(F.max_by("mean_return", "bucket").alias("top_mean"), F.min_by("mean_return", "bucket").alias("bottom_mean"), F.corr("_x", "_y").alias("monotonicity"))
    top, bottom = F.col("top_mean") - F.col("pool_mean"), F.col("pool_mean") - F.col("bottom_mean")
    out = pool.crossJoin(ends).where("weeks > 0")  # one row each
    return out.select("weeks", "pool_mean", "top_mean", "bottom_mean", top.alias("top_minus_pool"), bottom.alias("pool_minus_bottom"), (F.col("top_mean") - F.col("bottom_mean")).alias("top_minus_bottom"), "monotonicity", (top < 0.25 * bottom).alias("avoidance_only"))


def subperiod_decay(panel: DataFrame, factor: str, layers: list[tuple[str, list[str]]], periods: dict[str, tuple[str, str]], date: str = "date", **kw) -> DataFrame:
    """The ablation ladder on each named period: what holds overall may fade from one to the next."""
    out = None
    for name, (start, end) in periods.items():
        own = panel.where(F.col(date).between(F.lit(start), F.lit(end)))
        rows = ablation_ladder(own, factor, layers, date=date, **kw).withColumn("period", F.lit(name)).where("weeks > 0")
        out = rows if out is None else out.unionByName(rows)
    return out

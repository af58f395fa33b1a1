"""Factor returns and their covariance from aggregates: cross-sections and histories are never gathered in one group.

A date's regression on a constant, styles and group dummies whose capitalisation-weighted returns sum to zero is one on
styles within groups: what a group adds (the market's return and its own) follows from its means. So a round needs
weighted sums and products of styles per date and group, and a solve as large as the number of styles. Medians of the
residuals, for the Huber weights, are aggregates as well; coefficients go back to the rows by a join.

Covariances of all dates come from running sums of products whose weights double every half-life: those of a window are
the difference of two running sums, so a date is read once and not copied to each date whose window holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators.asof import asof_join
from pitlake.operators.staging import staged

MARKET = "MARKET"


@dataclass(frozen=True)
class RegressionSpec:
    """styles; huber: residuals beyond so many robust deviations lose weight; rounds: fits."""

    styles: tuple[str, ...]
    huber: float = 2.5
    rounds: int = 2


def _sums(rows: DataFrame, styles: tuple[str, ...], weight: Column) -> DataFrame:
    """Per date and group: names, capitalisation, and weighted sums and products of the label and the styles."""
    v = [F.col("forward_return"), *map(F.col, styles)]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    return rows.groupBy("model_date", "industry_group").agg(
        F.count("*").alias("n"), F.sum("cap").alias("cap"), F.sum(weight).alias("w"),
        F.array(*[F.sum(weight * x) for x in v]).alias("x"), F.array(*[F.sum(weight * v[i] * v[j]) for i, j in pairs]).alias("xx"),
    )


def _solve(styles: tuple[str, ...]):
    """One date's sums, a row a group, to its coefficients: a row a group with what the group adds and the slopes."""
    k = len(styles) + 1
    upper = np.triu_indices(k)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("industry_group")
        if pdf["n"].sum() < k + len(pdf) + 2:
            return pd.DataFrame(columns=["model_date", "industry_group", "market", "own", "slopes"], dtype=object)
        w, x = pdf["w"].to_numpy(float), np.stack(pdf["x"].to_numpy())
        within = np.zeros((k, k))
        for own_w, own_x, own_xx in zip(w, x, pdf["xx"], strict=True):
            full = np.zeros((k, k))
            full[upper] = own_xx
            within += full + np.triu(full, 1).T - np.outer(own_x, own_x) / own_w
        # Scaled to unit diagonals, so that a style without variance within groups is seen as such.
        size = np.sqrt(np.maximum(np.diag(within)[1:], 0.0))
        size[size == 0] = 1.0
        slopes = np.linalg.lstsq(within[1:, 1:] / np.outer(size, size), within[1:, 0] / size, rcond=1e-12)[0] / size
        own = (x[:, 0] - x[:, 1:] @ slopes) / w
        market = np.average(own, weights=pdf["cap"].to_numpy(float))
        return pd.DataFrame({"model_date": pdf["model_date"], "industry_group": pdf["industry_group"], "market": market, "own": own - market, "slopes": [slopes] * len(pdf)})

    return run


def _fit(rows: DataFrame, spec: RegressionSpec, weight: Column) -> DataFrame:
    sums = _sums(rows, spec.styles, weight)
    return staged(sums.groupBy("model_date").applyInPandas(_solve(spec.styles), "model_date date, industry_group string, market double, own double, slopes array<double>"))


def _with_residuals(rows: DataFrame, fit: DataFrame, styles: tuple[str, ...]) -> DataFrame:
    fitted = F.col("market") + F.col("own")
    for i, s in enumerate(styles):
        fitted = fitted + F.col("slopes")[i] * F.col(s)
    return rows.join(fit, ["model_date", "industry_group"]).withColumn("residual", F.col("forward_return") - fitted)


def _robust_scale(residuals: DataFrame) -> DataFrame:
    """(model_date, middle, scale) of the residuals: median and 1.4826 times the median distance from it."""
    middle = staged(residuals.groupBy("model_date").agg(F.median("residual").alias("middle")))
    away = residuals.join(middle, "model_date").groupBy("model_date", "middle").agg((1.4826 * F.median(F.abs(F.col("residual") - F.col("middle")))).alias("scale"))
    return staged(away)


def factor_returns(exposures: DataFrame, spec: RegressionSpec) -> DataFrame:
    """(model_date, kind, name, value, r2): returns of the factors and of what they leave of each code.

    ``exposures`` has model_date, code, industry_group, cap, forward_return and the styles. Rows without a return, a
    capitalisation or a style take no part; a missing group is UNKNOWN; dates with too few rows for their factors give nothing.
    Weights are root capitalisations up to their 99 % quantile, times Huber weights from the second round on.
    """
    styles = spec.styles
    rows = exposures.select("model_date", F.col("code").cast("string").alias("code"), F.coalesce(F.col("industry_group").cast("string"), F.lit("UNKNOWN")).alias("industry_group"), F.col("cap").cast("double").alias("cap"), F.col("forward_return").cast("double").alias("forward_return"), *[F.col(s).cast("double").alias(s) for s in styles])
    rows = rows.dropna(subset=["model_date", "cap", "forward_return", *styles])
    root = F.sqrt(F.greatest("cap", F.lit(1.0)))
    rows = staged(rows.withColumn("w", F.least(root, F.percentile(root, F.lit(0.99)).over(Window.partitionBy("model_date")))))
    fit, now, weight = None, rows, F.col("w")
    for _ in range(max(spec.rounds, 1)):
        fit = _fit(now, spec, weight)
        residuals = _with_residuals(rows, fit, styles)
        far = F.abs(F.col("residual") - F.col("middle")) / F.col("scale") / spec.huber
        # Where the residuals do not spread, the weights of the round before stay, and so does the fit.
        weight = F.when(F.col("scale") > 1e-12, F.col("w") / F.greatest(far, F.lit(1.0))).otherwise(F.col("w"))
        now = residuals.join(_robust_scale(residuals), "model_date").drop("market", "own", "slopes")
    y = F.col("forward_return")
    total = F.sum(weight * y * y) - F.pow(F.sum(weight * y), 2) / F.sum(weight)
    r2 = staged(now.groupBy("model_date").agg(F.when(total > 1e-16, 1 - F.sum(weight * F.col("residual") * F.col("residual")) / total).alias("r2")))
    named = [F.struct(F.lit(MARKET).alias("name"), F.col("market").alias("value")), *[F.struct(F.lit(s).alias("name"), F.col("slopes")[i].alias("value")) for i, s in enumerate(styles)]]
    shared = fit.groupBy("model_date").agg(F.first("market").alias("market"), F.first("slopes").alias("slopes")).select("model_date", F.inline(F.array(*named)))
    factors = shared.union(fit.select("model_date", "industry_group", "own")).select("model_date", F.lit("factor").alias("kind"), "name", "value")
    specific = _with_residuals(rows, fit, styles).select("model_date", F.lit("specific").alias("kind"), "code", "residual")
    return factors.union(specific).join(r2, "model_date")


def nearest_psd(m: np.ndarray) -> np.ndarray:
    """The matrix with eigenvalues of 1e-10 at least, or of so small a part of the largest."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    floor = max(1e-10, values.max() * 1e-10)
    if values.min() >= floor:
        return (m + m.T) / 2
    out = (vectors * np.maximum(values, floor)) @ vectors.T
    return (out + out.T) / 2


def floored(covariance: DataFrame) -> DataFrame:
    """Each date's matrix with its eigenvalues floored; those that need no floor stay as they are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="factor_1", columns="factor_2", values="covariance").sort_index().sort_index(axis=1)
        names = list(wide.columns)
        m = nearest_psd(wide.to_numpy())
        return pd.DataFrame({"model_date": pdf["model_date"].iloc[0], "factor_1": np.repeat(names, len(names)), "factor_2": np.tile(names, len(names)), "covariance": m.ravel()})

    return covariance.groupBy("model_date").applyInPandas(run, "model_date date, factor_1 string, factor_2 string, covariance double")


def raw_covariances(returns: DataFrame, window: int, least: int, half_life: float, lags: int, shrink: float = 0.10, periods: int = 52) -> DataFrame:
    """(model_date, factor_1, factor_2, covariance) of every date with factor returns, from its last ``window`` dates.

    Exponential weights that halve every ``half_life`` dates, Bartlett-weighted lags, shrunk towards the diagonal, yearly. A
    factor without a return on a date counts as 0 there; one without any in the window is left out.
    """
    values = returns.where("kind = 'factor'").groupBy("model_date", "name").agg(F.last("value").alias("value"))
    per_date = values.groupBy("model_date").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("of"))
    names = values.agg(F.array_sort(F.collect_set("name")).alias("names"))
    # A row a date with the returns of all factors: dates are few, factors dozens.
    wide = per_date.crossJoin(F.broadcast(names)).withColumn("n", F.row_number().over(Window.orderBy("model_date")))  # one row of names
    slot = F.transform("names", lambda x: F.struct(x.alias("name"), F.coalesce(F.element_at("of", x), F.lit(0.0)).alias("x"), F.element_at("of", x).isNotNull().cast("int").alias("there")))
    pairs = F.flatten(F.transform(slot, lambda a: F.transform(F.filter(slot, lambda b: b["name"] >= a["name"]), lambda b: F.struct(a["name"].alias("factor_1"), b["name"].alias("factor_2"), a["x"].alias("a"), b["x"].alias("b"), a["there"].alias("a_there"), b["there"].alias("b_there")))))
    rows = wide.repartition("model_date").select("model_date", "n", F.inline(pairs)).withColumn("w", F.pow(F.lit(2.0), F.col("n") / max(half_life, 1.0)))

    own = Window.partitionBy("factor_1", "factor_2").orderBy("n")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    w, a, b = F.col("w"), F.col("a"), F.col("b")
    terms: dict[str, tuple[Column, int]] = {"w": (w, 0), "a": (w * a, 0), "b": (w * b, 0), "ab": (w * a * b, 0), "an": (F.col("a_there"), 0), "bn": (F.col("b_there"), 0)}
    for lag in range(1, lags + 1):
        a0, b0 = F.lag("a", lag).over(own), F.lag("b", lag).over(own)
        there = F.when(a0.isNotNull(), w)
        terms |= {f"w{lag}": (there, lag), f"a{lag}": (there * a, lag), f"b{lag}": (there * b, lag), f"p{lag}": (w * a0, lag), f"q{lag}": (w * b0, lag), f"aq{lag}": (w * a * b0, lag), f"bp{lag}": (w * b * a0, lag)}
    rows = rows.withColumns({f"_{k}": x for k, (x, _) in terms.items()})
    rows = rows.withColumns({f"_{k}": F.sum(f"_{k}").over(upto) for k in terms})
    # The window's first ``lag`` dates have no partner in it.
    s = {k: F.coalesce(F.col(f"_{k}"), F.lit(0.0)) - F.coalesce(F.lag(f"_{k}", window - lag).over(own), F.lit(0.0)) for k, (_, lag) in terms.items() if lag < window}
    rows = rows.select("model_date", "n", "factor_1", "factor_2", *[x.alias(f"_{k}") for k, x in s.items()])
    c = {k: F.col(f"_{k}") for k in s}
    ma, mb = c["a"] / c["w"], c["b"] / c["w"]
    covariance = c["ab"] / c["w"] - ma * mb
    for lag in range(1, min(lags, window - 1) + 1):
        g = lambda k, x, y, first, second, t=lag: c[f"{k}{t}"] - second * c[f"{x}{t}"] - first * c[f"{y}{t}"] + first * second * c[f"w{t}"]
        both = g("aq", "a", "q", ma, mb) + g("bp", "b", "p", mb, ma)
        kernel = 1 - F.lit(float(lag)) / (F.least(F.lit(min(lags, window - 1)), F.col("n") - 1) + 1)
        covariance = covariance + F.when(F.col("n") > lag, kernel * both / c[f"w{lag}"]).otherwise(0.0)
    same = F.col("factor_1") == F.col("factor_2")
    scaled = covariance * F.when(same, 1.0).otherwise(1 - shrink) * periods
    upper = rows.where((F.least("n", F.lit(window)) >= least) & (c["an"] > 0) & (c["bn"] > 0)).select("model_date", "factor_1", "factor_2", scaled.alias("covariance"))
    return upper.union(upper.where("factor_1 <> factor_2").select("model_date", "factor_2", "factor_1", "covariance"))


def factor_covariance(returns: DataFrame, dates: DataFrame, window: int, least: int, half_life: float, lags: int, shrink: float = 0.10, periods: int = 52) -> DataFrame:
    """(model_date, factor_1, factor_2, covariance) for ``dates``: that of the last date with factor returns at or before each, eigenvalues floored."""
    every = staged(raw_covariances(returns, window, least, half_life, lags, shrink, periods))
    known = every.select(F.lit(0).alias("_k"), F.col("model_date").alias("_d"), F.col("model_date").alias("_from")).distinct()
    used = asof_join(dates.select(F.lit(0).alias("_k"), "model_date").distinct(), known, ["_k"], "model_date", "_d", ["_from"]).select(F.col("model_date").alias("as_of"), F.col("_from").alias("model_date"))
    return floored(every.join(used, "model_date").select(F.col("as_of").alias("model_date"), "factor_1", "factor_2", "covariance"))

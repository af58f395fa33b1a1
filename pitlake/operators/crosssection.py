"""Cross-sectional transforms per date, as window aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.columns import clip
from pitlake.operators.staging import staged


def winsorise_mad(df: DataFrame, value: str, by: list[str], k: float = 3.0, name: str | None = None) -> DataFrame:
    """Clip to median +- k * 1.4826 * MAD per group; where MAD is about 0, to the 1 % and 99 % quantiles.

    Windows over the group rather than joins: one shuffle, shared by all columns treated by the same group.
    """
    return _winsorised(df, {value: name or value}, by, k)


def _winsorised(df: DataFrame, names: dict[str, str], by: list[str], k: float) -> DataFrame:
    """``winsorise_mad`` of all values at once, under their ``names``: two passes over a group, however many values."""
    w = Window.partitionBy(*by)
    points = F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))
    out = df.withColumns({f"_q_{v}": F.percentile(F.col(v), points).over(w) for v in names})
    out = out.withColumns({f"_mad_{v}": F.median(F.abs(F.col(v) - F.col(f"_q_{v}")[1])).over(w) for v in names})

    def clipped(v: str) -> Column:
        q, mad = F.col(f"_q_{v}"), F.col(f"_mad_{v}")
        wide = k * 1.4826 * mad
        low, high = F.when(mad > 1e-12, q[1] - wide).otherwise(q[0]), F.when(mad > 1e-12, q[1] + wide).otherwise(q[2])
        return F.when(F.col(v).isNotNull(), F.greatest(low, F.least(high, F.col(v))))

    return out.withColumns({name: clipped(v) for v, name in names.items()}).drop(*[f"{x}_{v}" for v in names for x in ("_q", "_mad")])


def robust_z(df: DataFrame, value: str, by: list[str], name: str, least: int = 20, bound: float = 5.0) -> DataFrame:
    """(x - median) / (1.4826 MAD), by mean and deviation where MAD is about 0; null below ``least`` values; clipped."""
    w, v = Window.partitionBy(*by), F.col(value)
    out = df.withColumn("_mid", F.median(v).over(w)).withColumn("_mad", F.median(F.abs(v - F.col("_mid"))).over(w))
    sd = F.stddev_samp(v).over(w)
    z = F.when(F.col("_mad") > 1e-12, (v - F.col("_mid")) / (1.4826 * F.col("_mad"))).when(sd > 1e-12, (v - F.avg(v).over(w)) / sd)
    return out.withColumn(name, F.when(F.count(v).over(w) >= least, clip(z, -bound, bound))).drop("_mid", "_mad")


def _with_stats(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of its group's row in ``stats``, a row a group; a missing key is a group as well."""
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_same{i}"))
    out = df.join(F.broadcast(stats.withColumnsRenamed({c: f"_same{i}" for i, c in enumerate(by)})), same, "left")
    return out.drop(*[f"_same{i}" for i in range(len(by))])


def group_percentiles(df: DataFrame, values: dict[str, str], by: list[str], points: list[float], near: float = 0.005) -> DataFrame:
    """(by, an array under the name of each value): what ``percentile`` gives at ``points`` in increasing order, for groups that are few and large.

    No task holds a group or its distinct values: sketches tell between which values a point lies, those between are counted by value, and all others
    only as lying before, between or behind. Ranks are running counts, so results are exact; where one is not between its edges, these are moved apart
    (``near`` is their distance in shares of the rows). ``df`` is read several times.
    """
    keys, m = [f"_k{i}" for i in range(len(by))], len(points)
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("_of"), F.col(v).cast("double").alias("_x")) for i, v in enumerate(values)]))
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], each).where(F.col("_x").isNotNull())
    keys = [*keys, "_of"]
    while True:
        edges = rows.groupBy(*keys).agg(F.count("_x").alias("_all"), F.percentile_approx("_x", [min(max(p + d, 0.0), 1.0) for d in (-near, near) for p in points], 1000).alias("_e"))
        few = F.col("_all") * near < 50
        low = F.array(*[F.when(few | F.lit(p - near <= 0), F.lit(float("-inf"))).otherwise(F.col("_e")[i]) for i, p in enumerate(points)])
        high = F.array(*[F.when(few | F.lit(p + near >= 1), F.lit(float("nan"))).otherwise(F.col("_e")[m + i]) for i, p in enumerate(points)])  # nothing is greater than NaN
        told = _with_stats(rows, edges.select(*keys, low.alias("_low"), high.alias("_high")), keys)
        passed = sum(((F.col("_x") > F.col("_high")[i]).cast("int") for i in range(m)), F.lit(0))
        counts = told.withColumn("_part", passed).groupBy(*keys, "_part", F.when(F.col("_x") >= F.get("_low", F.col("_part")), F.col("_x")).alias("_x")).agg(F.count("*").alias("_n"))
        group = Window.partitionBy(*keys)
        ranks = counts.withColumns({"_to": F.sum("_n").over(group.orderBy("_part", F.asc_nulls_first("_x"))), "_last": F.sum("_n").over(group) - 1})

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("_to") - F.col("_n") <= rank) & (rank < F.col("_to")), F.col("_x")))

        found = ranks.groupBy(*keys, "_last").agg(*[at(f(p * F.col("_last"))).alias(f"{s}{i}") for i, p in enumerate(points) for s, f in (("_a", F.floor), ("_b", F.ceil))])
        found = staged(found)
        missed = F.lit(False)
        for i in range(m):
            missed = missed | F.col(f"_a{i}").isNull() | F.col(f"_b{i}").isNull()
        if near >= 1 or found.where(missed).isEmpty():
            break
        near *= 8

    def between(i: int, p: float) -> Column:
        a, b, position = F.col(f"_a{i}"), F.col(f"_b{i}"), p * F.col("_last")
        return F.when(a == b, a).otherwise((F.ceil(position) - position) * a + (position - F.floor(position)) * b)

    out = found.select(*keys, F.array(*[between(i, p) for i, p in enumerate(points)]).alias("_p")).groupBy(*keys[:-1])
    out = out.agg(*[F.first(F.when(F.col("_of") == i, F.col("_p")), ignorenulls=True).alias(name) for i, name in enumerate(values.values())])
    return out.withColumnsRenamed(dict(zip(keys, by, strict=False)))


def wide_robust_z(df: DataFrame, names: dict[str, str], by: list[str], least: int = 20, bound: float = 5.0) -> DataFrame:
    """``robust_z`` of all values at once, under their ``names``, for groups that are few and large: what it needs of a group comes by aggregation and a join. ``df`` is read several times."""
    sums = df.groupBy(*by).agg(*[f(v).alias(f"{s}_{v}") for v in names for s, f in (("_n", F.count), ("_avg", F.avg), ("_sd", F.stddev_samp))])
    mids = group_percentiles(df, {v: f"_mid_{v}" for v in names}, by, [0.5])
    away = _with_stats(df, mids, by).select(*by, *[F.abs(F.col(v) - F.col(f"_mid_{v}")[0]).alias(v) for v in names])
    stats = _with_stats(_with_stats(sums, mids, by), group_percentiles(away, {v: f"_mad_{v}" for v in names}, by, [0.5]), by)

    def known(v: str, by_mad: Column, by_sd: Column) -> Column:
        return F.when(F.col(f"_n_{v}") >= least, F.when(F.col(f"_mad_{v}")[0] > 1e-12, by_mad).when(F.col(f"_sd_{v}") > 1e-12, by_sd))

    # Of a group, so that little is left to do for a row.
    centres = [known(v, F.col(f"_mid_{v}")[0], F.col(f"_avg_{v}")).alias(f"_centre_{v}") for v in names]
    scales = [known(v, 1.4826 * F.col(f"_mad_{v}")[0], F.col(f"_sd_{v}")).alias(f"_scale_{v}") for v in names]
    out = _with_stats(df, stats.select(*by, *centres, *scales), by)
    out = out.withColumns({name: (F.col(v) - F.col(f"_centre_{v}")) / F.col(f"_scale_{v}") for v, name in names.items()})
    out = out.withColumns({name: clip(F.col(name), -bound, bound) for name in names.values()})
    return out.drop(*[f"{s}_{v}" for v in names for s in ("_centre", "_scale")])


def zscore(value: Column, by: list[str]) -> Column:
    """Missing stays missing; where values do not vary, all are 0."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(value).over(w)
    return F.when(sd > 1e-12, (value - F.avg(value).over(w)) / sd).when(F.coalesce(sd, F.lit(0.0)) <= 1e-12, F.lit(0.0))


def plain_z(value: Column, by: list[str], bound: float = 3.0) -> Column:
    """Clipped z-score, 0 where missing."""
    return F.coalesce(clip(zscore(value, by), -bound, bound), F.lit(0.0))


def neutral_z(value: Column, date: list[str], group: str, least: int = 5, bound: float = 3.0) -> Column:
    """z-score within the group, within the date where the group has too few values; missing is 0."""
    w = Window.partitionBy(*date, group)
    own = F.when(F.count(value).over(w) >= least, zscore(value, [*date, group]))
    return F.coalesce(clip(F.coalesce(own, zscore(value, date)), -bound, bound), F.lit(0.0))


def fill_median(value: Column, date: list[str], group: str) -> Column:
    """Missing values take the group's median at the date, else the date's."""
    return F.coalesce(value, F.median(value).over(Window.partitionBy(*date, group)), F.median(value).over(Window.partitionBy(*date)))


def weighted_standardise(value: Column, weight: Column, by: list[str]) -> Column:
    """Zero weighted mean and unit weighted variance; 0 where the variance is about 0."""
    w = Window.partitionBy(*by)
    own = F.when(value.isNotNull(), weight)
    mean = F.sum(own * value).over(w) / F.sum(own).over(w)
    second = F.sum(own * value * value).over(w) / F.sum(own).over(w)
    var = second - mean * mean
    return F.when(value.isNotNull(), F.when(var > 1e-12, (value - mean) / F.sqrt(var)).otherwise(0.0))


def weighted_residual(value: Column, on: Column, weight: Column, by: list[str]) -> Column:
    """Residual of a weighted regression on one variable and a constant, in closed form."""
    w = Window.partitionBy(*by)
    ok = value.isNotNull() & on.isNotNull() & weight.isNotNull()
    m = F.when(ok, weight)
    total = F.sum(m).over(w)
    mx, my = F.sum(m * on).over(w) / total, F.sum(m * value).over(w) / total
    sxx = F.sum(m * on * on).over(w) / total - mx * mx
    sxy = F.sum(m * on * value).over(w) / total - mx * my
    slope = F.when(sxx > 1e-12, sxy / sxx).otherwise(0.0)
    return F.when(ok & (F.count(m).over(w) >= 3), value - my - slope * (on - mx))


def quantile_bucket(df: DataFrame, value: str, by: list[str], n: int, name: str = "bucket") -> DataFrame:
    """Right-closed buckets between distinct interpolated quantiles, from 0 up."""
    steps = F.array(*[F.lit(i / n) for i in range(n + 1)])
    out = df.withColumn("_edges", F.array_distinct(F.percentile(value, steps).over(Window.partitionBy(*by))))
    return out.withColumn(name, F.greatest(F.lit(0), F.size(F.filter("_edges", lambda e: e < F.col(value))) - 1)).drop("_edges")


def cap_share(cap: Column, by: list[str], group: str) -> Column:
    """The group's share of the date's total."""
    return F.sum(cap).over(Window.partitionBy(*by, group)) / F.sum(cap).over(Window.partitionBy(*by))


def weighted_views(rows: DataFrame, value: str, y: str, cap: str, by: list[str], group: str) -> DataFrame:
    """``rows`` with standard (``weighted_standardise`` of value), residual (``weighted_residual`` of y on value) and share (``cap_share``), from sums per date and group.

    For dates that are few and large: the sums come from partial aggregates and go back to the rows by a join, so that no task holds a date.
    """
    v, z, w = F.col(value), F.col(y), F.col(cap)
    own, m = F.when(v.isNotNull(), w), F.when(v.isNotNull() & z.isNotNull() & w.isNotNull(), w)
    sums = {"_w": F.sum(own), "_wv": F.sum(own * v), "_wvv": F.sum(own * v * v), "_m": F.sum(m), "_mv": F.sum(m * v), "_mz": F.sum(m * z), "_mvv": F.sum(m * v * v), "_mvz": F.sum(m * v * z), "_n": F.count(m), "_cap": F.sum(w)}
    own_sums = rows.groupBy(*by, group).agg(*[x.alias(k) for k, x in sums.items()])
    date = Window.partitionBy(*by)
    total = own_sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, group])], F.col("_cap").alias("_own"), *[F.sum(k).over(date).alias(k) for k in sums])
    same = F.lit(True)
    for i, c in enumerate([*by, group]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(F.broadcast(total), same)  # a row a date and group
    mean = F.col("_wv") / F.col("_w")
    var = F.col("_wvv") / F.col("_w") - mean * mean
    mx, my = F.col("_mv") / F.col("_m"), F.col("_mz") / F.col("_m")
    sxx, sxy = F.col("_mvv") / F.col("_m") - mx * mx, F.col("_mvz") / F.col("_m") - mx * my
    slope = F.when(sxx > 1e-12, sxy / sxx).otherwise(0.0)
    return out.select(
        *rows.columns, F.when(v.isNotNull(), F.when(var > 1e-12, (v - mean) / F.sqrt(var)).otherwise(0.0)).alias("standard"),
        F.when(m.isNotNull() & (F.col("_n") >= 3), z - my - slope * (v - mx)).alias("residual"), (F.col("_own") / F.col("_cap")).alias("share"),
    )


def root_cap_weight(df: DataFrame, cap: str, by: list[str], name: str = "weight") -> DataFrame:
    """Square root of capitalisation, at most its 99 % quantile at the date."""
    top = F.percentile(F.sqrt(cap), F.lit(0.99)).over(Window.partitionBy(*by))
    return df.withColumn(name, F.least(F.sqrt(cap), top))


def style_exposures(df: DataFrame, cap: str, styles: list[str], date: list[str], group: str, width: float = 5.0) -> DataFrame:
    """Styles winsorised at ``width`` MADs, filled by group and date medians (else 0), standardised by root-capitalisation weights."""
    out = root_cap_weight(df, cap, date, "_weight")
    out = _winsorised(out, {s: s for s in styles}, date, width)
    out = out.withColumns({s: F.coalesce(fill_median(F.col(s), date, group), F.lit(0.0)) for s in styles})
    out = out.withColumns({s: weighted_standardise(F.col(s), F.col("_weight"), date) for s in styles})
    return out.drop("_weight")


def wide_style_exposures(df: DataFrame, cap: str, styles: list[str], date: list[str], group: str, width: float = 5.0) -> DataFrame:
    """``style_exposures`` for dates that are few and large: what it needs of a date comes by aggregation and a join. ``df`` is read several times."""
    rows = df.withColumn("_root", F.sqrt(cap))
    q = group_percentiles(rows, {"_root": "_q_root"} | {s: f"_q_{s}" for s in styles}, date, [0.01, 0.5, 0.99])
    out = _with_stats(rows, q, date)
    mads = group_percentiles(out.select(*date, *[F.abs(F.col(s) - F.col(f"_q_{s}")[1]).alias(s) for s in styles]), {s: f"_mad_{s}" for s in styles}, date, [0.5])

    # Of a date, so that little is left to do for a row.
    def bound(s: str, sign: int, at: int) -> Column:
        return F.when(F.col(f"_mad_{s}")[0] > 1e-12, F.col(f"_q_{s}")[1] + sign * width * 1.4826 * F.col(f"_mad_{s}")[0]).otherwise(F.col(f"_q_{s}")[at])

    bounds = [bound(s, sign, at).alias(f"{name}_{s}") for s in styles for name, sign, at in (("_low", -1, 0), ("_high", 1, 2))]
    out = _with_stats(rows, _with_stats(q, mads, date).select(*date, F.col("_q_root")[2].alias("_top"), *bounds), date).withColumn("_weight", F.least("_root", "_top"))
    out = out.withColumns({s: F.when(F.col(s).isNotNull(), F.greatest(f"_low_{s}", F.least(f"_high_{s}", F.col(s)))) for s in styles}).select(*df.columns, "_weight")
    lacking = out.where(F.greatest(*[F.col(s).isNull() for s in styles], F.lit(False)))
    if not lacking.isEmpty():
        names = {s: f"_fill_{s}" for s in styles}
        some = _with_stats(out, lacking.select(*date).distinct().withColumn("_some", F.lit(True)), date).where("_some")
        own, whole = group_percentiles(some, names, [*date, group], [0.5]), group_percentiles(some, {s: f"_date_{s}" for s in styles}, date, [0.5])
        out = _with_stats(_with_stats(out, own, [*date, group]), whole, date)
        out = out.withColumns({s: F.coalesce(F.col(s), F.col(f"_fill_{s}")[0], F.col(f"_date_{s}")[0], F.lit(0.0)) for s in styles}).select(*df.columns, "_weight")
    w = F.col("_weight")
    sums = out.groupBy(*date).agg(F.sum("_weight").alias("_w"), *[x.alias(f"{k}_{s}") for s in styles for k, x in (("_wv", F.sum(w * F.col(s))), ("_wvv", F.sum(w * F.col(s) * F.col(s))))])
    mean = {s: F.col(f"_wv_{s}") / F.col("_w") for s in styles}
    var = {s: F.col(f"_wvv_{s}") / F.col("_w") - mean[s] * mean[s] for s in styles}
    stats = sums.select(*date, *[mean[s].alias(f"_mean_{s}") for s in styles], *[F.when(var[s] > 1e-12, F.sqrt(var[s])).alias(f"_sd_{s}") for s in styles])
    out = _with_stats(out, stats, date)
    return out.withColumns({s: F.coalesce((F.col(s) - F.col(f"_mean_{s}")) / F.col(f"_sd_{s}"), F.lit(0.0)) for s in styles}).select(*df.columns)


def residual_styles(df: DataFrame, cap: str, date: list[str], size: str = "SIZE", beta: str = "BETA", volatility: str = "RESIDUAL_VOLATILITY", liquidity: str = "LIQUIDITY") -> DataFrame:
    """Adds NONLINEAR_SIZE, what is left of the cube of size; takes size and beta out of volatility and size out of liquidity; all standardised again."""
    out, w = root_cap_weight(df, cap, date, "_weight"), F.col("_weight")
    out = out.withColumns({
        "NONLINEAR_SIZE": weighted_residual(F.pow(size, F.lit(3.0)), F.col(size), w, date), liquidity: weighted_residual(F.col(liquidity), F.col(size), w, date),
        "_v": weighted_residual(F.col(volatility), F.col(size), w, date), "_b": weighted_residual(F.col(beta), F.col(size), w, date),
    })
    out = out.withColumn(volatility, weighted_residual(F.col("_v"), F.col("_b"), w, date))  # by residuals of residuals
    for s in ("NONLINEAR_SIZE", volatility, liquidity):
        out = out.withColumn(s, weighted_standardise(F.col(s), w, date))
    return out.drop("_weight", "_v", "_b")

"""Time-series operators per entity, as window expressions and frames with minimum counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pitlake.functions.columns import clip


def series(*by: str, order: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def rolling(agg, c: Column, w: WindowSpec, n: int, least: int) -> Column:
    """``agg`` over the last n rows where at least ``least`` of them are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) >= least, agg(c).over(frame))


def rolling_deviation(df: DataFrame, value: str, w: WindowSpec, n: int, least: int, name: str) -> DataFrame:
    """Column ``name``: sample deviation of the last n rows' values, where at least ``least`` of them are there.

    A row looks at short pieces and combines their counts, means and squares, so it costs about the root of n and not n; nothing is subtracted
    from longer sums, so rows outside the window leave no trace.
    """
    piece = max(d for d in range(1, math.isqrt(2 * n) + 1) if n % d == 0)
    near, c = w.rowsBetween(-(piece - 1), 0), F.col(value)
    out = df.withColumns({"_n": F.count(c).over(near), "_m": F.avg(c).over(near), "_v": F.var_pop(c).over(near)})
    ages = range(0, n, piece)
    back = lambda k, age: F.col(k) if age == 0 else F.lag(k, age).over(w)
    out = out.withColumns({f"{k}{age}": back(k, age) for age in ages for k in ("_n", "_m", "_v")})
    part = lambda x: F.coalesce(x, F.lit(0.0))
    out = out.withColumns({"_all": sum((F.coalesce(f"_n{age}", F.lit(0)) for age in ages), F.lit(0)), "_base": F.coalesce(*[F.col(f"_m{age}") for age in ages])})
    out = out.withColumn("_mean", F.col("_base") + sum((part(F.col(f"_n{age}") * (F.col(f"_m{age}") - F.col("_base"))) for age in ages), F.lit(0.0)) / F.greatest("_all", F.lit(1)))
    squares = sum((part(F.col(f"_n{age}") * (F.col(f"_v{age}") + F.pow(F.col(f"_m{age}") - F.col("_mean"), F.lit(2.0)))) for age in ages), F.lit(0.0))
    deviation = F.when((F.col("_all") >= max(least, 2)), F.sqrt(squares / F.greatest(F.col("_all") - 1, F.lit(1))))
    return out.withColumn(name, deviation).drop("_n", "_m", "_v", "_all", "_base", "_mean", *[f"{k}{age}" for age in ages for k in ("_n", "_m", "_v")])


def row_return(c: Column, w: WindowSpec, k: int) -> Column:
    return c / F.lag(c, k).over(w) - 1


def cumulative_index(r: Column, w: WindowSpec) -> Column:
    return F.exp(F.sum(F.log1p(r)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def drawdown(c: Column, w: WindowSpec) -> Column:
    return c / F.max(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def last_drawdown(panel: DataFrame, value: str, n: int, least: int, name: str, by: str = "code", order: str = "trade_date") -> DataFrame:
    """(by, name): worst fall from the peak within each entity's last n values: those rows alone, a running maximum and a minimum."""
    rows = tail(panel, n, by, order, not_null=value).withColumn("_fall", drawdown(F.col(value), series(by, order=order)))
    return rows.groupBy(by).agg(F.count("*").alias("_n"), F.min("_fall").alias(name)).where(F.col("_n") >= least).drop("_n")


def rolling_beta(r: Column, market: Column, w: WindowSpec, n: int, least: int) -> Column:
    """Slope on the market over paired rows alone."""
    frame = w.rowsBetween(-(n - 1), 0)
    paired = F.when(r.isNotNull(), market)
    return F.when(F.count(r + market).over(frame) >= least, F.try_divide(F.covar_samp(r, market).over(frame), F.var_samp(paired).over(frame)))


def ewma_weights(n: int, half_life: float) -> list[float]:
    raw = [0.5 ** (age / max(half_life, 1.0)) for age in range(n - 1, -1, -1)]
    return [x / sum(raw) for x in raw]


def ewma_beta(panel: DataFrame, r: str, market: str, n: int, half_life: float, least: int, by: str = "code", order: str = "trade_date") -> DataFrame:
    """(by, beta, n): weighted slope over each entity's last n valid rows; ages count valid rows."""
    last = Window.partitionBy(by).orderBy(F.desc(order))
    rows = panel.where(F.col(r).isNotNull() & F.col(market).isNotNull()).withColumn("_age", F.row_number().over(last) - 1).where(F.col("_age") < n)
    rows = rows.withColumn("_w", F.pow(F.lit(0.5), F.col("_age") / max(half_life, 1.0)))
    x, y, w = F.col(market), F.col(r), F.col("_w")
    means = rows.groupBy(by).agg((F.sum(w * x) / F.sum(w)).alias("_mx"), (F.sum(w * y) / F.sum(w)).alias("_my"), F.count("*").alias("n"))
    centred = rows.join(means, by)
    dx, dy = F.col(market) - F.col("_mx"), F.col(r) - F.col("_my")
    out = centred.groupBy(by).agg(F.try_divide(F.sum(w * dx * dy), F.sum(w * dx * dx)).alias("beta"), F.first("n").alias("n"))
    return out.where(F.col("n") >= least)


def tail(panel: DataFrame, n: int, by: str = "code", order: str = "trade_date", not_null: str | None = None) -> DataFrame:
    """The last n rows of each entity (over rows where a column is there)."""
    rows = panel.where(F.col(not_null).isNotNull()) if not_null else panel
    return rows.withColumn("_back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_back") <= n).drop("_back")


def week_key(d: Column) -> Column:
    """The Saturday that a Saturday-to-Friday week begins with."""
    return F.date_sub(F.trunc(F.date_add(d, 2), "week"), 2)


def week_ends(days: DataFrame, order: str = "trade_date") -> DataFrame:
    """The last trading day of every Saturday-to-Friday week."""
    return days.groupBy(week_key(F.col(order)).alias("week")).agg(F.max(order).alias("model_date"))


def rebalance_flags(days: DataFrame, every: int, order: str = "trade_date") -> DataFrame:
    """Distinct days with flags: every n-th, last of an ISO week, last of a month; the last day always counts."""
    # A calendar has one row a day: a few thousand rows whatever the panel's size.
    w = Window.orderBy(order)
    d, nxt = F.col(order), F.lead(order).over(w)
    iso = lambda c: F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), c), F.weekofyear(c))
    calendar = days.select(order).distinct()
    return calendar.select(
        order,
        ((F.row_number().over(w) - 1) % every == 0).alias("every_n"),
        F.coalesce(iso(d) != iso(nxt), F.lit(True)).alias("week_end"),
        F.coalesce(F.trunc(d, "MM") != F.trunc(nxt, "MM"), F.lit(True)).alias("month_end"),
    )


def residual_momentum(weekly: DataFrame, lookback: int, skip: int, least: int, value: str = "specific_return") -> DataFrame:
    """Compounded residual return of week positions [p - lookback, p - skip), with its source window."""
    position = weekly.select("model_date").distinct().withColumn("p", F.row_number().over(Window.orderBy("model_date")))
    rows = weekly.join(F.broadcast(position), "model_date")  # one row for each week
    frame = Window.partitionBy("code").orderBy("p").rangeBetween(-lookback, -(skip + 1))
    r = F.log1p(clip(F.col(value), -0.95, 10.0))
    out = rows.select(
        "model_date", "code", F.expm1(F.sum(r).over(frame)).alias("momentum"), F.count(r).over(frame).alias("observations"),
        F.min("model_date").over(frame).alias("source_start"), F.max("model_date").over(frame).alias("source_end"),
    )
    return out.where(F.col("observations") >= least)


def with_average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Column ``name``: rank within ``by`` with ties at their mean; rows without a value have none."""
    has = F.col(value).isNotNull()
    low = F.rank().over(Window.partitionBy(*by, has).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, has, value))
    return df.withColumn(name, F.when(has, low + (ties - 1) / 2.0))


def hac_t(df: DataFrame, value: str, by: list[str], order: str, lags: int) -> DataFrame:
    """(by, n, mean, t): Newey-West t of the mean of each series, with Bartlett weights."""
    rows = df.where(F.col(value).isNotNull())
    rows = rows.withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumns({f"_l{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    n = F.count("*")
    gamma = F.sum(F.col("_c") * F.col("_c")) / n
    for k in range(1, lags + 1):
        gamma = gamma + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)) / n
    out = rows.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), gamma.alias("_v"))
    return out.select(*by, "n", "mean", F.when((F.col("n") >= 4) & (F.col("_v") > 0), F.col("mean") / F.sqrt(F.col("_v") / F.col("n"))).alias("t"))


def with_global_average_ranks(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns named by ``names`` (value -> name): rank over the whole table with ties at their mean, without one task for all of it.

    Counts of distinct values are dealt by 64 ranges between approximate quantiles; ranks are running counts
    within a range plus the sums of the ranges before it, so they are exact wherever the edges lie.
    """
    out = df
    for value, name in names.items():  # each from the rows given, not from those that have the ranks before it
        out = out.join(_value_ranks(df, value, name), F.col(value) == F.col("_ranked_value"), "left").drop("_ranked_value")
    return out


def _value_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_ranked_value")).agg(F.count("*").alias("_n"))
    edges = counts.select(F.percentile_approx("_ranked_value", F.array(*[F.lit(i / 64) for i in range(1, 64)])).alias("_edges"))
    cut = counts.crossJoin(F.broadcast(edges)).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col("_ranked_value")))).drop("_edges")  # one row
    before = cut.groupBy("_part").agg(F.sum("_n").alias("_all")).withColumn("_base", F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).drop("_all")  # 64 rows
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy("_ranked_value"))
    return cut.join(F.broadcast(before), "_part").select("_ranked_value", (F.col("_base") + upto - (F.col("_n") - 1) / 2.0).alias(name))

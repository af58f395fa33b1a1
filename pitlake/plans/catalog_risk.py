"""Queries of the risk model, its portfolios and the evaluation ladder, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlake.operators import crosssection, evaluate, factors, portfolio, reports, risk, risk_aware, scoring
from pitlake.operators.staging import staged
from pitlake.plans import views
from pitlake.plans.catalog import STYLES, WEEKLY_X, _weekly_cross_section, _weekly_dates, query, rounded
from pitlake.plans.catalog_accounts import _ACCOUNT, _account
from pitlake.plans.catalog_more import EXPOSURES, _std
from pitlake.plans.views import CROSS, MARKET, PANEL, cross_section, panel, table

# Factor returns and covariances


def _filled_styles() -> str:
    """Styles winsorised, filled and standardised, from ``xs``."""
    wins = lambda k: f"CASE WHEN {k}_mad > 1e-12 THEN greatest({k}_mid - 5 * 1.4826 * {k}_mad, least({k}_mid + 5 * 1.4826 * {k}_mad, {k})) WHEN {k} IS NOT NULL THEN greatest({k}_q1, least({k}_q99, {k})) END"
    return f"""{WEEKLY_X},
y1 AS (SELECT *, least(sqrt(cap), quantile_cont(sqrt(cap), 0.99) OVER d) AS wt, {', '.join(f'median({k}) OVER d AS {k}_mid, quantile_cont({k}, 0.01) OVER d AS {k}_q1, quantile_cont({k}, 0.99) OVER d AS {k}_q99' for k in STYLES)} FROM xs WINDOW d AS (PARTITION BY model_date) QUALIFY count(momentum) OVER d >= 20 AND count(volatility) OVER d >= 20),
y2 AS (SELECT *, {', '.join(f'median(abs({k} - {k}_mid)) OVER (PARTITION BY model_date) AS {k}_mad' for k in STYLES)} FROM y1),
y3 AS (SELECT model_date, code, industry_group, cap, wt, forward_return, {', '.join(f'CASE WHEN {k} IS NOT NULL THEN {wins(k)} END AS {k}' for k in STYLES)} FROM y2),
y4 AS (SELECT * REPLACE ({', '.join(f'coalesce({k}, median({k}) OVER (PARTITION BY model_date, industry_group), median({k}) OVER (PARTITION BY model_date), 0.0) AS {k}' for k in STYLES)}) FROM y3),
y5 AS (SELECT model_date, code, industry_group, cap, forward_return, {', '.join(_std(k, k) for k in STYLES)} FROM y4 WINDOW d AS (PARTITION BY model_date))"""


def _round(r: int, rows: str, u: str) -> str:
    """Fit ``r`` of ``rows`` by weights ``u``: slopes within groups by Cramer's rule, then the residuals' median and scale."""
    v = ["y", "s1", "s2", "s3"]
    inside = ", ".join(f"{x} - sum({u} * {x}) OVER g / sum({u}) OVER g AS {x}_" for x in v)
    sums = ", ".join(f"sum({u} * {a}_ * {b}_) AS {a}{b}" for i, a in enumerate(v[1:]) for b in v[1 + i :]) + ", " + ", ".join(f"sum({u} * {a}_ * y_) AS y{a}" for a in v[1:])
    m = [["s1s1", "s1s2", "s1s3"], ["s1s2", "s2s2", "s2s3"], ["s1s3", "s2s3", "s3s3"]]

    def det(a: list[list[str]]) -> str:
        return "(" + " + ".join(f"{a[0][i]} * ({a[1][(i + 1) % 3]} * {a[2][(i + 2) % 3]} - {a[1][(i + 2) % 3]} * {a[2][(i + 1) % 3]})" for i in range(3)) + ")"

    slopes = ", ".join(f"{det([[f'ys{j + 1}' if i == k else m[j][i] for i in range(3)] for j in range(3)])} / {det(m)} AS b{k + 1}" for k in range(3))
    return f"""
m{r} AS (SELECT *, {inside} FROM {rows} WINDOW g AS (PARTITION BY model_date, industry_group)),
b{r} AS (SELECT model_date, {slopes} FROM (SELECT model_date, {sums} FROM m{r} GROUP BY 1 HAVING count(*) >= 6 + count(DISTINCT industry_group))),
e{r} AS (SELECT m{r}.*, b1, b2, b3, y_ - b1 * s1_ - b2 * s2_ - b3 * s3_ AS e FROM m{r} JOIN b{r} USING (model_date)),
d{r} AS (SELECT *, median(e) OVER (PARTITION BY model_date) AS mid FROM e{r}),
c{r} AS (SELECT *, 1.4826 * median(abs(e - mid)) OVER (PARTITION BY model_date) AS sc FROM d{r}),
r{r} AS (SELECT * EXCLUDE (mid, sc, y_, s1_, s2_, s3_), CASE WHEN sc > 1e-12 THEN w / greatest(abs(e - mid) / sc / 2.5, 1.0) ELSE w END AS u{r} FROM c{r})"""


FACTOR_RETURNS = f"""{_filled_styles()},
r0 AS (SELECT model_date, CAST(code AS VARCHAR) AS code, industry_group, cap, forward_return AS y, {', '.join(f'{s} AS s{i}' for i, s in enumerate(STYLES, 1))},
  least(sqrt(greatest(cap, 1.0)), quantile_cont(sqrt(greatest(cap, 1.0)), 0.99) OVER (PARTITION BY model_date)) AS w FROM y5 WHERE forward_return IS NOT NULL AND cap IS NOT NULL),{_round(1, 'r0', 'w')},{_round(2, '(SELECT * EXCLUDE (b1, b2, b3, e) FROM r1)', 'u1')},
ga AS (SELECT model_date, industry_group, sum(cap) AS cap, sum(u1 * y) / sum(u1) - max(b1) * sum(u1 * s1) / sum(u1) - max(b2) * sum(u1 * s2) / sum(u1) - max(b3) * sum(u1 * s3) / sum(u1) AS a FROM r2 GROUP BY 1, 2),
mk AS (SELECT model_date, sum(cap * a) / sum(cap) AS market FROM ga GROUP BY 1),
q2 AS (SELECT model_date, 1 - sum(u2 * e * e) / (sum(u2 * y * y) - pow(sum(u2 * y), 2) / sum(u2)) AS r2, max(b1) AS b1, max(b2) AS b2, max(b3) AS b3 FROM r2 GROUP BY 1),
fr AS (SELECT model_date, 'factor' AS kind, 'MARKET' AS name, market AS value FROM mk UNION ALL SELECT model_date, 'factor', industry_group, a - market FROM ga JOIN mk USING (model_date)
  UNION ALL {' UNION ALL '.join(f"SELECT model_date, 'factor', '{s}', b{i} FROM q2" for i, s in enumerate(STYLES, 1))} UNION ALL SELECT model_date, 'specific', code, e FROM r2)"""


def _factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of weeks in which the styles are known for twenty codes at least."""
    w = Window.partitionBy("model_date")
    known = _weekly_cross_section(spark, sf_dir).withColumns({"_m": F.count("momentum").over(w), "_v": F.count("volatility").over(w)}).where("_m >= 20 and _v >= 20").drop("_m", "_v")
    x = crosssection.style_exposures(known, "cap", STYLES, ["model_date"], "industry_group")
    return factors.factor_returns(x, factors.RegressionSpec(tuple(STYLES)))


@query(f"WITH {FACTOR_RETURNS} SELECT model_date, kind, name, round(value, 6) + 0.0 AS value, round(r2, 6) + 0.0 AS r2 FROM fr JOIN q2 USING (model_date)")
def factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_factor_returns(spark, sf_dir), 6)


FACTOR_COVARIANCE = f"""{FACTOR_RETURNS},
nd AS (SELECT model_date, row_number() OVER (ORDER BY model_date) AS n FROM q2), nm AS (SELECT DISTINCT name FROM fr WHERE kind = 'factor'),
gr AS (SELECT n, name, coalesce(value, 0.0) AS x, value IS NOT NULL AS there FROM nd CROSS JOIN nm LEFT JOIN (SELECT * FROM fr WHERE kind = 'factor') USING (model_date, name)),
ws AS (SELECT q.n AS q, s.n AS s, least(q.n, 156) AS size, pow(0.5, (q.n - s.n) / 52.0) AS w FROM nd q JOIN nd s ON s.n <= q.n AND s.n > q.n - 156 WHERE q.n >= 26),
mn AS (SELECT q, name, sum(w * x) / sum(w) AS m FROM ws JOIN gr ON n = s GROUP BY 1, 2 HAVING count(*) FILTER (there) > 0),
ce AS (SELECT ws.*, gr.name, x - m AS c FROM ws JOIN gr ON gr.n = s JOIN mn ON mn.q = ws.q AND mn.name = gr.name),
lg AS (SELECT a.q, a.name AS i, b.name AS j, a.s - b.s AS lag, any_value(a.size) AS size, sum(a.w * a.c * b.c) / sum(a.w) AS g FROM ce a JOIN ce b ON a.q = b.q AND b.s BETWEEN a.s - 4 AND a.s GROUP BY 1, 2, 3, 4),
co AS (SELECT q, i, j, sum(g) AS v FROM (SELECT q, i, j, CASE WHEN lag = 0 THEN g ELSE (1 - lag / (least(4, size - 1) + 1.0)) * g END AS g FROM lg UNION ALL SELECT q, j, i, (1 - lag / (least(4, size - 1) + 1.0)) * g FROM lg WHERE lag > 0) GROUP BY 1, 2, 3)"""


@query(f"WITH {FACTOR_COVARIANCE} SELECT model_date, i AS factor_1, j AS factor_2, round(CASE WHEN i = j THEN 1.0 ELSE 0.9 END * 52 * v, 6) + 0.0 AS covariance FROM co JOIN nd ON n = q")
def factor_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every week, before eigenvalues are floored."""
    return rounded(factors.raw_covariances(_factor_returns(spark, sf_dir), 156, 26, 52, 4), 6).withColumn("covariance", F.col("covariance") + 0.0)


@query()
def factor_covariance_floored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the last week of each year; its matrices are those above with eigenvalues floored, which SQL cannot say."""
    ends = _weekly_dates(spark, sf_dir).groupBy(F.trunc("model_date", "YEAR").alias("y")).agg(F.max("model_date").alias("model_date")).select("model_date")
    return rounded(factors.factor_covariance(_factor_returns(spark, sf_dir), ends, 156, 26, 52, 4), 8)


def _slopes(layer: str, controls: list[str]) -> str:
    v = ["momentum", *controls]
    ok = " AND ".join(f"{c} IS NOT NULL" for c in [*v, "forward_return"])
    cov = lambda a, b: f"covar_pop({a}, {b})"
    m, y = [[cov(a, b) for b in v] for a in v], [cov(a, "forward_return") for a in v]

    def det(a: list[list[str]]) -> str:
        if len(a) == 1:
            return a[0][0]
        return "(" + " + ".join(f"({'-' if i % 2 else ''}{a[0][i]}) * {det([row[:i] + row[i + 1 :] for row in a[1:]])}" for i in range(len(a))) + ")"

    top = det([[y[i], *m[i][1:]] for i in range(len(v))])
    return f"SELECT model_date, '{layer}' AS layer, {len(controls)} AS controls, {top} / {det(m)} * sqrt({m[0][0]}) AS s FROM xs WHERE {ok} GROUP BY 1 HAVING count(*) >= 40 AND min(momentum) < max(momentum)"


_LADDER = {"raw": [], "volatility": ["volatility"], "size": ["volatility", "size"]}


@query(f"""WITH {WEEKLY_X}, sl AS ({' UNION ALL '.join(_slopes(k, c) for k, c in _LADDER.items())}), ctr AS (SELECT *, s - avg(s) OVER (PARTITION BY layer) AS c FROM sl),
lgs AS (SELECT *, {', '.join(f'c * lag(c, {k}) OVER (PARTITION BY layer ORDER BY model_date) AS l{k}' for k in range(1, 5))} FROM ctr),
hv AS (SELECT layer, any_value(controls) AS controls, count(*) AS n, avg(s) AS m, (sum(c * c) + {' + '.join(f'2 * {1 - k / 5} * coalesce(sum(l{k}), 0)' for k in range(1, 5))}) / count(*) AS v FROM lgs GROUP BY 1)
SELECT layer, CAST(controls AS INTEGER) AS controls, n AS weeks, round(m, 6) + 0.0 AS mean_slope, round(CASE WHEN n >= 4 AND v > 0 THEN m / sqrt(v / n) END, 5) + 0.0 AS t FROM hv""")
def partial_slope_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _weekly_cross_section(spark, sf_dir).withColumnRenamed("model_date", "date")
    out = evaluate.ablation_ladder(x, "momentum", [("raw", []), ("volatility", ["volatility"]), ("size", ["size"])], least=40)
    return out.select("layer", "controls", "weeks", (F.round("mean_slope", 6) + 0.0).alias("mean_slope"), (F.round("t", 5) + 0.0).alias("t"))


@query(f"""WITH {CROSS}, r AS (SELECT date, round(size, 6) AS f, forward_return AS y FROM cross_section WHERE size IS NOT NULL AND forward_return IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) >= 100),
ed AS (SELECT date, list_distinct(quantile_cont(f, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM r GROUP BY 1),
bk AS (SELECT r.date, greatest(0, len(list_filter(edges, lambda x: x < f)) - 1) AS bucket, avg(y) AS m FROM r JOIN ed ON r.date = ed.date GROUP BY 1, 2),
pf AS (SELECT bucket, avg(m) AS m FROM bk GROUP BY 1), pl AS (SELECT count(*) AS weeks, avg(p) AS p FROM (SELECT avg(y) AS p FROM r GROUP BY date)),
en AS (SELECT arg_max(m, bucket) AS t, arg_min(m, bucket) AS b, (SELECT corr(x, y) FROM (SELECT rank() OVER (ORDER BY bucket) AS x, rank() OVER (ORDER BY m) AS y FROM pf)) AS rho FROM pf)
SELECT weeks, round(p, 6) AS pool_mean, round(t, 6) AS top_mean, round(b, 6) AS bottom_mean, round(t - p, 6) AS top_minus_pool, round(p - b, 6) AS pool_minus_bottom, round(t - b, 6) AS top_minus_bottom, round(rho, 6) AS monotonicity, t - p < 0.25 * (p - b) AS avoidance_only FROM pl, en WHERE weeks > 0""")
def decoupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.decoupling(cross_section(spark, sf_dir).withColumn("size", F.round("size", 6)), "size"))


# Portfolio risk


#: Covariances that differ for each pair: products of what each factor has, and 0.03 on the diagonal, so that 0.03 is the least eigenvalue.
_NATION_F = """fa AS (SELECT 'N' || s_nationkey AS f, 0.05 + avg(s_acctbal) / 1e5 AS a FROM supplier GROUP BY 1 UNION ALL SELECT 'MARKET', 0.15 + avg(s_acctbal) / 1e5 FROM supplier),
cv AS (SELECT x.f AS f1, y.f AS f2, x.a * y.a + CASE WHEN x.f = y.f THEN 0.03 ELSE 0 END AS v FROM fa x CROSS JOIN fa y)"""


def _products(loadings: DataFrame, diagonal: float = 0.03) -> DataFrame:
    """A covariance of factors (factor, a): products of loadings, and a constant on the diagonal."""
    names = loadings.agg(F.collect_list(F.struct("factor", "a")).alias("all"))  # some dozens of factors
    pairs = loadings.crossJoin(F.broadcast(names)).select(F.col("factor").alias("factor_1"), "a", F.inline("all").alias("factor_2", "b"))
    return pairs.select("factor_1", "factor_2", (F.col("a") * F.col("b") + F.when(F.col("factor_1") == F.col("factor_2"), diagonal).otherwise(0.0)).alias("covariance"))


def _nation_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    level = lambda base: (base + F.avg("s_acctbal") / 1e5).alias("a")
    own = s.groupBy(F.concat(F.lit("N"), "s_nationkey").alias("factor")).agg(level(0.05))
    return _products(own.union(s.agg(level(0.15)).select(F.lit("MARKET"), "a")))


def _risk_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Portfolios, exposures, a covariance and specific variances made of suppliers and nations."""
    s = table(spark, sf_dir, "supplier")
    weights = s.select((F.col("s_suppkey") % 4).alias("portfolio"), F.col("s_suppkey").alias("code"), (F.abs("s_acctbal") / 1e6).alias("weight"))
    x = s.select(F.col("s_suppkey").alias("code"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("factor"), F.lit(1.0).alias("value")).union(s.select("s_suppkey", F.lit("MARKET"), F.lit(1.0)))
    return weights, x, _nation_covariance(spark, sf_dir), s.select(F.col("s_suppkey").alias("code"), (0.05 + F.abs("s_acctbal") / 1e5).alias("specific_variance"))


@query(f"""WITH {_NATION_F}, w AS (SELECT s_suppkey % 4 AS portfolio, s_suppkey AS code, abs(s_acctbal) / 1e6 AS weight, 0.05 + abs(s_acctbal) / 1e5 AS sv, 'N' || s_nationkey AS f FROM supplier),
x AS (SELECT portfolio, f, sum(weight) AS x FROM w GROUP BY 1, 2 UNION ALL SELECT portfolio, 'MARKET', sum(weight) FROM w GROUP BY 1),
c AS (SELECT a.portfolio, sum(a.x * b.x * v) AS common FROM x a JOIN x b ON a.portfolio = b.portfolio JOIN cv ON f1 = a.f AND f2 = b.f GROUP BY 1),
s AS (SELECT portfolio, sum(weight * weight * sv) AS own FROM w GROUP BY 1)
SELECT portfolio, round(common, 8) AS common_variance, round(own, 8) AS specific_variance, round(common + own, 8) AS total_variance FROM c JOIN s USING (portfolio)""")
def portfolio_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.portfolio_risk(*_risk_tables(spark, sf_dir), ["portfolio"]), 8)


@query(f"""WITH {_NATION_F}, w AS (SELECT s_suppkey AS code, abs(s_acctbal) / 1e6 AS weight, 0.05 + abs(s_acctbal) / 1e5 AS sv, 'N' || s_nationkey AS f FROM supplier),
e AS (SELECT code, f, weight FROM w UNION ALL SELECT code, 'MARKET', weight FROM w), x AS (SELECT f, sum(weight) AS x FROM e GROUP BY 1),
p AS (SELECT f1 AS f, sum(v * x) AS pull FROM cv JOIN x ON f2 = x.f GROUP BY 1),
c AS (SELECT code, sum(weight * pull) AS common FROM e JOIN p USING (f) GROUP BY 1)
SELECT code, round(common + weight * weight * sv, 9) AS variance_contribution FROM c JOIN w USING (code)""")
def stock_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, x, cov, own = _risk_tables(spark, sf_dir)
    return rounded(risk.stock_contributions(w.drop("portfolio"), x, cov, own), 9)


@query(f"""WITH {_ACCOUNT}, {_NATION_F}, w AS (SELECT weight, s_acctbal > 0 AS known, 0.05 + abs(s_acctbal) / 1e5 AS sv, 'N' || s_nationkey AS f FROM acc JOIN supplier ON s_suppkey = k),
x AS (SELECT f, sum(weight) AS x FROM w GROUP BY 1 UNION ALL SELECT 'MARKET', sum(weight) FROM w), c AS (SELECT sum(a.x * b.x * v) AS common FROM x a CROSS JOIN x b JOIN cv ON f1 = a.f AND f2 = b.f),
t AS (SELECT sqrt(common + (SELECT sum(weight * weight * sv) FROM w WHERE known)) AS vol FROM c)
SELECT round(vol, 7) AS volatility, round(1.645 * vol / sqrt(244.0), 7) AS var_95, round(2.326 * vol / sqrt(244.0), 7) AS var_99, round((SELECT sum(weight) FROM w), 7) AS invested, round((SELECT sum(weight) FILTER (known) / sum(weight) FROM w), 7) AS coverage FROM t""")
def account_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, x, cov, own = _risk_tables(spark, sf_dir)
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("code"))
    text = lambda df: df.withColumn("code", F.col("code").cast("string"))
    return rounded(reports.account_risk(_account(spark, sf_dir), text(x), cov, text(own.join(known, "code", "left_semi"))), 7)


@query("""WITH n AS (SELECT count(DISTINCT s_nationkey) + 1 AS k FROM supplier) SELECT d AS model_date, k AS factors, d > DATE '2000-01-01' AS complete, d > DATE '2000-01-01' AS symmetric, CASE WHEN d > DATE '2000-01-01' THEN 0.03 END AS least_eigenvalue FROM n, (VALUES (DATE '2000-01-01'), (DATE '2000-02-01')) v(d)""")
def covariance_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of loadings with 0.03 on the diagonal have the least eigenvalue 0.03; the other date lacks the pair of its first and last factor."""
    cov = _nation_covariance(spark, sf_dir)
    ends = cov.agg(F.min("factor_1").alias("first"), F.max("factor_1").alias("last"))
    whole = cov.withColumn("model_date", F.lit("2000-02-01").cast("date"))
    short = cov.crossJoin(F.broadcast(ends)).where("not (factor_1 = first and factor_2 = last)").drop("first", "last").withColumn("model_date", F.lit("2000-01-01").cast("date"))  # one row
    out = reports.validate_covariance(whole.union(short))
    return out.withColumn("least_eigenvalue", F.round(F.nanvl("least_eigenvalue", F.lit(None).cast("double")), 8))


_PORTFOLIO_F = """la AS (SELECT 'SIZE' AS f, 0.1 + avg(value_style) AS a FROM cross_section UNION ALL SELECT 'VALUE', -avg(momentum) FROM cross_section UNION ALL SELECT 'MARKET', 0.2 FROM cross_section GROUP BY 1 UNION ALL SELECT industry_group, avg(cap) / 1e4 FROM cross_section GROUP BY 1)"""


@query(f"""WITH {EXPOSURES}, {_PORTFOLIO_F}, a3 AS (SELECT max(a) FILTER (f = 'SIZE') AS s, max(a) FILTER (f = 'VALUE') AS v, max(a) FILTER (f = 'MARKET') AS m FROM la),
x AS (SELECT code, date, industry_group, SIZE, VALUE, s * SIZE + v * VALUE + m + a AS load, 0.02 + cap / 1e5 AS sv FROM q8 JOIN la ON f = industry_group, a3)
SELECT a.industry_group, a.date, a.code AS code_1, b.code AS code_2, floor(1.21 * (a.load * b.load + 0.03 * (a.SIZE * b.SIZE + a.VALUE * b.VALUE + 2) + CASE WHEN a.code = b.code THEN a.sv ELSE 0 END) * 1e5 + 0.5) / 1e5 AS covariance
FROM x a JOIN x b ON a.industry_group = b.industry_group AND a.date = b.date AND a.code <= b.code""")
def stock_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pairs of parts of each brand and year."""
    c = staged(cross_section(spark, sf_dir).select("code", "date", "industry_group", "cap", "amount", "value_style", "momentum"), cleaned=True)
    x = c.select("code", "date", "cap", "industry_group", F.log("cap").alias("SIZE"), (F.col("amount") / F.col("cap")).alias("VALUE"))
    x = crosssection.wide_style_exposures(x, "cap", ["SIZE", "VALUE"], ["date"], "industry_group").withColumn("MARKET", F.lit(1.0))
    named = [F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in ("SIZE", "VALUE", "MARKET")]
    long = x.select("industry_group", "date", "code", F.inline(F.array(*named, F.struct(F.col("industry_group").alias("factor"), F.lit(1.0).alias("value")))))
    common = c.agg((0.1 + F.avg("value_style")).alias("SIZE"), (-F.avg("momentum")).alias("VALUE"), F.lit(0.2).alias("MARKET"))
    loadings = common.select(F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("a")) for f in ("SIZE", "VALUE", "MARKET")]))).union(c.groupBy("industry_group").agg((F.avg("cap") / 1e4).alias("a")))
    own = c.select("industry_group", "date", "code", (0.02 + F.col("cap") / 1e5).alias("specific_variance"))
    out = risk_aware.stock_covariance(long, _products(loadings), own, ["industry_group", "date"], multiplier=1.1)
    return out.withColumn("covariance", F.floor(F.col("covariance") * 1e5 + 0.5) / 1e5)


# Weights that trade nearness for risk


def _step(k: int) -> str:
    """Gradient step ``k``: the first of twelve halved steps whose loss does not grow, else none."""
    inner = lambda w, t: f"(sum({w}) OVER p) AS {t}1, (sum({w} * s) OVER p) AS {t}2"
    risk = lambda w, t: f"1.21 * ({t}1 * (0.04 * {t}1 + 0.01 * {t}2) + {t}2 * (0.01 * {t}1 + 0.03 * {t}2) + sum(d * {w} * {w}) OVER p)"
    loss = lambda w, t: f"(0.5 * sum(({w} - base) * ({w} - base)) OVER p / near + 0.5 * ({risk(w, t)}) / 0.0225)"
    return f"""
f{k} AS (SELECT *, {inner(f'w{k - 1}', 'z')} FROM o{k - 1} WINDOW p AS (PARTITION BY d_)),
g{k} AS (SELECT *, 2 * 0.5 * (w{k - 1} - base) / near + 2 * 0.5 * 1.21 * (0.04 * z1 + 0.01 * z2 + s * (0.01 * z1 + 0.03 * z2) + d * w{k - 1}) / 0.0225 AS slope, {loss(f'w{k - 1}', 'z')} AS now FROM f{k} WINDOW p AS (PARTITION BY d_)),
v{k} AS (SELECT *, greatest(w{k - 1} - 0.10 / pow(2, t) * slope, 0.0) AS raw FROM g{k} CROSS JOIN (SELECT unnest(range(12)) AS t)),
n{k} AS (SELECT *, CASE WHEN sum(raw) OVER p <= 0 THEN total / count(*) OVER p ELSE raw / (sum(raw) OVER p) * total END AS c FROM v{k} WINDOW p AS (PARTITION BY d_, t)),
h{k} AS (SELECT *, {inner('c', 'x')} FROM n{k} WINDOW p AS (PARTITION BY d_, t)),
l{k} AS (SELECT *, {loss('c', 'x')} <= now + 1e-12 AS ok, sum(abs(c - w{k - 1})) OVER p AS moved FROM h{k} WINDOW p AS (PARTITION BY d_, t)),
t{k} AS (SELECT *, min(t) FILTER (ok) OVER (PARTITION BY d_) AS used FROM l{k}),
o{k} AS (SELECT d_, code, base, s, d, near, total, CASE WHEN used IS NOT NULL AND moved >= 1e-8 AND NOT done THEN c ELSE w{k - 1} END AS w{k}, done OR used IS NULL OR moved < 1e-8 AS done FROM t{k} WHERE t = coalesce(used, 0))"""


@query(f"""WITH b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d_, o_custkey % 23 AS code, sum(o_totalprice) AS v, avg(o_custkey % 7) / 3.0 - 1 AS s, 0.02 + min(o_custkey) % 11 / 50.0 AS d FROM orders GROUP BY 1, 2),
o0 AS (SELECT d_, code, 0.9 * v / sum(v) OVER p AS base, s, d, 0.81 * (sum(v * v) OVER p) / pow(sum(v) OVER p, 2) AS near, 0.9 AS total, 0.9 * v / sum(v) OVER p AS w0, FALSE AS done FROM b WINDOW p AS (PARTITION BY d_)),{_step(1)},{_step(2)},{_step(3)},
fin AS (SELECT *, sqrt(1.21 * (z1 * (0.04 * z1 + 0.01 * z2) + z2 * (0.01 * z1 + 0.03 * z2) + sum(d * w3 * w3) OVER (PARTITION BY d_))) AS vol FROM (SELECT *, sum(w3) OVER p AS z1, sum(w3 * s) OVER p AS z2 FROM o3 WINDOW p AS (PARTITION BY d_)))
SELECT d_ AS decision_date, CAST(code AS VARCHAR) AS code, round(w3 * CASE WHEN vol > 0.15 THEN greatest(0.15 / vol, 0.8) ELSE 1 END, 6) AS weight, round(vol, 6) AS volatility_optimised FROM fin""")
def risk_aware_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly portfolios of customer classes, three gradient steps and no cap that binds, which SQL can say; tests have caps that bind."""
    o = table(spark, sf_dir, "orders").withColumn("decision_date", F.to_date(F.trunc("o_orderdate", "MM")))
    b = o.groupBy("decision_date", (F.col("o_custkey") % 23).cast("string").alias("code")).agg(F.sum("o_totalprice").alias("v"), (F.avg(F.col("o_custkey") % 7) / 3.0 - 1).alias("s"), (0.02 + F.min("o_custkey") % 11 / 50.0).alias("d"))
    weights = b.select("decision_date", "code", (0.9 * F.col("v") / F.sum("v").over(Window.partitionBy("decision_date"))).alias("weight"))
    x = b.select("decision_date", "code", F.explode(F.create_map(F.lit("MARKET"), F.lit(1.0), F.lit("SIZE"), F.col("s"))).alias("factor", "value"))
    own = b.select("decision_date", "code", F.lit("one").alias("industry_group"), F.col("d").alias("specific_variance"))
    rows = [F.struct(F.lit(f).alias("factor_1"), F.lit(g).alias("factor_2"), F.lit(v).alias("covariance")) for f, g, v in (("MARKET", "MARKET", 0.04), ("MARKET", "SIZE", 0.01), ("SIZE", "MARKET", 0.01), ("SIZE", "SIZE", 0.03))]
    covariance = b.select("decision_date").distinct().select("decision_date", F.inline(F.array(*rows)))
    spec = risk_aware.Overlay(stock_cap=1.0, group_fraction=1.0, strength=0.5, target_volatility=0.15, multiplier=1.1, least_scale=0.8, iterations=3)
    return rounded(risk_aware.risk_aware_weights(weights, x, own, covariance, spec).select("decision_date", "code", "weight", "volatility_optimised"))


# Targets without caps, diagnostics and progress


@query(f"""WITH {CROSS}, r AS (SELECT date, code, round(amount, 2) AS score, CASE WHEN n > 1 THEN size / 100 END AS vol, row_number() OVER (PARTITION BY date ORDER BY round(amount, 2) DESC, lpad(CAST(code AS VARCHAR), 8, '0')) AS k FROM cross_section),
p AS (SELECT * FROM r WHERE k <= 25), m AS (SELECT *, coalesce(vol, median(vol) OVER d) AS v, max(score) OVER d AS top FROM p WINDOW d AS (PARTITION BY date)),
w AS (SELECT *, exp(greatest(-30, least(30, (score - top) / 50000.0))) / pow(greatest(v, 0.15), 0.5) AS raw FROM m)
SELECT date AS year, lpad(CAST(code AS VARCHAR), 8, '0') AS code, round(0.9 * raw / sum(raw) OVER (PARTITION BY date), 6) AS weight FROM w""")
def uncapped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the 25 best of each year where no cap binds, which SQL can say; tests have caps that bind."""
    x = cross_section(spark, sf_dir)
    scored = x.select(F.make_date("date", F.lit(1), F.lit(1)).alias("decision_date"), F.lpad(F.col("code").cast("string"), 8, "0").alias("code"), F.round("amount", 2).alias("score"), F.when(F.col("n") > 1, F.col("size") / 100).alias("volatility"), F.lit("one").alias("industry_group"), F.lit(False).alias("held"))
    spec = portfolio.Construction(equity=0.9, count=25, buy_rank=25, sell_rank=25, stock_cap=1.0, group_cap=1.0, temperature=50000.0, volatility_power=0.5, least_volatility=0.15)
    return portfolio.target_weights(scored, spec).select(F.year("decision_date").alias("year"), "code", F.round("weight", 6).alias("weight"))


@query(f"""WITH {WEEKLY_X} SELECT model_date, count(*) AS rows, count(DISTINCT code) AS codes, count(DISTINCT CASE WHEN industry_group <> 'R3' THEN industry_group END) AS groups, round(avg(CAST(industry_group = 'R3' AS INTEGER)), 6) AS unknown_share,
{', '.join(f"round(avg(CAST({c} IS NOT NULL AS INTEGER)), 6) AS {c}_coverage" for c in (*STYLES, 'forward_return'))}, count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in (*STYLES, 'forward_return'))}) AS complete_rows FROM xs GROUP BY 1""")
def date_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _weekly_cross_section(spark, sf_dir).withColumn("industry_group", F.when(F.col("industry_group") == "R3", "UNKNOWN").otherwise(F.col("industry_group")))
    return rounded(reports.date_diagnostics(x, "model_date", [*STYLES, "forward_return"], "industry_group"))


@query("""WITH r AS (SELECT o_orderpriority AS stage, o_custkey AS item, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'error' END AS status, o_orderkey AS upd FROM orders),
l AS (SELECT stage, item, arg_max(status, upd) AS status, max(upd) AS upd FROM r GROUP BY 1, 2)
SELECT stage, count(*) AS items, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'error') AS failed, max(item) AS last_item, max(upd) AS last_update FROM l GROUP BY 1""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of a build: priorities as stages, customers as items."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running").otherwise("error")
    return reports.run_progress(o.select(F.col("o_orderpriority").alias("stage"), F.col("o_custkey").alias("item"), status.alias("status"), F.col("o_orderkey").alias("updated_at")))


@query("""WITH o AS (SELECT o_orderpriority AS p, CAST(date_trunc('week', o_orderdate) AS DATE) AS f, CAST(date_trunc('week', o_orderdate) AS DATE) + 7 AS d, o_totalprice / 1e7 - 0.02 AS r, CASE WHEN o_custkey % 50 <> 3 THEN 0.0002 + o_custkey % 7 / 1e4 ELSE 0 END AS v FROM orders),
k AS (SELECT * FROM o WHERE v > 0), a AS (SELECT max(d) AS t FROM o GROUP BY date_trunc('month', d)),
u AS (SELECT t, f FROM (SELECT t, f, row_number() OVER (PARTITION BY t ORDER BY f DESC) AS n FROM a JOIN (SELECT DISTINCT f, d FROM k) ON d <= t) WHERE n <= 26),
g AS (SELECT t, p, sum(r * r) - sum(r) * sum(r) / count(*) AS rr, count(*) AS n, sum(v) AS v FROM u JOIN k USING (f) GROUP BY 1, 2), w AS (SELECT t, count(*) AS weeks FROM u GROUP BY 1)
SELECT t AS as_of_date, round(CASE WHEN any_value(weeks) >= 10 THEN sqrt(sum(rr) / sum(v)) ELSE 1.0 END, 5) AS multiplier, CAST(any_value(weeks) AS BIGINT) AS forecast_weeks FROM g JOIN w USING (t) GROUP BY 1""")
def rolling_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, week = table(spark, sf_dir, "orders"), F.to_date(F.trunc("o_orderdate", "week"))
    rows = o.select(F.col("o_orderpriority").alias("portfolio_name"), week.alias("forecast_date"), F.date_add(week, 7).alias("realized_date"), (F.col("o_totalprice") / 1e7 - 0.02).alias("realized_weekly_return"), F.when(F.col("o_custkey") % 50 != 3, 0.0002 + F.col("o_custkey") % 7 / 1e4).otherwise(0.0).alias("predicted_weekly_variance"))
    ends = rows.groupBy(F.trunc("realized_date", "MM").alias("m")).agg(F.max("realized_date").alias("as_of_date")).select("as_of_date")
    return rounded(risk.rolling_calibration(rows, ends, 10, 26), 5)


# Scores and throttles


@query(f"""WITH {CROSS}, r AS (SELECT date, round(size, 6) AS s, forward_return AS y FROM cross_section WHERE size IS NOT NULL AND forward_return IS NOT NULL),
q AS (SELECT *, quantile_cont(y, 0.01) OVER d AS lo, quantile_cont(y, 0.99) OVER d AS hi, (rank() OVER (PARTITION BY date ORDER BY s) + (count(*) OVER (PARTITION BY date, s) - 1) / 2.0) / count(*) OVER d AS k FROM r WINDOW d AS (PARTITION BY date)),
c AS (SELECT *, greatest(lo, least(hi, y)) AS v FROM q)
SELECT date, count(*) AS names, round(regr_slope(v, s), 6) + 0.0 AS slope, round(avg(v) FILTER (k >= 0.8) - avg(v) FILTER (k <= 0.2), 6) + 0.0 AS spread FROM c GROUP BY 1 HAVING count(*) >= 40""")
def score_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score_slopes(cross_section(spark, sf_dir).withColumn("size", F.round("size", 6)), "size", "forward_return", "date")
    return out.select("date", "names", (F.round("slope", 6) + 0.0).alias("slope"), (F.round("spread", 6) + 0.0).alias("spread"))


@query(f"""WITH {PANEL}, {MARKET}, u AS (SELECT trade_date, avg(CAST(daily_return > 0 AS INTEGER)) AS up FROM panel GROUP BY 1),
i AS (SELECT trade_date, up, exp(sum(ln(1 + coalesce(market_return, 0))) OVER (ORDER BY trade_date)) AS x FROM market JOIN u USING (trade_date)),
f AS (SELECT trade_date, x / lag(x, 5) OVER o - 1 AS r5, x / lag(x, 10) OVER o - 1 AS r10, x / lag(x, 20) OVER o - 1 AS r20, CASE WHEN count(up) OVER v >= 5 THEN avg(up) OVER v END AS b5 FROM i WINDOW o AS (ORDER BY trade_date), v AS (ORDER BY trade_date ROWS 4 PRECEDING))
SELECT trade_date, CASE WHEN round(r5, 6) >= -0.01 AND round(r10, 6) >= -0.02 AND round(r20, 6) <= 0.02 AND round(b5, 6) >= 0.4 THEN 1.0 ELSE 0.0 END AS rebound, round(greatest(0, least(1, (greatest(0, least(1, coalesce(b5, 0.3))) - 0.3) / 0.4)), 5) AS throttle FROM f""")
def rebound_and_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    up = p.groupBy("trade_date").agg(F.avg((F.col("daily_return") > 0).cast("double")).alias("up"))
    o = Window.orderBy("trade_date")  # a row a day
    i = views.market(p).join(up, "trade_date").withColumn("x", F.exp(F.sum(F.log1p(F.coalesce("market_return", F.lit(0.0)))).over(o)))
    back = lambda n: F.round(F.col("x") / F.lag("x", n).over(o) - 1, 6)
    five = o.rowsBetween(-4, 0)
    f = i.select("trade_date", back(5).alias("r5"), back(10).alias("r10"), back(20).alias("r20"), F.when(F.count("up").over(five) >= 5, F.avg("up").over(five)).alias("b5"))
    rebound = scoring.fast_rebound(F.col("r5"), F.col("r10"), F.col("r20"), F.round("b5", 6), -0.01, -0.02, 0.02, 0.4)
    return f.select("trade_date", rebound.alias("rebound"), F.round(scoring.equity_throttle(F.col("b5"), 0.3, 0.7), 5).alias("throttle"))

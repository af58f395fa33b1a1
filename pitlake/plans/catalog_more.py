"""Further named queries with SQL oracles: features, scores, universes, attachments, rules and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlake.functions import columns as C
from pitlake.functions import trading as T
from pitlake.operators import aggregates, asof, attach, crosssection, evaluate, features, reports, risk, scoring, universe
from pitlake.operators import windows as W
from pitlake.plans import views
from pitlake.plans.catalog import WEEKLY, query, rounded, weekly_returns
from pitlake.plans.views import CROSS, MARKET, PANEL, cross_section, panel, table

# Weekly features and exposures


def _market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return p.join(views.market(p), "trade_date").withColumn("turnover", F.col("volume"))


@query(f"""WITH {PANEL}, {MARKET},
v AS (SELECT p.*, market_return AS m, daily_return AS r, volume AS t, (daily_return IS NOT NULL AND market_return IS NOT NULL) AS ok FROM panel p JOIN market USING (trade_date)),
c AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY code) - count(*) FILTER (ok) OVER (PARTITION BY code ORDER BY trade_date) AS age FROM v),
g AS (SELECT *, CASE WHEN ok THEN pow(0.5, age / 63.0) END AS w FROM c),
s AS (SELECT *, sum(w * m) OVER l / sum(w) OVER l AS x, sum(w * r) OVER l / sum(w) OVER l AS y, sum(w * m * m) OVER l / sum(w) OVER l AS xx, sum(w * m * r) OVER l / sum(w) OVER l AS xy, sum(w * r * r) OVER l / sum(w) OVER l AS yy,
        count(w) OVER l AS n, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS history_days, avg(amount) OVER (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING) AS avg_amount_60,
        sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND 21 PRECEDING) AS mom,
        CASE WHEN count(CASE WHEN t >= 0 THEN 1 END) OVER (PARTITION BY code ORDER BY trade_date ROWS 20 PRECEDING) >= 10 THEN ln(greatest(sum(CASE WHEN t >= 0 THEN t END) OVER (PARTITION BY code ORDER BY trade_date ROWS 20 PRECEDING) / 100, 1e-8)) END AS l1,
        CASE WHEN count(CASE WHEN t >= 0 THEN 1 END) OVER (PARTITION BY code ORDER BY trade_date ROWS 62 PRECEDING) >= 31 THEN ln(greatest(sum(CASE WHEN t >= 0 THEN t END) OVER (PARTITION BY code ORDER BY trade_date ROWS 62 PRECEDING) / 100, 1e-8)) END AS l2,
        CASE WHEN count(CASE WHEN t >= 0 THEN 1 END) OVER l >= 126 THEN ln(greatest(sum(CASE WHEN t >= 0 THEN t END) OVER l / 100, 1e-8)) END AS l3
      FROM g WINDOW l AS (PARTITION BY code ORDER BY trade_date ROWS 251 PRECEDING)),
b AS (SELECT *, CASE WHEN n >= 126 AND xx - x * x > 1e-12 THEN (xy - x * y) / (xx - x * x) END AS beta FROM s),
k AS (SELECT DISTINCT CAST(date_trunc('week', trade_date + INTERVAL 2 DAY) - INTERVAL 2 DAY AS DATE) AS week, max(trade_date) OVER (PARTITION BY date_trunc('week', trade_date + INTERVAL 2 DAY)) AS model_date FROM panel),
e AS (SELECT code, date_trunc('week', trade_date + INTERVAL 2 DAY) - INTERVAL 2 DAY AS week, exp(sum(CASE WHEN daily_return > -1 THEN ln(1 + daily_return) END)) - 1 AS weekly_return FROM panel GROUP BY 1, 2),
a AS (SELECT DISTINCT code FROM panel),
j AS (SELECT a.code, k.week, k.model_date, b.* EXCLUDE (code) FROM a CROSS JOIN k ASOF JOIN b ON a.code = b.code AND k.model_date >= b.trade_date)
SELECT j.code, model_date, trade_date AS observation_date, round(weekly_return, 6) AS weekly_return, round(beta, 5) AS beta_raw,
       round(CASE WHEN beta IS NOT NULL THEN sqrt(greatest(yy - y * y - 2 * beta * (xy - x * y) + beta * beta * (xx - x * x), 0) * 244) END, 5) AS residual_volatility_raw,
       round(CASE WHEN history_days >= 252 THEN exp(mom) - 1 END, 5) AS momentum_raw, round(list_avg(list_filter([l1, l2, l3], lambda q: q IS NOT NULL)), 5) AS liquidity_raw, round(avg_amount_60 + 1e-7, 2) AS avg_amount_60, history_days
FROM j LEFT JOIN e ON e.code = j.code AND e.week = j.week WHERE date_diff('day', trade_date, model_date) <= 10""")
def weekly_stock_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _market_panel(spark, sf_dir)
    out = features.weekly_stock_features(p, W.week_ends(p))
    return out.select("code", "model_date", "observation_date", F.round("weekly_return", 6).alias("weekly_return"), *[F.round(c, 5).alias(c) for c in ("beta_raw", "residual_volatility_raw", "momentum_raw", "liquidity_raw")],
                      F.round(F.col("avg_amount_60") + 1e-7, 2).alias("avg_amount_60"), F.col("history_days").cast("long").alias("history_days"))


def _std(name: str, value: str) -> str:
    m = f"sum(wt * {value}) OVER d / sum(wt) OVER d"
    v = f"(sum(wt * {value} * {value}) OVER d / sum(wt) OVER d - pow({m}, 2))"
    return f"CASE WHEN {v} > 1e-12 THEN ({value} - {m}) / sqrt({v}) ELSE 0.0 END AS {name}"


def _res(name: str, y: str, x: str) -> str:
    t = "sum(wt) OVER d"
    mx, my = f"(sum(wt * {x}) OVER d / {t})", f"(sum(wt * {y}) OVER d / {t})"
    sxx = f"(sum(wt * {x} * {x}) OVER d / {t} - {mx} * {mx})"
    return f"{y} - {my} - CASE WHEN {sxx} > 1e-12 THEN (sum(wt * {x} * {y}) OVER d / {t} - {mx} * {my}) / {sxx} ELSE 0 END * ({x} - {mx}) AS {name}"


_RAW = {"SIZE": "ln(cap)", "BETA": "value_style", "RESIDUAL_VOLATILITY": "momentum", "LIQUIDITY": "size", "VALUE": "amount / cap"}
_D = "WINDOW d AS (PARTITION BY date)"
EXPOSURES = f"""{CROSS},
q1 AS (SELECT code, date, industry_group, cap, {', '.join(f'{v} AS {k}' for k, v in _RAW.items())} FROM cross_section),
q2 AS (SELECT *, least(sqrt(cap), quantile_cont(sqrt(cap), 0.99) OVER d) AS wt, {', '.join(f'median({k}) OVER d AS {k}_mid, quantile_cont({k}, 0.01) OVER d AS {k}_q1, quantile_cont({k}, 0.99) OVER d AS {k}_q99' for k in _RAW)} FROM q1 {_D}),
q3 AS (SELECT *, {', '.join(f'median(abs({k} - {k}_mid)) OVER d AS {k}_mad' for k in _RAW)} FROM q2 {_D}),
q4 AS (SELECT code, date, industry_group, cap, wt, {', '.join(f'CASE WHEN {k}_mad > 1e-12 THEN greatest({k}_mid - 5 * 1.4826 * {k}_mad, least({k}_mid + 5 * 1.4826 * {k}_mad, {k})) ELSE greatest({k}_q1, least({k}_q99, {k})) END AS {k}' for k in _RAW)} FROM q3),
q5 AS (SELECT code, date, industry_group, cap, wt, {', '.join(_std(k, k) for k in _RAW)} FROM q4 {_D}),
q6 AS (SELECT *, {_res('nl', 'pow(SIZE, 3)', 'SIZE')}, {_res('lq', 'LIQUIDITY', 'SIZE')}, {_res('rv', 'RESIDUAL_VOLATILITY', 'SIZE')}, {_res('rb', 'BETA', 'SIZE')} FROM q5 {_D}),
q7 AS (SELECT *, {_res('rv2', 'rv', 'rb')} FROM q6 {_D}),
q8 AS (SELECT code, date, industry_group, cap, SIZE, BETA, VALUE, {_std('NONLINEAR_SIZE', 'nl')}, {_std('RESIDUAL_VOLATILITY', 'rv2')}, {_std('LIQUIDITY', 'lq')} FROM q7 {_D})"""
_STYLES = ["SIZE", "BETA", "RESIDUAL_VOLATILITY", "LIQUIDITY", "VALUE", "NONLINEAR_SIZE"]


@query(f"WITH {EXPOSURES} SELECT code, date, {', '.join(f'round({k}, 4) + 0.0 AS {k}' for k in _STYLES)} FROM q8")
def cross_section_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_exposures(spark, sf_dir).select("code", "date", *_STYLES), 4).select("code", "date", *[(F.col(k) + 0.0).alias(k) for k in _STYLES])


def _exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = {"SIZE": F.log("cap"), "BETA": F.col("value_style"), "RESIDUAL_VOLATILITY": F.col("momentum"), "LIQUIDITY": F.col("size"), "VALUE": F.col("amount") / F.col("cap")}
    x = cross_section(spark, sf_dir).select("code", "date", "industry_group", "cap", "forward_return", *[c.alias(k) for k, c in raw.items()])
    return crosssection.residual_styles(crosssection.style_exposures(x, "cap", list(raw), ["date"], "industry_group"), "cap", ["date"])


@query(f"""WITH {EXPOSURES}, y AS (SELECT code, date, forward_return AS r FROM cross_section), n AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM q8))
SELECT q8.code, q8.date, nxt AS realised_date, round(SIZE, 4) + 0.0 AS SIZE, round(r, 4) + 0.0 AS realised_return FROM q8 JOIN n ON n.date = q8.date JOIN y ON y.code = q8.code AND y.date = nxt""")
def exposure_realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _exposures(spark, sf_dir)
    r = x.select("code", "date", F.col("forward_return").alias("weekly_return"))
    out = attach.exposure_with_realised(x.select("code", "date", "SIZE"), r, "date")
    return out.select("code", "date", "realised_date", (F.round("SIZE", 4) + 0.0).alias("SIZE"), (F.round("realised_return", 4) + 0.0).alias("realised_return"))


# Snapshots and scores


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    group = F.concat(F.lit("R"), F.col("s_nationkey") % 5)
    return features.snapshot(_market_panel(spark, sf_dir)).join(s.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), group.alias("industry_group"), F.col("s_acctbal").alias("balance")), "code")


SNAPSHOT = f"""{PANEL}, {MARKET},
u AS (SELECT p.*, market_return AS m, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM panel p JOIN market USING (trade_date)),
h AS (SELECT code, close, k, max(CASE WHEN k <= 120 THEN close END) OVER (PARTITION BY code ORDER BY trade_date) AS peak FROM u),
dd AS (SELECT code, CASE WHEN count(*) >= 20 THEN min(close / peak - 1) END AS drawdown_120 FROM h WHERE k <= 120 GROUP BY 1),
snap AS (SELECT u.code, count(*) AS days, max(trade_date) AS latest_trade_date, max(CASE WHEN k = 1 THEN close END) AS close, avg(CASE WHEN k <= 60 THEN amount END) AS avg_amount_60,
  max(CASE WHEN k = 21 THEN close END) / max(CASE WHEN k = 253 THEN close END) - 1 AS mom_252_skip_20, max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 121 THEN close END) - 1 AS mom_120,
  max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 61 THEN close END) - 1 AS mom_60, 1 - max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 21 THEN close END) AS reversal_20,
  stddev_samp(CASE WHEN k <= 120 THEN daily_return END) * sqrt(244) AS volatility_120, avg(CASE WHEN k <= 20 THEN volume END) AS turnover_20,
  CASE WHEN count(CASE WHEN k <= 120 THEN daily_return + m END) >= 60 THEN covar_samp(CASE WHEN k <= 120 THEN daily_return END, CASE WHEN k <= 120 THEN m END) / var_samp(CASE WHEN k <= 120 AND daily_return IS NOT NULL THEN m END) END AS beta_120
  FROM u GROUP BY 1),
feat AS (SELECT snap.*, drawdown_120, s_name AS name, 'R' || (s_nationkey % 5) AS industry_group, s_acctbal AS balance FROM snap JOIN dd USING (code) JOIN supplier ON s_suppkey = code)"""


@query(f"""WITH {SNAPSHOT} SELECT code, days, latest_trade_date, {', '.join(f'round({c} + 1e-8, 4) AS {c}' for c in ('close', 'mom_252_skip_20', 'mom_120', 'mom_60', 'reversal_20', 'volatility_120', 'turnover_20', 'beta_120', 'drawdown_120'))} FROM feat""")
def feature_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["code", "days", "latest_trade_date", "close", "mom_252_skip_20", "mom_120", "mom_60", "reversal_20", "volatility_120", "turnover_20", "beta_120", "drawdown_120"]
    return _snapshot(spark, sf_dir).select(*columns[:3], *[F.round(F.col(c) + 1e-8, 4).alias(c) for c in columns[3:]])


def _plain(c: str) -> str:
    return f"coalesce(greatest(-3, least(3, CASE WHEN stddev_samp({c}) OVER () > 1e-12 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () WHEN {c} IS NULL THEN NULL ELSE 0 END)), 0)".replace("greatest(-3, least(3, CASE", "(CASE WHEN " + c + " IS NULL THEN NULL ELSE greatest(-3, least(3, CASE").replace("ELSE 0 END)), 0)", "ELSE 0 END)) END), 0)")


def _within(c: str) -> str:
    g = f"OVER (PARTITION BY industry_group)"
    own = f"CASE WHEN count({c}) {g} >= 5 AND {c} IS NOT NULL THEN CASE WHEN stddev_samp({c}) {g} > 1e-12 THEN greatest(-3, least(3, ({c} - avg({c}) {g}) / stddev_samp({c}) {g})) ELSE 0 END END"
    return f"coalesce({own}, {_plain(c)})"


def _score_sql(parts: list[tuple[str, float, bool]]) -> str:
    return " + ".join(f"{w} * {(_within if n else _plain)(c)}" for c, w, n in parts)


_BASE = {k: v for k, v in features.COMPONENTS.items() if k in ("momentum_score", "low_volatility_score", "low_beta_score", "low_turnover_score", "lower_drawdown_score", "reversal_score", "medium_reversal_score", "defensive_score")}


@query(f"""WITH {SNAPSHOT}, c AS (SELECT code, {', '.join(f'{_score_sql(v)} AS {k}' for k, v in _BASE.items())} FROM feat),
s AS (SELECT *, 0.42 * low_volatility_score + 0.28 * low_turnover_score + 0.20 * lower_drawdown_score AS low_risk, 0.30 * low_beta_score + 0.24 * low_volatility_score + 0.20 * low_turnover_score + 0.16 * reversal_score + 0.10 * lower_drawdown_score AS defensive FROM c)
SELECT code, {', '.join(f'round({k}, 4) + 0.0 AS {k}' for k in [*_BASE, 'low_risk', 'defensive'])}, CAST(row_number() OVER (ORDER BY round(defensive, 4) DESC, code) AS INTEGER) AS rank FROM s""")
def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = features.component_scores(_snapshot(spark, sf_dir).withColumn("d", F.lit(0)), _BASE, ["d"], "industry_group")
    x = features.weighted_score(features.weighted_score(x, features.PROFILES["low_risk_only"], "low_risk"), features.PROFILES["low_beta_defensive"], "defensive")
    x = rounded(x.select("code", "d", *_BASE, "low_risk", "defensive"), 4)
    return scoring.ranked(x, "defensive", ["d"]).select("code", *[(F.col(k) + 0.0).alias(k) for k in [*_BASE, "low_risk", "defensive"]], "rank")


_INDUSTRY = """i AS (SELECT f.*, avg(mom_60) OVER (PARTITION BY industry_group) - avg(mom_60) OVER () AS industry_relative_60, avg(reversal_20) OVER () - avg(reversal_20) OVER (PARTITION BY industry_group) AS industry_relative_20, balance / 1e4 AS earnings_yield_raw, mom_120 AS residual_momentum_raw FROM feat f)"""


def _with_industry(x: DataFrame) -> DataFrame:
    w, g = Window.partitionBy("d"), Window.partitionBy("d", "industry_group")
    x = x.withColumn("d", F.lit(0))
    return x.withColumns({
        "industry_relative_60": F.avg("mom_60").over(g) - F.avg("mom_60").over(w), "industry_relative_20": F.avg("reversal_20").over(w) - F.avg("reversal_20").over(g),
        "earnings_yield_raw": F.col("balance") / 1e4, "residual_momentum_raw": F.col("mom_120"),
    })


@query(f"""WITH {SNAPSHOT}, {_INDUSTRY} SELECT code, {', '.join(f'round({_score_sql(v)}, 4) + 0.0 AS {k}' for k, v in features.STRUCTURAL.items())} FROM i""")
def structural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = features.component_scores(_with_industry(_snapshot(spark, sf_dir)), features.STRUCTURAL, ["d"], "industry_group")
    return x.select("code", *[(F.round(k, 4) + 0.0).alias(k) for k in features.STRUCTURAL])


_THIRD = {k: v for k, v in features.THIRD.items() if k not in ("quality_score_v31", "growth_score_v31")}
_W3 = {k: round(1 / (i + 3), 4) for i, k in enumerate(_THIRD)}


@query(f"""WITH {SNAPSHOT}, {_INDUSTRY}, c AS (SELECT code, {', '.join(f'{_score_sql(v)} AS {k}' for k, v in _THIRD.items())} FROM i), s AS (SELECT *, {' + '.join(f'{w} * {k}' for k, w in _W3.items())} AS score FROM c)
SELECT code, round(score, 4) + 0.0 AS score, round(0.8 * {_plain('score')} + 0.2 * {_plain('residual_momentum_score')} + greatest(-0.1, least(0.1, low_beta_score)), 4) + 0.0 AS score_tilted FROM s""")
def third_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = features.component_scores(_with_industry(_snapshot(spark, sf_dir)), features.THIRD, ["d"], "industry_group")
    x = features.tilted(features.weighted_score(x, _W3), "score", "residual_momentum_score", 0.2, ["d"], "low_beta_score", 0.1)
    return x.select("code", (F.round("score", 4) + 0.0).alias("score"), (F.round("score_tilted", 4) + 0.0).alias("score_tilted"))


# Universes and dates


@query(f"""WITH {PANEL}, r AS (SELECT code, trade_date, close, amount, count(*) OVER (PARTITION BY code ORDER BY trade_date) AS days, avg(amount) OVER (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING) AS a FROM panel),
wk AS (SELECT max(trade_date) AS decision_date FROM panel GROUP BY date_trunc('week', trade_date + INTERVAL 2 DAY)), gd AS (SELECT code, decision_date FROM (SELECT DISTINCT code FROM panel) CROSS JOIN wk),
j AS (SELECT gd.code, decision_date, trade_date, close, days, a FROM gd ASOF JOIN r ON gd.code = r.code AND gd.decision_date >= r.trade_date),
u AS (SELECT j.*, CASE WHEN s_nationkey % 6 = 0 THEN 'Suspended' ELSE 'Norm' END AS state, CASE WHEN s_nationkey % 7 = 1 THEN '*ST ' ELSE '' END || s_name AS name, CASE WHEN s_acctbal > 0 THEN close * s_acctbal END AS cap FROM j JOIN supplier ON s_suppkey = code),
t AS (SELECT code, decision_date, cap FROM u WHERE trade_date = decision_date AND days >= 60 AND round(a, 4) >= 30000 AND state = 'Norm' AND close IS NOT NULL AND upper(name) NOT LIKE '%ST%' AND cap IS NOT NULL)
SELECT code, decision_date, round(cap, 1) AS market_cap FROM t QUALIFY cap >= quantile_cont(cap, 0.2) OVER (PARTITION BY decision_date)""")
def backtest_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every week's last day: names with a price on it, history, turnover, normal state and a capitalisation, without the smallest fifth."""
    w = W.series("code")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.when(F.col("s_nationkey") % 6 == 0, "Suspended").otherwise("Norm").alias("listed_state"), F.concat(F.when(F.col("s_nationkey") % 7 == 1, "*ST ").otherwise(""), "s_name").alias("name"), "s_acctbal")
    p = panel(spark, sf_dir).select("code", "trade_date", "close", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("days"), F.round(F.avg("amount").over(w.rowsBetween(-59, 0)), 4).alias("avg_amount_60"))
    grid = p.select("code").distinct().crossJoin(F.broadcast(W.week_ends(p).select(F.col("model_date").alias("decision_date"))))  # a row a week
    last = asof.asof_join(grid, p, ["code"], "decision_date", "trade_date", ["close", "days", "avg_amount_60"]).withColumnRenamed("trade_date_asof", "latest_trade_date")
    x = last.join(s, "code").withColumn("market_cap", F.when(F.col("s_acctbal") > 0, F.col("close") * F.col("s_acctbal")))
    kept = universe.quantile_floor(universe.tradable(x, F.col("decision_date"), 60, 30000.0), "market_cap", 0.2, ["decision_date"])
    return kept.select("code", "decision_date", F.round("market_cap", 1).alias("market_cap"))


@query(f"""WITH {PANEL}, r AS (SELECT code, trade_date, amount, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS history_days, avg(amount) OVER (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING) AS a FROM panel)
SELECT code, trade_date, history_days FROM r JOIN supplier ON s_suppkey = code WHERE s_acctbal > 0 AND history_days >= 126 AND round(a, 4) >= 40000 AND NOT contains(upper(s_comment_state), 'ST')""".replace("s_comment_state", "CASE WHEN s_nationkey = 3 THEN '*st' ELSE 'Norm' END"))
def risk_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.series("code")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("market_cap"), F.when(F.col("s_nationkey") == 3, "*st").otherwise("Norm").alias("listed_state"))
    p = panel(spark, sf_dir).select("code", "trade_date", F.row_number().over(w).cast("long").alias("history_days"), F.round(F.avg("amount").over(w.rowsBetween(-59, 0)), 4).alias("avg_amount_60"))
    return universe.modelled(p.join(s, "code"), 126, 40000.0).select("code", "trade_date", "history_days")


@query("""SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 4, 16) AND trim(c_mktsegment) <> ''""")
def market_type_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.market_types(table(spark, sf_dir, "customer").withColumn("market_type", F.col("c_nationkey")), [1, 4, 16], ["c_custkey", "c_mktsegment"]).select("c_custkey")


@query("""SELECT max(CASE WHEN d <= DATE '1996-03-03' THEN d END) AS as_of_0, max(CASE WHEN d <= DATE '1997-12-25' THEN d END) AS as_of_1, min(d) AS first_day, max(d) AS last_day FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def resolved_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.resolve_dates(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")), "d", "1996-03-03", "1997-12-25")


_ENDS = """e AS (SELECT max(CAST(l_shipdate AS DATE)) AS model_date FROM lineitem GROUP BY date_trunc('week', CAST(l_shipdate AS DATE) + INTERVAL 2 DAY))"""


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.week_ends(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"))).select("model_date")


@query(f"WITH {_ENDS} SELECT model_date, lag(model_date) OVER (ORDER BY model_date) AS previous_date FROM e")
def previous_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.with_previous(_ends(spark, sf_dir), "model_date")


@query(f"""WITH {_ENDS}, m AS (SELECT date_trunc('month', model_date) AS m, min(model_date) AS f FROM e GROUP BY 1), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS asked FROM orders)
SELECT asked, CASE WHEN f <= asked THEN f ELSE asked END AS decision_date FROM o LEFT JOIN m ON m = date_trunc('month', asked)""")
def first_decision_of_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("asked")).distinct()
    return universe.first_decision_of_month(_ends(spark, sf_dir), asked, "model_date", "asked")


@query("""WITH b AS (SELECT l_suppkey AS code, l_extendedprice AS open, l_extendedprice * (1 + l_tax) AS high, l_extendedprice * (1 - l_discount) AS low, l_extendedprice * (1 + l_tax - l_discount) AS close, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'G' END AS g FROM lineitem)
SELECT count(*) AS rows, count(DISTINCT code) AS codes, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS price_order_violations, count(*) FILTER (least(open, high, low, close) <= 0) AS nonpositive_prices,
       count(*) FILTER (g IS NULL) AS unknown_industry, round(avg(CAST(close IS NOT NULL AS INTEGER)), 6) AS close_coverage FROM b""")
def build_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t, d = F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), p.alias("open"), (p * (1 + t)).alias("high"), (p * (1 - d)).alias("low"), (p * (1 + t - d)).alias("close"), F.when(F.col("l_suppkey") % 7 != 0, "G").alias("industry_group"))
    return rounded(universe.build_checks(rows))


@query("""SELECT 'orders' AS name, count(*) AS rows, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders UNION ALL SELECT 'lineitem', count(*), CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE) FROM lineitem
UNION ALL SELECT 'events', count(*), CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM events""")
def database_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.status({n: (table(spark, sf_dir, n), d) for n, d in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))})


# Attachment by time


@query("""WITH o AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT c_custkey AS code, make_date(1992 + CAST(c_custkey % 6 AS INTEGER), 1, 15) AS snap, c_acctbal AS alpha FROM customer),
g AS (SELECT DISTINCT snap FROM s), j AS (SELECT o.code, o.d, (SELECT max(snap) FROM g WHERE snap < o.d AND date_diff('day', snap, o.d) <= 300) AS snap_used FROM o),
v AS (SELECT j.*, alpha FROM j LEFT JOIN s ON s.snap = snap_used AND s.code = j.code), c AS (SELECT *, avg(CAST(alpha IS NOT NULL AS INTEGER)) OVER (PARTITION BY d) AS share FROM v)
SELECT d, CASE WHEN snap_used IS NULL THEN 'no_causal_snapshot' WHEN share >= 0.2 THEN 'applied' ELSE 'partial' END AS snapshot_status, count(*) AS n, count(alpha) AS known, round(sum(alpha), 2) AS alpha FROM c GROUP BY 1, 2""")
def snapshot_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("d"))
    c = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(c.alias("code"), F.make_date((c % 6 + 1992).cast("int"), F.lit(1), F.lit(15)).alias("snap"), F.col("c_acctbal").alias("alpha"))
    out = attach.augment(o, s, "d", "snap", "code", ["alpha"], 300, 0.2)
    return out.groupBy("d", "snapshot_status").agg(F.count("*").alias("n"), F.count("alpha").alias("known"), F.round(F.sum("alpha"), 2).alias("alpha"))


@query("""WITH s AS (SELECT CAST(o_orderdate AS DATE) AS a, round(avg(o_totalprice) / 1e5, 6) AS multiplier FROM orders WHERE o_orderdate >= DATE '1994-01-01' AND day(o_orderdate) = 1 GROUP BY 1), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, coalesce(multiplier, 1.0) AS multiplier, CASE WHEN multiplier IS NULL THEN 'default' ELSE 'schedule' END AS source FROM d ASOF LEFT JOIN s ON d.d >= s.a""")
def calibration_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    s = o.where("d >= date'1994-01-01' and day(d) = 1").groupBy(F.col("d").alias("a")).agg(F.round(F.avg("o_totalprice") / 1e5, 6).alias("multiplier"))
    return attach.calibration_at(o.select("d").distinct(), s, "d", "a")


@query(f"""WITH {WEEKLY}, n AS (SELECT model_date AS exposure_date, lead(model_date) OVER (ORDER BY model_date) AS model_date FROM (SELECT DISTINCT model_date FROM weekly))
SELECT exposure_date, model_date FROM n WHERE model_date IS NOT NULL AND month(exposure_date) <= 9 AND exposure_date IN (SELECT model_date FROM weekly GROUP BY 1 HAVING count(specific_return) >= 50)""")
def forecast_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weekly_returns(spark, sf_dir)
    pairs = universe.with_previous(w, "model_date", "exposure_date").where("exposure_date is not null")
    specific = w.groupBy("model_date").agg(F.count("specific_return").alias("n")).where("n >= 50")
    return attach.forecast_pairs(pairs, w.where("month(model_date) <= 9"), specific)


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS exposure_date, o_orderpriority AS p, o_custkey AS code, o_totalprice AS weight FROM orders), r AS (SELECT c_custkey AS code, c_acctbal / 1e5 AS r FROM customer WHERE c_acctbal > -900),
g AS (SELECT exposure_date, p, sum(CASE WHEN r IS NOT NULL THEN weight END) / sum(weight) AS covered, sum(weight * r) / sum(CASE WHEN r IS NOT NULL THEN weight END) AS x, count(*) AS n FROM o LEFT JOIN r USING (code) GROUP BY 1, 2)
SELECT exposure_date, p AS portfolio_name, round(covered, 6) AS covered, round(x, 7) AS realized_weekly_return, round(n / 1e4, 6) AS predicted_weekly_variance FROM g WHERE covered >= 0.95""")
def forecast_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("exposure_date"), F.col("o_orderpriority").alias("portfolio_name"), F.col("o_custkey").alias("code"), F.col("o_totalprice").alias("weight"))
    r = table(spark, sf_dir, "customer").where("c_acctbal > -900").select(F.col("c_custkey").alias("code"), (F.col("c_acctbal") / 1e5).alias("realised_return"))
    returns = o.select("exposure_date", "code").distinct().join(r, "code")
    predicted = o.groupBy("exposure_date", "portfolio_name").agg((F.count("*") / 1e4).alias("predicted_weekly_variance"))
    out = attach.forecast_observations(o, predicted, returns)
    return out.select("exposure_date", "portfolio_name", F.round("covered", 6).alias("covered"), F.round("realized_weekly_return", 7).alias("realized_weekly_return"), F.round("predicted_weekly_variance", 6).alias("predicted_weekly_variance"))


# Scores in time


def _slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_add(W.week_key(F.to_date("o_orderdate")), 6).alias("exit_date")).agg(F.corr("o_totalprice", "o_custkey").alias("slope"))


@query("""WITH s AS (SELECT CAST(date_trunc('week', CAST(o_orderdate AS DATE) + INTERVAL 2 DAY) + INTERVAL 4 DAY AS DATE) AS e, CASE WHEN count(*) > 1 THEN corr(o_totalprice, o_custkey) END AS slope FROM orders GROUP BY 1),
r AS (SELECT e, count(slope) OVER w AS n, avg(CASE WHEN slope IS NOT NULL THEN greatest(-0.03, least(0.03, slope)) END) OVER w AS m, avg(CAST(slope > 0 AS INTEGER)) OVER w AS up FROM s WINDOW w AS (ORDER BY e ROWS 51 PRECEDING)),
d AS (SELECT max(CAST(o_orderdate AS DATE)) AS decision_date FROM orders GROUP BY date_trunc('month', o_orderdate))
SELECT decision_date, round(CASE WHEN coalesce(n, 0) >= 16 THEN least(greatest(0, m) * up, 0.03) ELSE 0.005 END, 6) + 0.0 AS expected, coalesce(n, 0) AS observations, CASE WHEN coalesce(n, 0) >= 16 THEN 'causal_realized_labels' ELSE 'fallback_warmup' END AS source
FROM d ASOF LEFT JOIN r ON decision_date >= e""")
def expected_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    d = o.groupBy(F.trunc("o_orderdate", "MM").alias("m")).agg(F.max(F.to_date("o_orderdate")).alias("decision_date"))
    out = scoring.expected_return(d, _slopes(spark, sf_dir))
    return out.withColumn("expected", F.round("expected", 6) + 0.0)


_FACTORS = ["BETA", "RESIDUAL_VOLATILITY", "LIQUIDITY", "EARNINGS_YIELD", "MOMENTUM"]


def _factor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly returns of regions under the names of factors, and of nations as industries."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    w = weekly_returns(spark, sf_dir).join(s.select(F.col("s_suppkey").alias("code"), "n_regionkey", "n_nationkey"), "code").where("specific_return is not null")
    factor = F.get(F.array(*map(F.lit, _FACTORS)), F.col("n_regionkey").cast("int"))
    out = w.groupBy("model_date", factor.alias("factor_name")).agg(F.avg("specific_return").alias("factor_return"))
    return out.union(w.groupBy("model_date", F.concat(F.lit("INDUSTRY:"), "n_nationkey").alias("factor_name")).agg(F.avg("specific_return").alias("factor_return")))


FACTOR_TABLE = f"""{WEEKLY}, fw AS (SELECT model_date, n_regionkey, n_nationkey, specific_return AS r FROM weekly JOIN supplier ON s_suppkey = code JOIN nation ON n_nationkey = s_nationkey WHERE specific_return IS NOT NULL),
ft AS (SELECT model_date, [{', '.join(f"'{x}'" for x in _FACTORS)}][n_regionkey + 1] AS factor_name, avg(r) AS factor_return FROM fw GROUP BY 1, 2 UNION ALL SELECT model_date, 'INDUSTRY:' || n_nationkey, avg(r) FROM fw GROUP BY 1, 2)"""


@query(f"""WITH {FACTOR_TABLE} SELECT factor_name, count(*) AS n, {', '.join(f'round({e}, 6) + 0.0 AS {k}' for k, e in {'mean': 'avg(factor_return)', 'sd': 'stddev_samp(factor_return)', 'least': 'min(factor_return)', 'most': 'max(factor_return)', 'annual_return': 'avg(factor_return) * 52', 'annual_volatility': 'stddev_samp(factor_return) * sqrt(52)', 'return_to_risk': 'avg(factor_return) * 52 / (stddev_samp(factor_return) * sqrt(52))'}.items())} FROM ft GROUP BY 1""")
def factor_return_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(reports.factor_summary(_factor_table(spark, sf_dir)))
    return out.select("factor_name", "n", *[(F.col(c) + 0.0).alias(c) for c in out.columns if c not in ("factor_name", "n")])


@query(f"""WITH RECURSIVE {FACTOR_TABLE},
wk AS (SELECT model_date, (0.35 * coalesce(max(CASE WHEN factor_name = 'EARNINGS_YIELD' THEN factor_return END), 0) + 0.30 * coalesce(max(CASE WHEN factor_name = 'MOMENTUM' THEN factor_return END), 0)) / 0.65
   - (-0.4 * coalesce(max(CASE WHEN factor_name = 'BETA' THEN factor_return END), 0) - 0.4 * coalesce(max(CASE WHEN factor_name = 'RESIDUAL_VOLATILITY' THEN factor_return END), 0) - 0.2 * coalesce(max(CASE WHEN factor_name = 'LIQUIDITY' THEN factor_return END), 0)) AS d FROM ft GROUP BY 1),
sg AS (SELECT model_date, row_number() OVER (ORDER BY model_date) AS p, count(*) OVER l AS n, CASE WHEN stddev_samp(d) OVER l > 1e-8 THEN tanh(avg(d) OVER l / stddev_samp(d) OVER l * sqrt(count(d) OVER l)) ELSE 0 END AS fs FROM wk WINDOW l AS (ORDER BY model_date ROWS 51 PRECEDING)),
ind AS (SELECT p, f.factor_name, factor_return AS r FROM sg CROSS JOIN (SELECT DISTINCT factor_name FROM ft WHERE factor_name LIKE 'INDUSTRY:%') f LEFT JOIN ft ON ft.model_date = sg.model_date AND ft.factor_name = f.factor_name),
br AS (SELECT p, 0.5 * avg(CAST(s > 0 AS INTEGER)) + 0.5 * avg(CAST(m > 0 AS INTEGER)) AS b FROM (SELECT p, coalesce(sum(r) OVER (PARTITION BY factor_name ORDER BY p ROWS 3 PRECEDING), 0) AS s, coalesce(sum(r) OVER (PARTITION BY factor_name ORDER BY p ROWS 11 PRECEDING), 0) AS m FROM ind) GROUP BY 1),
st AS (SELECT model_date, n, fs, greatest(-1, least(1, (b - 0.5) * 2)) AS si FROM sg JOIN br USING (p)),
mo AS (SELECT CAST(unnest(generate_series(date_trunc('month', (SELECT min(model_date) FROM ft)), date_trunc('month', (SELECT max(model_date) FROM ft)) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month),
k1 AS (SELECT month, coalesce(n, 0) AS observations, CASE WHEN n >= 26 THEN fs ELSE 0 END AS factor_signal, CASE WHEN n >= 26 THEN si ELSE 0 END AS industry_signal FROM mo ASOF LEFT JOIN st ON mo.month > st.model_date),
k2 AS (SELECT *, 0.7 * factor_signal + 0.3 * industry_signal AS combined, row_number() OVER (ORDER BY month) AS q FROM k1),
k3 AS (SELECT *, least(0.7, greatest(0.3, 0.5 + 0.2 * combined)) AS wanted FROM k2),
rec AS (SELECT q, greatest(0.5 - 0.05, least(0.5 + 0.05, wanted)) AS lv FROM k3 WHERE q = 1 UNION ALL SELECT k3.q, greatest(lv - 0.05, least(lv + 0.05, wanted)) FROM rec JOIN k3 ON k3.q = rec.q + 1)
SELECT month, round(lv, 5) AS offensive_weight, round(factor_signal, 5) + 0.0 AS factor_signal, round(industry_signal, 5) + 0.0 AS industry_signal, round(combined, 5) + 0.0 AS combined, observations FROM k3 JOIN rec USING (q)""")
def monthly_factor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(scoring.monthly_factor_state(_factor_table(spark, sf_dir)), 5)
    return out.select("month", "offensive_weight", *[(F.col(c) + 0.0).alias(c) for c in ("factor_signal", "industry_signal", "combined")], "observations")


# Rules of trading and text


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, CASE WHEN l_returnflag = 'A' THEN 'ENTRY' WHEN l_returnflag = 'R' THEN 'EXIT' ELSE 'ADJUST' END AS t, CASE WHEN l_linestatus = 'F' THEN 'SELL' ELSE 'BUY' END AS side, l_discount * 10 AS c, l_tax * 10 AS g FROM lineitem),
f AS (SELECT *, CASE t WHEN 'EXIT' THEN 0 WHEN 'ENTRY' THEN greatest(3000, v * 0.05) ELSE greatest(2000, v * 0.03) END AS floor FROM l)
SELECT l_orderkey, l_linenumber, round(floor, 4) AS floor, round(coalesce(least(floor, CASE WHEN side = 'SELL' AND c > g + 0.05 THEN v * 0.01 WHEN side = 'BUY' AND c < g - 0.05 THEN v * 0.02 END), floor), 4) AS relaxed, abs(c - g) > 0.05 AS forced, c > g + 0.05 AS unscheduled, 5 / 0.0015 AS commission_floor FROM f""")
def trade_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c, g = F.col("l_extendedprice"), F.col("l_discount") * 10, F.col("l_tax") * 10
    kind = F.when(F.col("l_returnflag") == "A", "ENTRY").when(F.col("l_returnflag") == "R", "EXIT").otherwise("ADJUST")
    side = F.when(F.col("l_linestatus") == "F", "SELL").otherwise("BUY")
    floor = T.trade_floor(kind, v, 2000.0, 3000.0, 0.03, 0.05)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(floor, 4).alias("floor"), F.round(T.risk_floor(floor, v, side, c, g, 0.05, 0.01, 0.02), 4).alias("relaxed"),
        scoring.forces_alignment(c, g, 0.05, "strict").alias("forced"), scoring.unscheduled_rebalance(c, g, 0.05, "daily").alias("unscheduled"), F.lit(T.commission_floor(5.0, 0.0015)).alias("commission_floor"),
    )


@query("""WITH e AS (SELECT event_id, value AS c, value * (1 + (event_id % 11 - 5) / 100.0) AS o, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM events),
l AS (SELECT *, c * CASE WHEN side = 'BUY' THEN 1 + 0.02 + 0.001 ELSE 1 - 0.02 - 0.001 END AS raw FROM e), t AS (SELECT *, CASE WHEN side = 'BUY' THEN ceil(raw * 100 - 1e-8) / 100 ELSE floor(raw * 100 + 1e-8) / 100 END AS lim FROM l)
SELECT event_id, round(lim, 2) AS auction_limit, CASE WHEN side = 'BUY' THEN o <= round(lim, 2) ELSE o >= round(lim, 2) END AS marketable FROM t""")
def auction_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    side = F.when(i % 2 == 0, "BUY").otherwise("SELL")
    limit = F.round(T.auction_limit(v, F.lit(-0.02), F.lit(0.02), side, 10.0), 2)
    return table(spark, sf_dir, "events").select("event_id", limit.alias("auction_limit"), T.marketable(side, limit, v * (1 + (i % 11 - 5) / 100.0)).alias("marketable"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0 THEN l_extendedprice * 100 / (l_tax * 100) END, 4) AS implied_cap, round(coalesce(CASE WHEN l_extendedprice > 0 AND l_quantity > 0 AND l_tax > 0 THEN l_tax * l_quantity / l_extendedprice * 100 END, l_discount * 100), 6) AS turnover,
CASE WHEN l_returnflag = 'R' THEN 'UNKNOWN' ELSE l_returnflag END AS grp, round(CASE WHEN abs(l_discount) > 1e-12 THEN l_tax / l_discount END, 6) AS ratio FROM lineitem""")
def market_value_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, t, d = (F.col(c) for c in ("l_extendedprice", "l_quantity", "l_tax", "l_discount"))
    group = C.unknown_group(F.when(F.col("l_returnflag") == "R", " nan ").otherwise(F.col("l_returnflag")))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(C.turnover_cap(p, t * 100), 4).alias("implied_cap"), F.round(C.turnover_percent(t, F.when(t > 0, q), p, d), 6).alias("turnover"), group.alias("grp"), F.round(C.safe_ratio(t, d), 6).alias("ratio"),
    )


@query("""WITH x AS (SELECT p_partkey, p_retailprice AS a, p_retailprice * (1 + (p_size % 3) * 0.003) AS b, CASE WHEN p_size % 4 = 0 THEN p_retailprice END AS c FROM part)
SELECT p_partkey, round(coalesce(c, CASE WHEN greatest(a, b) <= least(a, b) * 1.005 THEN (a + b) / 2 END), 2) AS price FROM x""")
def agreed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", C.agreed_price(F.when(F.col("p_size") % 4 == 0, p), F.array(p, p * (1 + (F.col("p_size") % 3) * 0.003))).alias("price"))


@query(r"""WITH c AS (SELECT c_custkey, c_name AS n, c_mktsegment || '[' || c_nationkey || ']:' || c_name || '/' || c_name AS s, CASE c_nationkey % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN '0.0' WHEN 2 THEN '3' ELSE 'no' END AS f FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(trim(n), '[A-Za-z0-9][A-Za-z0-9._-]{0,63}') THEN trim(n) END AS account, substr(regexp_replace(s, '[\[\]:*?/\\]', '_', 'g'), 1, 31) AS sheet, regexp_replace(n, '[^0-9a-zA-Z]+', '', 'g') AS header, CASE WHEN trim(f) IN ('Yes', '3') THEN 1 ELSE 0 END AS corrected FROM c""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_name")
    s = F.concat("c_mktsegment", F.lit("["), "c_nationkey", F.lit("]:"), n, F.lit("/"), n)
    k = F.col("c_nationkey") % 4
    f = F.when(k == 0, " Yes").when(k == 1, "0.0").when(k == 2, "3").otherwise("no")
    return table(spark, sf_dir, "customer").select("c_custkey", C.account_id(n).alias("account"), C.sheet_name(s).alias("sheet"), C.header(n).alias("header"), C.correction(f).alias("corrected"))


@query("""SELECT CAST(o_orderdate AS DATE) AS d, coalesce(max(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END), max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), max(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END)) AS v FROM orders GROUP BY 1""")
def market_return_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d"))
    return o.agg(C.by_priority(F.col("o_orderpriority"), F.col("o_totalprice"), ["2-HIGH", "1-URGENT", "5-LOW"]).alias("v"))


# Holdings, summaries and satellites


@query("""WITH p AS (SELECT o_custkey AS code, sum(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(v) AS t FROM p)
SELECT c_mktsegment AS industry_group, count(*) AS stock_count, round(sum(v), 2) AS market_value, round(sum(v / t), 8) AS portfolio_weight FROM p JOIN customer ON c_custkey = code, t GROUP BY 1""")
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.sum("o_totalprice").alias("market_value"))
    total = p.agg(F.sum("market_value").alias("t"))
    h = p.crossJoin(F.broadcast(total)).withColumn("weight", F.col("market_value") / F.col("t"))  # one row
    h = h.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("industry_group")), "code")
    out = reports.group_rollup(h, "industry_group")
    return out.select("industry_group", "stock_count", F.round("market_value", 2).alias("market_value"), F.round("portfolio_weight", 8).alias("portfolio_weight"))


@query("""WITH s AS (SELECT l_returnflag, 1e6 AS c, sum(l_tax * l_extendedprice) AS f, sum(l_extendedprice) AS g, sum(l_discount * l_tax * l_extendedprice) AS k FROM lineitem GROUP BY 1) SELECT l_returnflag, round(f / c, 6) AS fees_pct_initial_cash, round(g / c, 6) AS gross_traded_multiple, round(k / f, 6) AS commission_pct_total_fees FROM s""")
def derived_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = F.col("l_extendedprice"), F.col("l_tax")
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.lit(1e6).alias("initial_cash"), F.sum(t * p).alias("total_fees"), F.sum(p).alias("total_gross_traded"), F.sum(F.col("l_discount") * t * p).alias("commission"))
    return rounded(reports.derived_metrics(s).select("l_returnflag", "fees_pct_initial_cash", "gross_traded_multiple", "commission_pct_total_fees"))


@query("""WITH l AS (SELECT l_orderkey AS line, CASE WHEN l_linenumber = 7 THEN 'CASH' ELSE CAST(l_partkey AS VARCHAR) END AS code, l_quantity AS shares, l_returnflag AS name, l_extendedprice AS cost_price, l_extendedprice AS k FROM lineitem)
SELECT code, round(sum(shares), 2) AS shares, arg_max(name, k) AS name, round(arg_max(cost_price, k), 2) AS cost_price FROM l WHERE code <> 'CASH' GROUP BY 1 UNION ALL SELECT 'CASH', NULL, NULL, round(sum(cost_price), 2) FROM l WHERE code = 'CASH' HAVING count(*) > 0""")
def position_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("l_linenumber") == 7, "CASH").otherwise(F.col("l_partkey").cast("string"))
    l = table(spark, sf_dir, "lineitem").select(code.alias("code"), F.col("l_quantity").alias("shares"), F.col("l_returnflag").alias("name"), F.col("l_extendedprice").alias("cost_price"), F.col("l_extendedprice").alias("line"))
    return rounded(aggregates.positions(l), 2)


@query(f"""WITH {CROSS}, g AS (SELECT code, date, CASE WHEN code % 4 <> 0 THEN amount END AS v, industry_group FROM cross_section)
SELECT code, date, round(coalesce(v, median(v) OVER (PARTITION BY date, industry_group), median(v) OVER (PARTITION BY date)), 4) AS filled, round(v - avg(v) OVER (PARTITION BY date), 4) AS demeaned FROM g""")
def filled_and_demeaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("code") % 4 != 0, F.col("amount"))
    x = cross_section(spark, sf_dir)
    return x.select("code", "date", F.round(crosssection.fill_median(v, ["date"], "industry_group"), 4).alias("filled"), F.round(v - F.avg(v).over(Window.partitionBy("date")), 4).alias("demeaned"))


@query(f"""WITH {CROSS}, z AS (SELECT code, date, industry_group, size, momentum, CASE WHEN industry_group IN ('Brand#11', 'Brand#22', 'Brand#33') THEN 0.5 ELSE 0 END AS s FROM cross_section),
c AS (SELECT *, coalesce((size - avg(size) OVER d) / stddev_samp(size) OVER d, 0) AS a, coalesce((momentum - avg(momentum) OVER d) / stddev_samp(momentum) OVER d, 0) AS b FROM z WINDOW d AS (PARTITION BY date))
SELECT code, date, round(0.4 * s * 0.8, 6) AS satellite_weight, round((1 - 0.32 * s) * a + 0.32 * s * b, 5) + 0.0 AS score FROM c""")
def satellite_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cross_section(spark, sf_dir)
    s = x.where(F.col("industry_group").isin("Brand#11", "Brand#22", "Brand#33")).select("date", "industry_group").distinct().withColumn("strength", F.lit(0.5))
    out = scoring.blend_satellite(x, s, "date", "industry_group", "size", "momentum", 0.4, F.lit(0.8))
    return out.select("code", "date", F.round("satellite_weight", 6).alias("satellite_weight"), (F.round("score", 5) + 0.0).alias("score"))


@query("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, avg(o_totalprice) / 1e6 - 0.14 AS g, avg(o_custkey % 100) / 100.0 AS breadth, stddev_samp(o_totalprice) / 1e6 AS vol FROM orders GROUP BY 1),
t AS (SELECT *, greatest(-1, least(1, 0.35 * greatest(-1, least(1, g / 0.05)) + 0.45 * greatest(-1, least(1, g / 0.1)) + 0.0 + 0.20 * greatest(-1, least(1, (breadth - 0.5) / 0.2)))) AS trend FROM m)
SELECT m, round(trend, 6) + 0.0 AS trend, round(CASE WHEN trend < 0 THEN CASE WHEN g <= -0.06 THEN least(raw, 0.5) ELSE least(raw, 0.7) END ELSE raw END, 6) AS equity_target, round(least(greatest(0, least(1, g / 0.05)), greatest(0, least(1, breadth / 0.05))), 6) AS risk_on
FROM (SELECT *, greatest(0.2, least(0.95, 0.95 * greatest(0.5, least(1.2, 0.18 / greatest(vol, 1e-6))) * (1 + 0.3 * trend))) AS raw FROM t)""".replace("g / 0.1))", "g / 0.05))").replace(" + 0.0 + 0.20", " + 0.20"))
def risk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(F.trunc("o_orderdate", "MM").alias("m")).agg((F.avg("o_totalprice") / 1e6 - 0.14).alias("g"), (F.avg(F.col("o_custkey") % 100) / 100.0).alias("breadth"), (F.stddev_samp("o_totalprice") / 1e6).alias("volatility"))
    m = m.withColumns({"short_gap": F.col("g"), "long_gap": F.col("g"), "return_20": F.col("g")})
    out = scoring.equity_target(m, 0.95, 0.18, 0.2)
    return out.select("m", (F.round("trend", 6) + 0.0).alias("trend"), F.round("equity_target", 6).alias("equity_target"), F.round(scoring.risk_on_strength(F.col("g"), F.col("breadth")), 6).alias("risk_on"))


@query(f"""WITH {CROSS}, r AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY amount + CASE WHEN code % 5 = 0 THEN 5000 ELSE 0 END DESC, code) AS k FROM cross_section) SELECT date, code FROM r WHERE k <= 40""")
def cost_aware_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cross_section(spark, sf_dir).withColumn("held", F.col("code") % 5 == 0)
    return scoring.keep_or_replace(x, "date", "amount", 5000.0, 40).select("date", "code")


@query(f"""WITH {CROSS}, p AS (SELECT date, size AS f, momentum AS c, forward_return AS y FROM cross_section WHERE size IS NOT NULL AND momentum IS NOT NULL AND forward_return IS NOT NULL),
s AS (SELECT date, count(*) AS n, var_pop(f) AS ff, var_pop(c) AS cc, covar_pop(f, c) AS fc, covar_pop(f, y) AS fy, covar_pop(c, y) AS cy FROM p GROUP BY 1)
SELECT date, round((fy * cc - cy * fc) / (ff * cc - fc * fc) * sqrt(ff), 5) + 0.0 AS slope FROM s WHERE n >= 80""")
def partial_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouped regression; the oracle has its normal equations for one control."""
    out = evaluate.partial_slopes(cross_section(spark, sf_dir), "size", ["momentum"])
    return out.select("date", (F.round("slope", 5) + 0.0).alias("slope"))


@query(f"""WITH {WEEKLY}, c AS (SELECT code, model_date, specific_return AS r FROM weekly WHERE specific_return IS NOT NULL), x AS (SELECT DISTINCT model_date FROM c)
SELECT x.model_date AS decision_date, count(*) AS matured, round(avg(r), 6) + 0.0 AS mean_return FROM x JOIN c ON c.model_date < x.model_date AND c.model_date >= x.model_date - INTERVAL 28 DAY GROUP BY 1""")
def trailing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that ended in the four weeks before each decision, by a range of days over one row a week."""
    w = weekly_returns(spark, sf_dir).where("specific_return is not null").groupBy("model_date").agg(F.sum("specific_return").alias("s"), F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.unix_date("model_date")).rangeBetween(-28, -1)  # a row a week
    out = w.select(F.col("model_date").alias("decision_date"), F.sum("n").over(order).alias("matured"), (F.round(F.sum("s").over(order) / F.sum("n").over(order), 6) + 0.0).alias("mean_return"))
    return out.where("matured > 0")


@query(f"""WITH {PANEL}, f AS (SELECT code, trade_date, close, row_number() OVER (PARTITION BY code ORDER BY trade_date) - 1 AS k FROM panel) SELECT code, max(trade_date) AS last_day, round(sum(close * pow(0.5, (n - k) / 30.0)) / sum(pow(0.5, (n - k) / 30.0)), 4) AS ewma_close
FROM (SELECT *, max(k) OVER (PARTITION BY code) AS n FROM f) WHERE n - k < 60 GROUP BY 1""")
def ewma_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of ages as the library makes them, on the last 60 rows of a code."""
    w = F.array(*[F.lit(x) for x in W.ewma_weights(60, 30.0)])
    rows = W.tail(panel(spark, sf_dir), 60).withColumn("_age", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("trade_date"))))
    rows = rows.withColumn("w", F.element_at(w, -F.col("_age")))
    return rows.groupBy("code").agg(F.max("trade_date").alias("last_day"), F.round(F.sum(F.col("w") * F.col("close")) / F.sum("w"), 4).alias("ewma_close"))

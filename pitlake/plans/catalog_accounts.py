"""Named queries with SQL oracles: ingestion, classifications in time, accounts, risk of weeks, alpha inputs and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlake.functions import columns as C
from pitlake.functions import trading as T
from pitlake.operators import adjust, alpha, asof, evaluate, gaps, orders, portfolio, reports, risk, scoring
from pitlake.operators import windows as W
from pitlake.operators.staging import staged
from pitlake.plans.catalog import WEEKLY, _SCHEDULE, query, rounded, weekly_returns
from pitlake.plans.views import CROSS, PANEL, cross_section, panel, table
from pitlake.sources import manifest, panels, reference, states, upsert
from pitlake.streaming import incremental, maturing

# Ingestion


_REFERENCE = reference.Reference(
    "customer",
    {"code": ("code", ("Stkcd",)), "listed": ("date", ("ListDate",)), "capital": ("float", ()), "shares": ("int", ()), "segment": ("text", ()), "corrected": ("flag", ()), "absent": ("text", ())},
    key=("code",), required=("listed",), order=("listed",), rules={"no capital left": "capital < 0"},
)


def _raw_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a text export: several rows with one code, dates in two forms, thousands separators, blanks."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    written = F.when(n == 5, "n/a").when(n % 2 == 0, F.date_format(F.make_date(1990 + n % 9, F.lit(3), F.lit(7)), "yyyy/MM/dd")).otherwise(F.date_format(F.make_date(1990 + n % 9, F.lit(3), F.lit(8)), "yyyyMMdd"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.floor(k / 3).cast("string"), F.lit(".0")).alias(" STKCD "), written.alias("listdate"), F.format_number("c_acctbal", 2).alias("capital"), F.concat(k.cast("string"), F.lit(".7")).alias("shares"),
        F.when(n == 7, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("Segment"), F.when(n < 10, "Yes").otherwise("0").alias("corrected"),
    )


_PARSED = """r AS (SELECT lpad(CAST(c_custkey // 3 AS VARCHAR), CAST(greatest(6, length(CAST(c_custkey // 3 AS VARCHAR))) AS INTEGER), '0') AS code, CASE WHEN c_nationkey <> 5 THEN make_date(1990 + c_nationkey % 9, 3, CASE WHEN c_nationkey % 2 = 0 THEN 7 ELSE 8 END) END AS listed,
  round(c_acctbal, 2) AS capital, c_custkey AS shares, CASE WHEN c_nationkey <> 7 THEN c_mktsegment END AS segment, CASE WHEN c_nationkey < 10 THEN 1 ELSE 0 END AS corrected FROM customer)"""


@query(f"""WITH {_PARSED} SELECT code, listed, capital, shares, segment, corrected, CAST(NULL AS VARCHAR) AS absent FROM r WHERE listed IS NOT NULL AND capital >= 0
QUALIFY row_number() OVER (PARTITION BY code ORDER BY listed DESC, capital DESC, shares DESC, segment DESC NULLS LAST, corrected DESC) = 1""")
def reference_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.load_reference(_raw_reference(spark, sf_dir), _REFERENCE)


@query(f"""WITH {_PARSED} SELECT CASE WHEN listed IS NULL THEN 'no listed' WHEN capital < 0 THEN 'no capital left' ELSE 'accepted' END AS reason, count(*) AS n FROM r GROUP BY 1""")
def reference_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reference.parsed(_raw_reference(spark, sf_dir), _REFERENCE)
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT CASE WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice END AS close, CASE WHEN l_returnflag = 'R' THEN 'USD' ELSE 'CNY' END AS cur, CASE WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN 'Halted' ELSE 'Norm' END AS st FROM lineitem)
SELECT CASE WHEN close IS NULL THEN 'missing essential' WHEN cur <> 'CNY' THEN 'not CNY' WHEN st <> 'Norm' THEN 'not listed' ELSE 'accepted' END AS reason, count(*) AS n, round(sum(close), 2) AS total FROM r GROUP BY 1""")
def cleaned_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    raw = table(spark, sf_dir, "lineitem").select(
        F.concat(F.col("l_suppkey").cast("string"), F.lit(".0")).alias("code"), F.date_format("l_shipdate", "yyyy/MM/dd").alias("trade_date"), F.when(n == 5, "--").otherwise(F.col("l_extendedprice").cast("string")).alias("close"),
        F.when(F.col("l_returnflag") == "R", "USD").otherwise(" CNY ").alias("currency"), F.when((F.col("l_linestatus") == "F") & (n == 2), "Halted").otherwise("Norm").alias("listed_state"),
    )
    return panels.clean_daily(raw).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("total"))


@query("""WITH o AS (SELECT c_custkey AS code, make_date(1996 + c_nationkey % 4, 6, 30) AS d, c_mktsegment AS segment, c_acctbal AS v FROM customer), n AS (SELECT o_custkey AS code, max(CAST(o_orderdate AS DATE)) AS d, CASE WHEN max(o_totalprice) > 200000 THEN max(o_orderpriority) END AS segment, max(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT coalesce(o.code, n.code) AS code, greatest(coalesce(o.d, n.d), coalesce(n.d, o.d)) AS d, CASE WHEN n.d IS NOT NULL AND (o.d IS NULL OR n.d >= o.d) THEN coalesce(n.segment, o.segment) ELSE o.segment END AS segment, CASE WHEN n.d IS NOT NULL AND (o.d IS NULL OR n.d >= o.d) THEN n.v ELSE o.v END AS v FROM o FULL JOIN n ON o.code = n.code""")
def dimension_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.make_date(1996 + F.col("c_nationkey") % 4, F.lit(6), F.lit(30)).alias("d"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("v"))
    best = F.max("o_totalprice")
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.max(F.to_date("o_orderdate")).alias("d"), F.when(best > 200000, F.max("o_orderpriority")).alias("segment"), best.alias("v"))
    return upsert.update_dimension(old, new, "code", "d", ["segment"])


@query("""SELECT c_name AS source_file, c_custkey AS size, c_nationkey AS mtime FROM customer WHERE c_acctbal < 0 OR c_nationkey = 3""")
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    found = c.select(F.col("c_name").alias("source_file"), F.col("c_custkey").alias("size"), F.col("c_nationkey").alias("mtime"))
    size = F.col("c_custkey") + (F.col("c_nationkey") == 3).cast("int")
    done = c.select(F.col("c_name").alias("source_file"), size.alias("size"), F.col("c_nationkey").alias("mtime"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("complete").alias("status"))
    return upsert.changed_sources(found, done)


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, round(sum(CASE WHEN o_orderdate < DATE '1998-07-01' THEN o_totalprice ELSE o_totalprice * 2 END), 2) AS total FROM orders GROUP BY 1""")
def cutover_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    both = upsert.union_at_cutover(o, o.withColumn("v", F.col("v") * 2), "d", "1998-07-01")
    return both.groupBy(F.year("d").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query(f"""WITH {PANEL} SELECT count(*) AS overlap, count(*) FILTER (s_acctbal < 0) AS mismatched FROM panel JOIN supplier ON s_suppkey = code""")
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).select("code", "trade_date", "close")
    fresh = p.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), "s_acctbal"), "code")
    return panels.overlap_report(p, fresh.select("code", "trade_date", F.when(F.col("s_acctbal") < 0, F.col("close") + 1).otherwise(F.col("close")).alias("close")))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal * 1e4 WHEN s_nationkey > 0 THEN s_nationkey * 1e6 END AS cap FROM supplier""")
def first_positive_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("other", F.col("s_nationkey") * 100.0)
    return panels.first_positive_cap(s, ["s_acctbal", "other"], 1e4).select("s_suppkey", "cap")


@query("""WITH l AS (SELECT CAST(o_orderdate AS DATE) AS exit_date, o_totalprice AS v FROM orders) SELECT exit_date <= DATE '1998-06-30' AS known, count(*) AS n, round(sum(v), 2) AS total FROM l GROUP BY 1""")
def matured_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("exit_date"), F.col("o_totalprice").alias("v"))
    known, waiting = maturing.matured(rows, "1998-06-30")
    total = lambda df, k: df.agg(F.lit(k).alias("known"), F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total")).where("n > 0")
    return total(known, True).union(total(waiting, False))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY 1, 2""")
def daily_event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermarked aggregate on a bounded table, where nothing comes late; days are those of the session's time zone."""
    out = incremental.late_events(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "ts", "2 days", ["event_type"])
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n", F.round("value", 3).alias("value"))


# Classifications and events in time


@query("""WITH h AS (SELECT l_suppkey AS code, l_returnflag AS c, year(l_shipdate) AS y, CAST(min(l_shipdate) AS DATE) + 200 AS d, 'K' || (count(*) % 10) || count(*) AS k FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT code, c, CASE WHEN c = 'R' THEN greatest(d, DATE '1997-06-01') ELSE d END AS d, max(k) AS k FROM h GROUP BY 1, 2, 3), q AS (SELECT DISTINCT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS day FROM lineitem),
r AS (SELECT q.*, g.k AS k1 FROM q ASOF LEFT JOIN (SELECT * FROM g WHERE c = 'R') g ON g.code = q.code AND q.day >= g.d), n AS (SELECT r.*, g.k AS k2 FROM r ASOF LEFT JOIN (SELECT * FROM g WHERE c = 'N') g ON g.code = r.code AND r.day >= g.d)
SELECT code, day, coalesce(substr(k1, 1, 2), substr(k2, 1, 2), 'UNKNOWN') AS industry_group FROM n""")
def industry_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    n = F.count("*")
    h = l.groupBy(F.col("l_suppkey").alias("code"), F.col("l_returnflag").alias("classification_id"), F.year("l_shipdate").alias("y")).agg(F.date_add(F.to_date(F.min("l_shipdate")), 200).alias("implement_date"), F.concat(F.lit("K"), (n % 10).cast("string"), n.cast("string")).alias("industry_code"))
    q = l.select(F.col("l_suppkey").alias("code"), F.to_date(F.trunc("l_shipdate", "MM")).alias("day")).distinct()
    return asof.prioritised_group_asof(q, h, "code", "day", [("R", "1997-06-01"), ("N", None)], 2)


@query("""WITH c AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE isodow(l_shipdate) <= 5), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, day AS effective_date FROM o ASOF LEFT JOIN c ON o.d < c.day""")
def effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).where("weekday(trade_date) < 5")
    return asof.next_trading_day(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", days).select("o_orderkey", "effective_date")


@query("""WITH e AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS eff, CAST(year(l_shipdate) - l_linenumber % 3 AS INTEGER) AS period, round(l_extendedprice, 2) AS v FROM lineitem), q AS (SELECT DISTINCT l_suppkey AS code, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS day FROM lineitem),
b AS (SELECT q.code, q.day, max({'p': period, 'e': eff, 'v': v}) AS best FROM q JOIN e ON e.code = q.code AND e.eff <= q.day GROUP BY 1, 2)
SELECT code, day, best.p AS period, best.v AS v FROM b""")
def newest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    e = l.select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("eff"), (F.year("l_shipdate") - F.col("l_linenumber") % 3).alias("period"), F.round("l_extendedprice", 2).alias("v"))
    q = l.select(F.col("l_suppkey").alias("code"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("day")).distinct()
    return asof.newest_period_asof(q, e, ["code"], "day", "eff", "period", ["v"]).select("code", "day", "period", "v").where("period is not null")


@query("""SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R') AND CAST(o_orderdate AS DATE) IN (SELECT CAST(ts AS DATE) FROM events UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'A')""")
def usable_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"), "l_returnflag")
    third = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).union(l.where("l_returnflag = 'A'").select("d"))
    return asof.usable_snapshots(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")), "d", l.where("l_returnflag = 'R'"), third)


# Accounts


_ACCOUNT = f"""{PANEL}, last AS (SELECT code, arg_max(close, trade_date) AS close FROM panel JOIN supplier ON s_suppkey = code WHERE s_acctbal > 0 GROUP BY 1),
pos AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS code, 100.0 * (1 + s_nationkey) AS shares, abs(s_acctbal) / 10 + 1 AS cost_price FROM supplier UNION ALL SELECT NULL, 'CASH', NULL, 250000.0),
val AS (SELECT pos.k, pos.code, shares, coalesce(close, cost_price) AS price, CASE WHEN pos.code = 'CASH' THEN cost_price ELSE shares * coalesce(close, cost_price) END AS v FROM pos LEFT JOIN last ON last.code = pos.k),
acc AS (SELECT *, v / sum(v) OVER () AS weight FROM val)"""


def _account(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    held = s.select(F.col("s_suppkey").cast("string").alias("code"), (100.0 * (1 + F.col("s_nationkey"))).alias("shares"), (F.abs("s_acctbal") / 10 + 1).alias("cost_price"))
    cash = spark.range(1).select(F.lit("CASH").alias("code"), F.lit(None).cast("double").alias("shares"), F.lit(250000.0).alias("cost_price"))
    prices = panel(spark, sf_dir).join(s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("code")), "code", "left_semi").withColumn("code", F.col("code").cast("string"))
    return reports.account_weights(held.union(cash), prices)


@query(f"""WITH {_ACCOUNT} SELECT code, shares, round(price + 1e-7, 4) AS price, round(v, 2) AS value, round(weight, 8) AS weight FROM acc""")
def account_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _account(spark, sf_dir).select("code", "shares", F.round(F.col("price") + 1e-7, 4).alias("price"), F.round("value", 2).alias("value"), F.round("weight", 8).alias("weight"))


def _performance(name: str, where: str) -> str:
    return f"""{name}v AS (SELECT code, trade_date, close, close / lag(close) OVER (PARTITION BY code ORDER BY trade_date) - 1 AS r, close / max(close) OVER (PARTITION BY code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM panel WHERE {where}),
{name} AS (SELECT code, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 AS total_return, count(r) AS days, stddev_samp(r) * sqrt(244) AS volatility, avg(r) AS m, min(dd) AS max_drawdown FROM {name}v GROUP BY 1)"""


@query(f"""WITH {PANEL}, {_performance('a', 'true')}, {_performance('b', "trade_date >= DATE '1998-01-01'")}
SELECT a.code, round(a.total_return, 5) AS total_return, a.days, round(a.volatility, 5) AS volatility, round(a.max_drawdown, 5) AS max_drawdown, round(pow(1 + a.total_return, 244.0 / a.days) - 1, 5) AS annual_return, round(a.m * 244 / a.volatility, 5) AS sharpe,
       round(b.total_return, 5) AS holdout_total_return, b.days AS holdout_days, round(b.volatility, 5) AS holdout_volatility, round(b.max_drawdown, 5) AS holdout_max_drawdown, round(pow(1 + b.total_return, 244.0 / b.days) - 1, 5) AS holdout_annual_return, round(b.m * 244 / b.volatility, 5) AS holdout_sharpe
FROM a LEFT JOIN b ON a.code = b.code""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    equity = panel(spark, sf_dir).select("code", "trade_date", F.col("close").alias("equity"))
    return rounded(reports.compare_runs(equity, ["code"], "1998-01-01"), 5)


@query(f"""WITH {PANEL}, p AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS before, daily_return / 2 AS cr FROM panel), f AS (SELECT *, (1 + cr) * before / close AS f FROM p)
SELECT code, trade_date, round(CASE WHEN f BETWEEN 0.1 AND 10 AND abs(f - 1) >= 0.02 THEN f ELSE 1.0 END, 6) AS factor, round(coalesce(before * (daily_return - cr) * 100, 0) + 1e-5, 3) + 0.0 AS cash FROM f""")
def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumns({"before": F.lag("close").over(W.series("code")), "cr": F.col("daily_return") / 2})
    cash = T.action_cash(F.col("before"), F.col("daily_return"), F.col("cr"), F.lit(100.0))
    return p.select("code", "trade_date", F.round(T.share_factor(F.col("cr"), F.col("before"), F.col("close")), 6).alias("factor"), (F.round(cash + 1e-5, 3) + 0.0).alias("cash"))


# Risk of weeks, alpha inputs, selection


@query(f"""WITH {WEEKLY}, r AS (SELECT code, model_date, specific_return AS x, row_number() OVER (PARTITION BY code ORDER BY model_date) AS n FROM weekly WHERE specific_return IS NOT NULL), g AS (SELECT *, pow(2.0, n / 26.0) AS w FROM r),
s AS (SELECT code, model_date, n, sum(w) OVER p AS s, sum(w * x) OVER p AS sx, sum(w * x * x) OVER p AS sxx FROM g WINDOW p AS (PARTITION BY code ORDER BY model_date ROWS UNBOUNDED PRECEDING)),
v AS (SELECT s.*, 'R' || (s_nationkey % 5) AS industry_group, (sxx / s - pow(sx / s, 2)) * 52 AS v FROM s JOIN supplier ON s_suppkey = code WHERE n >= 20)
SELECT code, model_date, industry_group, round(0.8 * v + 0.2 * median(v) OVER (PARTITION BY model_date, industry_group), 5) AS specific_variance FROM v""")
def specific_variance_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weekly_returns(spark, sf_dir).select("code", "model_date", F.col("specific_return").alias("value"))
    groups = w.select("code", "model_date").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.concat(F.lit("R"), F.col("s_nationkey") % 5).alias("industry_group")), "code")
    return rounded(risk.specific_variance_by_date(w, groups, 26.0), 5)


_PARTS = ["roe", "conv", "accr", "lev"]


@query(f"""WITH {CROSS}, i AS (SELECT code, date, industry_group, amount * (value_style - 0.0312345) AS profit, CASE WHEN n > 1 THEN amount * (momentum - 0.0212345) END AS cash, CASE WHEN n < 9 THEN cap * 30 END AS tcap, CASE WHEN size > 20 THEN cap * 20 END AS fcap, cap * size AS assets, amount / 3 AS liab, cap * (size - 10) AS equity, forward_return AS rg, CASE WHEN n > 2 THEN forward_return * 2 END AS eg FROM cross_section),
p AS (SELECT *, CASE WHEN tcap > 1e-12 THEN profit / tcap END AS ep, CASE WHEN tcap > 1e-12 THEN cash / tcap END AS cp, CASE WHEN equity > 1e-12 THEN profit / equity END AS roe, CASE WHEN cash IS NOT NULL THEN greatest(-3.0, least(3.0, cash / abs(profit))) END AS conv, (profit - cash) / assets AS accr, liab / assets AS lev,
  CASE WHEN fcap > 0 THEN fcap WHEN tcap > 0 THEN tcap ELSE 0 END AS mc FROM i),
m AS (SELECT *, {', '.join(f'median({c}) OVER d AS {c}_m, count({c}) OVER d AS {c}_n, avg({c}) OVER d AS {c}_a, stddev_samp({c}) OVER d AS {c}_s' for c in _PARTS)}, sum(mc) OVER (PARTITION BY date, industry_group) / sum(mc) OVER d AS mw FROM p WINDOW d AS (PARTITION BY date)),
a AS (SELECT *, {', '.join(f'median(abs({c} - {c}_m)) OVER (PARTITION BY date) AS {c}_d' for c in _PARTS)} FROM m),
z AS (SELECT *, {', '.join(f'CASE WHEN {c}_n >= 20 AND {c} IS NOT NULL THEN greatest(-5.0, least(5.0, CASE WHEN {c}_d > 1e-12 THEN ({c} - {c}_m) / (1.4826 * {c}_d) WHEN {c}_s > 1e-12 THEN ({c} - {c}_a) / {c}_s END)) END AS {c}_z' for c in _PARTS)} FROM a)
SELECT code, date AS model_date, round(mw, 8) AS market_industry_weight,
 round((coalesce(0.67 * ep, 0) + coalesce(0.33 * cp, 0)) / nullif(CASE WHEN ep IS NULL THEN 0 ELSE 0.67 END + CASE WHEN cp IS NULL THEN 0 ELSE 0.33 END, 0), 6) + 0.0 AS earnings_yield_raw,
 round((coalesce(0.35 * roe_z, 0) + coalesce(0.30 * conv_z, 0) - coalesce(0.20 * accr_z, 0) - coalesce(0.15 * lev_z, 0)) / nullif(CASE WHEN roe_z IS NULL THEN 0 ELSE 0.35 END + CASE WHEN conv_z IS NULL THEN 0 ELSE 0.30 END + CASE WHEN accr_z IS NULL THEN 0 ELSE 0.20 END + CASE WHEN lev_z IS NULL THEN 0 ELSE 0.15 END, 0), 4) + 0.0 AS quality_raw,
 round((coalesce(0.45 * rg, 0) + coalesce(0.55 * eg, 0)) / nullif(CASE WHEN rg IS NULL THEN 0 ELSE 0.45 END + CASE WHEN eg IS NULL THEN 0 ELSE 0.55 END, 0), 5) + 0.0 AS growth_raw FROM z""")
def weekly_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, cap, size, n = F.col("amount"), F.col("cap"), F.col("size"), F.col("n")
    rows = staged(cross_section(spark, sf_dir), cleaned=True).select(
        "code", F.col("date").alias("model_date"), "industry_group", (a * (F.col("value_style") - 0.0312345)).alias("parent_net_profit_ttm"), F.when(n > 1, a * (F.col("momentum") - 0.0212345)).alias("operating_cashflow_ttm"),
        F.when(n < 9, cap * 30).alias("total_market_cap"), F.when(size > 20, cap * 20).alias("float_market_cap"), (cap * size).alias("total_assets"), (a / 3).alias("total_liabilities"), (cap * (size - 10)).alias("parent_equity"),
        F.col("forward_return").alias("revenue_growth"), F.when(n > 2, F.col("forward_return") * 2).alias("earnings_growth"),
    )
    out = alpha.weekly_alpha(rows)
    at = {"market_industry_weight": 8, "earnings_yield_raw": 6, "quality_raw": 4, "growth_raw": 5}
    return out.select("code", "model_date", *[(F.round(c, k) + 0.0).alias(c) for c, k in at.items()])


@query(f"""WITH {CROSS}, r AS (SELECT date, code, industry_group, cap * 100 * 1.001 AS lot, n >= 6 AS held, row_number() OVER (PARTITION BY date ORDER BY round(amount, 2) DESC, code) AS rank FROM cross_section),
e AS (SELECT *, CASE WHEN held AND rank <= 400 THEN 0 WHEN rank <= 10 THEN 1 ELSE 2 END AS place FROM r WHERE lot <= 3e6 * 0.8 / 20), c AS (SELECT *, count(*) OVER (PARTITION BY date) AS available, row_number() OVER (PARTITION BY date, industry_group ORDER BY place, rank, code) AS own FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY place, rank, code) AS pick FROM c WHERE own <= 2)
SELECT date AS decision_date, CAST(code AS VARCHAR) AS code, pick, round(lot / 3e6, 8) AS minimum_weight FROM k WHERE pick <= least(20, available)""")
def lot_aware_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With as many least holdings as names wanted no money limit binds, and filters, order and group counts decide, which SQL can say."""
    x = cross_section(spark, sf_dir).withColumn("amount", F.round("amount", 2))
    x = scoring.ranked(x, "amount", ["date"]).select(F.col("date").alias("decision_date"), "code", "rank", (F.col("n") >= 6).alias("held"), F.col("cap").alias("close"), F.lit(100).alias("min_lot"), "industry_group")
    spec = portfolio.Construction(equity=0.8, count=20, buy_rank=10, sell_rank=400, group_cap=0.08)
    out = portfolio.lot_aware_selection(x, 3e6, spec, least_holdings=20, slippage_bps=10.0)
    return out.withColumn("minimum_weight", F.round("minimum_weight", 8))


@query(f"""WITH {CROSS}, t AS (SELECT date, code, 0.9 * cap / sum(cap) OVER (PARTITION BY date) AS w, amount AS raw, industry_group IN ('Brand#12', 'Brand#23') AS leader FROM cross_section),
s AS (SELECT *, CASE WHEN leader THEN 0.9 * raw / sum(raw) FILTER (leader) OVER (PARTITION BY date) ELSE 0 END AS own FROM t) SELECT date AS decision_date, CAST(code AS VARCHAR) AS code, round(0.7 * w + 0.3 * own, 8) AS weight FROM s""")
def satellite_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps of 1 bind nowhere, so that SQL can say the blend; tests have caps that bind."""
    x = cross_section(spark, sf_dir)
    t = x.select(F.col("date").alias("decision_date"), "code", (0.9 * F.col("cap") / F.sum("cap").over(Window.partitionBy("date"))).alias("weight"), F.col("amount").alias("raw"), F.col("industry_group").isin("Brand#12", "Brand#23").alias("leader"), F.lit(0.3).alias("satellite_weight"), "industry_group")
    return portfolio.satellite_weights(t, 0.9, 1.0, 1.0).withColumn("weight", F.round("weight", 8))


@query(f"""WITH {CROSS}, p AS (SELECT date, size AS f, momentum AS c, forward_return AS y FROM cross_section WHERE forward_return IS NOT NULL),
s AS (SELECT date, count(*) AS n, var_pop(f) AS ff, var_pop(c) AS cc, covar_pop(f, c) AS fc, covar_pop(f, y) AS fy, covar_pop(c, y) AS cy FROM p GROUP BY 1),
b AS (SELECT CASE WHEN date <= 1997 THEN 'early' ELSE 'late' END AS period, (fy * cc - cy * fc) / (ff * cc - fc * fc) * sqrt(ff) AS slope FROM s WHERE n >= 80) SELECT period, 'L1' AS layer, count(*) AS weeks, round(avg(slope), 6) + 0.0 AS mean_slope FROM b GROUP BY 1""")
def subperiod_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.subperiod_decay(cross_section(spark, sf_dir), "size", [("L1", ["momentum"])], {"early": (1990, 1997), "late": (1998, 2010)})
    return out.select("period", "layer", "weeks", (F.round("mean_slope", 6) + 0.0).alias("mean_slope"))


_RANKED = ["amount", "n", "size"]


@query(f"""WITH {CROSS}, r AS (SELECT {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}' for c in _RANKED)} FROM (SELECT round(amount, 2) AS amount, n, round(size, 6) AS size FROM cross_section)),
p AS (SELECT 'amount' AS a, 'n' AS b, corr(amount, n) AS rho, count(*) AS n FROM r UNION ALL SELECT 'amount', 'size', corr(amount, size), count(*) FROM r UNION ALL SELECT 'n', 'size', corr(n, size), count(*) FROM r) SELECT a, b, round(rho, 6) AS rho, n FROM p WHERE abs(rho) >= 0.3""")
def collinear_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cross_section(spark, sf_dir).select(F.round("amount", 2).alias("amount"), "n", F.round("size", 6).alias("size"))
    return evaluate.collinear_controls(x, _RANKED, 0.3).withColumn("rho", F.round("rho", 6))


# Integer orders


_NAMES = """nm AS (SELECT s_suppkey // 4 AS account, ['600', '300', '688', '920'][s_suppkey % 4 + 1] || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS code, round(4 + abs(s_acctbal) / 400, 2) AS price, 1 + s_nationkey % 5 AS raw, (s_suppkey % 3) * 200 AS held FROM supplier),
ac AS (SELECT *, 0.9 * raw / sum(raw) OVER a AS weight, 15000.0 + 1000 * (account % 7) AS cash, 15000.0 + 1000 * (account % 7) + sum(held * price) OVER a AS value, CASE WHEN account % 2 = 0 THEN DATE '2016-03-01' ELSE DATE '2023-09-01' END AS day,
  CASE WHEN code LIKE '688%' THEN 200 ELSE 100 END AS low, CASE WHEN code LIKE '688%' OR code LIKE '920%' THEN 1 ELSE 100 END AS step, CASE WHEN code LIKE '920%' THEN 'BSE' WHEN code LIKE '6%' THEN 'SH' ELSE 'SZ' END AS ex FROM nm WINDOW a AS (PARTITION BY account))"""


@query(f"""WITH RECURSIVE {_NAMES}, fee(component, a, b, rate) AS (VALUES {_SCHEDULE}),
fl AS (SELECT *, low + greatest(0, floor((floor(weight * value / price) - low) / step)) * step AS mid, low + greatest(0, floor((floor(greatest(0.35, weight * 1.35) * value / price) - low) / step)) * step AS cap, low + greatest(0, floor((held - low) / step)) * step AS kept FROM ac),
op AS (SELECT DISTINCT account, code, CAST(s AS BIGINT) AS shares FROM (SELECT *, unnest([low, cap, CASE WHEN held >= low THEN kept END] || list_filter([mid - step, mid, mid + step], lambda x: x >= low AND x <= cap)) AS s FROM fl) WHERE s IS NOT NULL),
ch AS (SELECT op.*, ac.* EXCLUDE (account, code), abs(op.shares - held) * price AS gross, CASE WHEN op.shares > held THEN 'BUY' ELSE 'SELL' END AS side FROM op JOIN ac USING (account, code)),
fe AS (SELECT account, code, shares, sum(fee.rate) AS rate FROM ch JOIN fee ON day BETWEEN a AND b AND (component = 'regulatory' OR (component = 'stamp' AND side = 'SELL') OR component IN ('handling_' || ex, 'transfer_' || ex)) GROUP BY 1, 2, 3),
co AS (SELECT ch.*, CASE WHEN gross > 0 THEN gross * (rate + CASE WHEN ex = 'BSE' AND day < DATE '2021-11-15' THEN 0.000125 ELSE 0 END) + greatest(gross * 0.0003, 5.0) ELSE 0 END AS f FROM ch JOIN fe USING (account, code, shares)),
nw AS (SELECT account, sum(weight * weight) AS norm, value * (1 - sum(weight)) AS wanted, count(*) AS names FROM ac GROUP BY account, value),
st AS (SELECT account, code, dense_rank() OVER (PARTITION BY account ORDER BY code) AS k, shares, CASE WHEN side = 'BUY' THEN -gross ELSE gross END - f AS flow, pow(shares * price / value - weight, 2) AS tr, f FROM co),
ve(account, k, flow, tr, f, chosen) AS (SELECT DISTINCT account, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST([] AS BIGINT[]) FROM st
  UNION ALL SELECT v.account, s.k, v.flow + s.flow, v.tr + s.tr, v.f + s.f, list_append(v.chosen, s.shares) FROM ve v JOIN st s ON s.account = v.account AND s.k = v.k + 1),
en AS (SELECT v.*, tr / greatest(norm, 1e-8) + 0.75 * pow((cash + v.flow - wanted) / value, 2) + 2.0 * v.f / value AS objective FROM ve v JOIN nw ON nw.account = v.account AND v.k = names JOIN (SELECT DISTINCT account, cash, value FROM ac) ca ON ca.account = v.account WHERE cash + v.flow >= -1e-7),
be AS (SELECT account, min(objective) AS objective, arg_min(chosen, objective) AS chosen FROM en GROUP BY 1)
SELECT be.account, code, chosen[k] AS shares, round(objective, 9) AS objective, 'exact' AS search FROM be JOIN (SELECT DISTINCT account, code, k FROM st) USING (account)""")
def integer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of four names each, so that SQL can try all lot vectors; fees by side, exchange, board and day."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    prefix = F.when(k % 4 == 0, "600").when(k % 4 == 1, "300").when(k % 4 == 2, "688").otherwise("920")
    account = F.floor(k / 4).cast("long")
    w = Window.partitionBy("account")
    x = s.select(account.alias("account"), F.concat(prefix, F.lpad((k % 1000).cast("string"), 3, "0")).alias("code"), F.round(4 + F.abs("s_acctbal") / 400, 2).alias("price"), (1 + F.col("s_nationkey") % 5).alias("raw"), ((k % 3) * 200).alias("held"))
    x = x.withColumns({"weight": 0.9 * F.col("raw") / F.sum("raw").over(w), "cash": 15000.0 + 1000 * (F.col("account") % 7), "day": F.when(F.col("account") % 2 == 0, F.lit("2016-03-01").cast("date")).otherwise(F.lit("2023-09-01").cast("date"))})
    x = x.withColumn("value", F.col("cash") + F.sum(F.col("held") * F.col("price")).over(w))
    spec = orders.Search(stock_cap=0.35, reach=1, commission=0.0003, minimum=5.0)
    return rounded(orders.integer_orders(x.drop("raw"), ["account"], spec), 9)


@query("""WITH o AS (SELECT o_custkey % 500 AS account, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'BUY' END AS side, o_totalprice AS gross, o_orderkey % 9 <> 0 AS able, o_orderkey % 17 AS rank, (o_orderkey % 10) / 100.0 AS tw,
  CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'REDUCE' ELSE 'INCREASE' END END AS mode, o_orderkey % 5 = 0 AS ex, (o_custkey % 500) % 3 * 0.25 AS current, (o_custkey % 500) % 4 * 0.25 AS target, 1e6 AS value FROM orders),
q AS (SELECT *, row_number() OVER (PARTITION BY account, side ORDER BY mode IS NULL, CASE WHEN side = 'SELL' THEN CASE WHEN ex THEN 0.0 ELSE 1.0 END ELSE rank END, CASE WHEN side = 'SELL' THEN -rank ELSE -tw END, CASE WHEN side = 'SELL' THEN -gross ELSE gross END, id) AS k FROM o WHERE able),
a AS (SELECT account, max(value) * (max(target) - max(current)) AS net, max(current) AS current FROM o GROUP BY 1),
l AS (SELECT a.account, net, a.current, coalesce(list(struct_pack(id := id, g := gross) ORDER BY k) FILTER (side = 'BUY'), []) AS buys, coalesce(list(struct_pack(id := id, g := gross) ORDER BY k) FILTER (side = 'SELL'), []) AS sells, coalesce(sum(gross) FILTER (side = 'BUY'), 0) AS tb, coalesce(sum(gross) FILTER (side = 'SELL'), 0) AS ts FROM a LEFT JOIN q USING (account) GROUP BY 1, 2, 3),
f1 AS (SELECT *, CASE WHEN net > 0 THEN sells WHEN net < 0 OR tb <= ts OR true THEN buys END AS items, CASE WHEN net > 0 THEN greatest(0, tb - net) WHEN net < 0 THEN greatest(0, ts + net) WHEN tb <= ts THEN 1e300 ELSE ts END AS goal FROM l),
s1 AS (SELECT *, list_reduce(list_prepend(struct_pack(used := 0.0::DOUBLE, ids := CAST([] AS BIGINT[])), list_transform(items, lambda x: struct_pack(used := x.g, ids := [x.id]))),
  lambda s, x: CASE WHEN x.used > 0 AND (goal = 1e300 OR abs(goal - (s.used + x.used)) + 1e-8 < abs(goal - s.used)) THEN struct_pack(used := s.used + x.used, ids := s.ids || x.ids) ELSE s END) AS r FROM f1),
f2 AS (SELECT account, r, CASE WHEN net > 0 THEN buys ELSE sells END AS items, CASE WHEN net > 0 THEN CASE WHEN current <= 0.01 THEN 1e300 ELSE net + r.used END WHEN net < 0 THEN greatest(0, r.used - net) WHEN tb <= ts THEN r.used ELSE 1e300 END AS goal FROM s1),
s2 AS (SELECT account, r, list_reduce(list_prepend(struct_pack(used := 0.0::DOUBLE, ids := CAST([] AS BIGINT[])), list_transform(items, lambda x: struct_pack(used := x.g, ids := [x.id]))),
  lambda s, x: CASE WHEN x.used > 0 AND (goal = 1e300 OR abs(goal - (s.used + x.used)) + 1e-8 < abs(goal - s.used)) THEN struct_pack(used := s.used + x.used, ids := s.ids || x.ids) ELSE s END) AS t FROM f2)
SELECT o.account, id, NOT able OR list_contains(r.ids || t.ids, id) AS kept FROM o JOIN s2 USING (account)""")
def guarded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    account = F.col("o_custkey") % 500
    side = F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY")
    rows = o.select(
        account.alias("account"), k.alias("id"), side.alias("side"), F.col("o_totalprice").alias("gross"), (k % 9 != 0).alias("actionable"), (k % 17).alias("rank"), (k % 10 / 100.0).alias("target_weight"),
        F.when(k % 11 == 0, F.when(side == "SELL", "REDUCE").otherwise("INCREASE")).alias("mode"), F.when(k % 5 == 0, "EXIT").otherwise("ADJUST").alias("transition"),
        (account % 3 * 0.25).alias("current"), (account % 4 * 0.25).alias("target"), F.lit(1e6).alias("value"),
    )
    return orders.guarded(rows, ["account"]).select("account", "id", "kept")


# Opening gaps


_GAPS = f"""{PANEL}, v AS (SELECT code, trade_date, daily_return AS g FROM panel WHERE abs(daily_return) <= 0.9),
sq AS (SELECT code, trade_date, count(*) OVER w AS n, quantile_cont(g, 0.1) OVER w AS lo, quantile_cont(g, 0.5) OVER w AS mid, quantile_cont(g, 0.9) OVER w AS hi FROM v WINDOW w AS (PARTITION BY code ORDER BY trade_date ROWS 251 PRECEDING)),
dq AS (SELECT trade_date, quantile_cont(g, 0.1) AS lo, quantile_cont(g, 0.5) AS mid, quantile_cont(g, 0.9) AS hi FROM v GROUP BY 1),
mq AS (SELECT trade_date, median(lo) OVER w AS lo, median(mid) OVER w AS mid, median(hi) OVER w AS hi FROM dq WINDOW w AS (ORDER BY trade_date ROWS 59 PRECEDING)),
pm AS (SELECT code, panel.trade_date, coalesce(lo, -0.015) AS mlo, coalesce(mid, 0.0) AS mmid, coalesce(hi, 0.015) AS mhi FROM panel ASOF LEFT JOIN mq ON panel.trade_date >= mq.trade_date),
ps AS (SELECT pm.*, coalesce(n, 0) AS n, lo, mid, hi, coalesce(n, 0) / (coalesce(n, 0) + 40.0) * least(1.0, coalesce(n, 0) / 60.0) AS r FROM pm ASOF LEFT JOIN sq ON pm.code = sq.code AND pm.trade_date >= sq.trade_date),
ml AS (SELECT code, trade_date, n, r, list_sort([CASE WHEN n > 0 THEN r * lo + (1 - r) * mlo ELSE mlo END, CASE WHEN n > 0 THEN r * mid + (1 - r) * mmid ELSE mmid END, CASE WHEN n > 0 THEN r * hi + (1 - r) * mhi ELSE mhi END]) AS t FROM ps)"""


@query(f"""WITH {_GAPS} SELECT code, trade_date, n AS observations, round(t[1], 6) + 0.0 AS lower_gap, round(t[2], 6) + 0.0 AS expected_gap, round(t[3], 6) + 0.0 AS upper_gap, CASE WHEN n = 0 THEN 'market_fallback' WHEN r < 0.999 THEN 'stock_market_shrunk' ELSE 'stock_history' END AS source FROM ml""")
def opening_gaps_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = panel(spark, sf_dir).select("code", "trade_date", F.col("close").alias("open"), (F.col("close") / (1 + F.col("daily_return"))).alias("prev_close"))
    out = gaps.opening_gaps(days, gaps.Gaps(widest=0.9))
    return out.select("code", "trade_date", "observations", *[(F.round(c, 6) + 0.0).alias(c) for c in ("lower_gap", "expected_gap", "upper_gap")], "source")


# Sources


@query("""WITH m AS (SELECT 'f' || o_custkey AS source, o_custkey % 97 AS size, o_orderkey % 5 AS mtime, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number, o_orderstatus = 'F' AS ok FROM orders),
c AS (SELECT source, arg_max(size, number) AS size, arg_max(mtime, number) AS mtime FROM m WHERE ok GROUP BY 1), h AS (SELECT source, max(number) AS n FROM m GROUP BY 1),
f AS (SELECT 'f' || c_custkey AS source, c_custkey % 97 AS size, c_custkey % 5 AS mtime FROM customer)
SELECT f.source, f.size, f.mtime, coalesce(n, 0) + 1 AS number FROM f LEFT JOIN c ON c.source = f.source LEFT JOIN h ON h.source = f.source WHERE c.source IS NULL OR f.size <> c.size OR f.mtime <> c.mtime""")
def sources_to_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of customers as files, with orders as the manifest of their loads: which changed since their last complete load, and the version each gets."""
    source = F.concat(F.lit("f"), F.col("o_custkey"))
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    m = table(spark, sf_dir, "orders").select(source.alias("source"), (F.col("o_custkey") % 97).alias("size"), (F.col("o_orderkey") % 5).alias("mtime"), number.alias("number"), F.col("o_orderkey").cast("string").alias("version"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running").alias("status"), F.lit(1).alias("rows"))
    found = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey")).alias("source"), (F.col("c_custkey") % 97).alias("size"), (F.col("c_custkey") % 5).alias("mtime"))
    return manifest.to_load(found, m)


# Adjusted prices and closing views


_EX = "ev AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS ex, 1 + l_discount AS f FROM lineitem WHERE l_linenumber >= 4 AND l_discount > 0)"


@query(f"""WITH {PANEL}, {_EX}, dy AS (SELECT code, ex, sum(ln(f)) AS g FROM ev GROUP BY 1, 2), cu AS (SELECT code, ex, exp(sum(g) OVER (PARTITION BY code ORDER BY ex)) AS c, exp(sum(g) OVER (PARTITION BY code)) AS t FROM dy), tt AS (SELECT DISTINCT code, t FROM cu)
SELECT p.code, trade_date, round(ln(coalesce(c, 1)), 6) + 0.0 AS log_factor, round(ln(close * coalesce(c, 1)), 6) + 0.0 AS log_backward, round(ln(close * coalesce(c, 1) / coalesce(tt.t, 1)), 6) + 0.0 AS log_forward
FROM panel p ASOF LEFT JOIN cu ON p.code = cu.code AND p.trade_date >= cu.ex LEFT JOIN tt ON tt.code = p.code""")
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of suppliers, adjusted by the factors of lines sold at a discount; as logarithms, since products of many factors grow."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber >= 4 and l_discount > 0")
    events = li.select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("ex"), (1 + F.col("l_discount")).alias("f"))
    out = adjust.adjusted_prices(panel(spark, sf_dir).select("code", "trade_date", "close"), events, ["code"], "trade_date", "close", "ex", "f")
    log = lambda c: (F.round(F.ln(c), 6) + 0.0)
    return out.select("code", "trade_date", log("backward_factor").alias("log_factor"), log("backward_price").alias("log_backward"), log("forward_price").alias("log_forward"))


@query(f"""WITH {PANEL}, n AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date, min(l_returnflag) AS reason FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2),
j AS (SELECT p.code, p.trade_date, close, reason FROM panel p LEFT JOIN n ON n.code = p.code AND n.trade_date = p.trade_date)
SELECT code, trade_date AS latest_trade_date, round(close + 1e-7, 4) AS latest_close, CASE WHEN reason IS NULL THEN 0 ELSE 1 END AS no_limit, reason AS no_limit_reason FROM j QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1""")
def closing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    free = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date"), F.col("l_returnflag").alias("reason"))
    views = adjust.closing_views(adjust.with_no_limit(p, free, ["code"], "trade_date"))
    meta = views["stock_meta"].select("code", "latest_trade_date", F.round(F.col("latest_close") + 1e-7, 4).alias("latest_close"))
    return meta.join(views["latest_prices"].select("code", "no_limit", "no_limit_reason"), "code")


# Settings


@query("""SELECT c_custkey, sha256('{"a":' || regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') || ',"b":{"k":' || c_custkey || ',"n":[' || c_nationkey || ',1000],"z":null},"name":"' || c_name || '"}') AS hash, TRUE AS same FROM customer""")
def settings_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same settings as columns in one order and as text in another, with other spaces and number forms."""
    c = table(spark, sf_dir, "customer")
    key, nation, a, name = (F.col(x) for x in ("c_custkey", "c_nationkey", "c_acctbal", "c_name"))
    inner = F.struct(F.lit(None).cast("string").alias("z"), key.alias("k"), F.array(nation, F.lit(1000).cast("bigint")).alias("n"))
    hashed = C.config_hash(name.alias("name"), inner.alias("b"), a.alias("a"))
    text = F.concat(F.lit('{ "b" : {"n":['), nation.cast("string"), F.lit('.0, 1e3], "k":'), key.cast("string"), F.lit('.00, "z": null}, "name":"'), name, F.lit('", "a":'), a.cast("string"), F.lit("}"))
    return c.select("c_custkey", hashed.alias("hash"), (hashed == F.sha2(C.canonical_json(text), 256)).alias("same"))


@query("""WITH s AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN '-' || c_custkey ELSE 'acct-' || c_custkey END AS account, c_custkey % 7 AS k, c_custkey FROM customer)
SELECT account, CASE WHEN account LIKE '-%' THEN 'bad account' WHEN k = 0 THEN 'new' WHEN k = 1 THEN 'no object' WHEN k = 2 THEN 'no object' WHEN k = 3 THEN 'no account id' WHEN k = 4 THEN 'other account' ELSE 'ok' END AS status FROM s""")
def account_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of customers' accounts, some of them missing, damaged or another account's."""
    c = table(spark, sf_dir, "customer")
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 7
    account = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("-"), key)).otherwise(F.concat(F.lit("acct-"), key))
    owner = F.when(k == 3, "  ").when(k == 4, "acct-0").otherwise(F.concat(F.lit(" "), account))
    state = F.when(k == 0, None).when(k == 1, F.lit("[1, 2]")).when(k == 2, F.lit("{broken")).otherwise(F.to_json(F.struct(owner.alias("account_id"), F.col("c_acctbal").alias("cash"))))
    return states.checked(c.select(account.alias("account"), state.alias("state"))).select("account", "status")

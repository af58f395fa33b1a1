"""Operators against pandas and numpy, and the queries against their SQL."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitlake.operators import asof, evaluate, factors, fundamentals, portfolio, risk, scoring
from pitlake.operators import windows as W
from pitlake.plans import catalog

D = dt.date
TABLES = "region nation customer supplier part orders lineitem events".split()


def canonical(df):
    def one(v):
        if v is None or v != v or str(v) == "NaT":
            return None
        if isinstance(v, (float, np.floating)):
            return round(float(v), 9) + 0.0
        return str(v).removesuffix(" 00:00:00")

    k = sorted(df.columns)
    return sorted(str([one(v) for v in r]) for r in df[k].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert canonical(entry.queries()[name](spark, sf).toPandas()) == canonical(con.execute(catalog.ORACLES[name]).df())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_ttm_vector(spark):
    rows = [("a", 2022, 1, 20.0, D(2022, 4, 25)), ("a", 2022, 4, 100.0, D(2023, 3, 30)), ("a", 2023, 1, 30.0, D(2023, 4, 25))]
    ytd = spark.createDataFrame(rows, "code string, year int, quarter int, revenue double, available date")
    out = fundamentals.trailing_twelve_months(ytd, "code", "year", "quarter", 4, ["revenue"], "available").where("year = 2023").first()
    assert out.revenue_ttm == 110.0 and out.ttm_available == D(2023, 4, 25)


def test_availability_is_strictly_after(spark):
    days = spark.createDataFrame([(D(2024, 3, d),) for d in (19, 20, 21)], "trade_date date")
    e = spark.createDataFrame([("a", D(2024, 3, 20)), ("b", D(2024, 1, 1)), ("c", D(2024, 3, 21))], "code string, available date")
    got = {r.code: r.effective_date for r in asof.next_trading_day(e, "available", days).collect()}
    assert got == {"a": D(2024, 3, 21), "b": D(2024, 3, 19), "c": None}


def test_late_restatement_of_an_older_period_never_wins(spark):
    e = spark.createDataFrame([("a", D(2024, 1, 5), 20234, 1.0), ("a", D(2024, 2, 5), 20233, 9.0)], "code string, effective date, period int, v double")
    d = spark.createDataFrame([("a", D(2024, 3, 1))], "code string, model_date date")
    assert asof.newest_period_asof(d, e, ["code"], "model_date", "effective", "period", ["v"]).first().v == 1.0


def test_group_priority_and_unknown(spark):
    h = spark.createDataFrame([("a", "P2", D(2020, 1, 1), "C39"), ("b", "P1", D(2023, 1, 1), "K70")], "code string, classification_id string, implement_date date, industry_code string")
    d = spark.createDataFrame([(c, D(2021, 6, 1)) for c in "abc"], "code string, model_date date")
    got = {r.code: r.industry_group for r in asof.prioritised_group_asof(d, h, "code", "model_date", [("P1", None), ("P2", None)], 1).collect()}
    assert got == {"a": "C", "b": "UNKNOWN", "c": "UNKNOWN"}


def test_residual_momentum_counts(spark):
    start = D(2020, 1, 3)
    rows = spark.createDataFrame([(start + dt.timedelta(7 * i), "a", 0.01) for i in range(60)], "model_date date, code string, specific_return double")
    last = W.residual_momentum(rows, 52, 4, 26).orderBy(F.desc("model_date")).first()
    assert last.observations == 48 and last.momentum == pytest.approx(1.01**48 - 1)


def test_hac_t_matches_numpy(spark):
    x = np.random.default_rng(0).normal(0.1, 1, 80)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double")
    c = x - x.mean()
    var = c @ c / 80 + sum(2 * (1 - k / 5) * (c[k:] @ c[:-k]) / 80 for k in range(1, 5))
    assert W.hac_t(df, "v", ["k"], "i", 4).first().t == pytest.approx(x.mean() / np.sqrt(var / 80))


def test_regression_recovers_planted_factors(spark):
    rng = np.random.default_rng(3)
    styles = ["s1", "s2"]
    n = 180
    df = pd.DataFrame({"model_date": D(2024, 1, 5), "code": [f"{i:06d}" for i in range(n)], "industry_group": np.array(["A", "B", "C"])[np.arange(n) % 3], "cap": rng.uniform(1, 9, n), "s1": rng.normal(size=n), "s2": rng.normal(size=n)})
    cap = df.groupby("industry_group")["cap"].sum()
    f = {"A": 0.001, "B": 0.002}
    f["C"] = -(cap["A"] * f["A"] + cap["B"] * f["B"]) / cap["C"]
    df["forward_return"] = 0.01 + 1e-4 * df["s1"] + 2e-4 * df["s2"] + df["industry_group"].map(f)
    got = {r.name: r.value for r in factors.factor_returns(spark.createDataFrame(df), factors.RegressionSpec(tuple(styles))).where("kind = 'factor'").collect()}
    for k, v in {"MARKET": 0.01, "s1": 1e-4, "s2": 2e-4, **f}.items():
        assert got[k] == pytest.approx(v, abs=1e-10)


def test_portfolio_risk_vector_and_contributions(spark):
    w = spark.createDataFrame([("p", "a", 0.25), ("p", "b", 0.25)], "portfolio string, code string, weight double")
    x = spark.createDataFrame([("a", "MARKET", 1.0), ("b", "MARKET", 1.0)], "code string, factor string, value double")
    cov = spark.createDataFrame([("MARKET", "MARKET", 0.04)], "factor_1 string, factor_2 string, covariance double")
    own = spark.createDataFrame([("a", 0.09), ("b", 0.09)], "code string, specific_variance double")
    r = risk.portfolio_risk(w, x, cov, own, ["portfolio"]).first()
    assert r.common_variance == pytest.approx(0.01) and r.specific_variance == pytest.approx(0.01125)
    parts = risk.stock_contributions(w.drop("portfolio"), x, cov, own).agg(F.sum("variance_contribution")).first()[0]
    assert parts == pytest.approx(r.total_variance)


def test_test_portfolios_sum_to_one(spark, sf):
    out = entry.queries()["risk_test_portfolios"](spark, sf)
    bad = out.groupBy("model_date", "portfolio_name").agg(F.sum("weight").alias("w"), F.min("weight").alias("m")).where("abs(w - 1) > 1e-4 or m < 0")
    assert bad.count() == 0


def test_caps_hold_and_weights_sum():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = 25
        group = rng.integers(0, 5, n).astype(str)
        w = portfolio.cap_and_redistribute(rng.random(n), group, 0.95, 0.10, 0.30)
        assert (w <= 0.10 + 1e-9).all() and all(w[group == g].sum() <= 0.30 + 1e-9 for g in set(group))
        assert w.sum() == pytest.approx(min(0.95, sum(min(0.30, 0.10 * (group == g).sum()) for g in set(group))), abs=1e-6)


def test_lot_rounding_vector():
    shares = portfolio.round_to_lots(np.array([0.035, 0.035]), np.array([3.0, 4.0]), np.array([100, 100]), np.array([100, 100]), 10000.0)
    assert shares.tolist() == [100, 100]


def test_selection_buffer_and_group_counts():
    spec = portfolio.Construction(count=3, buy_rank=3, sell_rank=5, equity=0.9, stock_cap=0.5, group_cap=0.6)
    rank, group = np.arange(1, 7), np.array(["x", "x", "x", "y", "y", "z"])
    held = np.array([False, False, False, False, True, False])
    assert portfolio.buffered_selection(rank, group, held, spec).tolist() == [0, 1, 4]


def test_disguised_factor_dies_and_honest_one_survives(spark):
    rng = np.random.default_rng(7)
    rows = []
    for t in range(60):
        past, honest, style = rng.normal(size=(3, 120))
        fwd = 0.05 * honest - 0.05 * past + 0.03 * rng.normal(size=120)
        rows += [(D(2020, 1, 3) + dt.timedelta(7 * t), f"c{i}", "train" if t < 35 else "test", float(fwd[i]), float(honest[i]), float(-past[i] + 0.01 * rng.normal()), float(past[i]), float(style[i])) for i in range(120)]
    p = spark.createDataFrame(rows, "date date, code string, era string, forward_return double, honest double, mimic double, past double, style double")
    got = {f: evaluate.reversal_retest(p, f, "past", ["style"], 8, least=80).first() for f in ("honest", "mimic")}
    assert got["honest"].survived and not got["mimic"].survived


def test_tied_signal_is_not_groupable(spark):
    rows = [(D(2024, 1, 1 + d), float(i % 2), float(i)) for d in range(5) for i in range(50)]
    p = spark.createDataFrame(rows, "date date, tied double, smooth double")
    assert evaluate.groupability(p, "tied").first().usable_share == 0 and evaluate.groupability(p, "smooth").first().usable_share == 1


def test_bonferroni_bars():
    assert evaluate.bonferroni_bar(56) == pytest.approx(3.32, abs=0.02) and evaluate.bonferroni_bar(196) == pytest.approx(3.66, abs=0.02)


def test_collinear_and_constant_controls(spark):
    rng = np.random.default_rng(1)
    rows = [("train", float(x), float(2 * x + 1e-6), 1.0) for x in rng.normal(size=80)]
    p = spark.createDataFrame(rows, "era string, a double, b double, c double")
    assert [(r.a, r.b) for r in evaluate.collinear_controls(p, ["a", "b"]).collect()] == [("a", "b")]
    assert {r.control: r.constant for r in evaluate.control_audit(p, ["a", "c"]).collect()} == {"a": False, "c": True}


def test_matured_weights_use_no_later_label(spark):
    ics = [(D(2024, 1, 1) + dt.timedelta(7 * i), D(2024, 1, 8) + dt.timedelta(7 * i), c, 0.1 if c == "a" else -0.1) for i in range(30) for c in "ab"]
    rows = spark.createDataFrame(ics, "entry_date date, exit_date date, component string, ic double")
    d = spark.createDataFrame([(D(2024, 2, 1),), (D(2024, 8, 1),)], "decision_date date")
    got = {(r.decision_date.month, r.component): r.weight for r in scoring.matured_ic_weights(rows, d, {"a": 0.5, "b": 0.5}, cap=0.8).collect()}
    assert got[(2, "a")] == got[(2, "b")] == 0.5 and got[(8, "a")] > 0.7


def test_rolling_deviation_of_pieces(spark):
    """Equal to pandas for windows whose length has divisors and not; a huge value and nulls leave no trace once they are out, and equal values give 0."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=300)
    v[rng.choice(300, 50, replace=False)] = np.nan
    v[40] = 1e12
    v[200:270] = 0.25
    df = spark.createDataFrame([(c, i, None if np.isnan(x) else float(x)) for c in "ab" for i, x in enumerate(v if c == "a" else v[:7])], "code string, trade_date int, r double")
    for n, least in ((60, 20), (12, 2), (7, 3)):
        got = W.rolling_deviation(df, "r", W.series("code"), n, least, "sd").orderBy("code", "trade_date").toPandas()
        for c, own in (("a", v), ("b", v[:7])):
            want = pd.Series(own).rolling(n, min_periods=1).apply(lambda x, least=least: np.nanstd(x, ddof=1) if np.isfinite(x).sum() >= max(least, 2) else np.nan, raw=True).to_numpy()
            assert np.allclose(got.loc[got["code"] == c, "sd"].to_numpy(float), want, rtol=1e-9, atol=1e-12, equal_nan=True)
    flat = got.loc[(got["code"] == "a") & got["trade_date"].between(210, 269), "sd"].dropna()
    assert len(flat) and (flat == 0).all()


def _lines_read(df):
    """How often a plan reads lines, and how often it shuffles."""
    plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
    return plan[0].count("lineitem.parquet"), plan[1].count("Exchange hashpartitioning")


def test_weekly_cross_section_is_dealt_by_supplier_once(spark, sf):
    reads, shuffles = _lines_read(catalog._weekly_cross_section(spark, sf))
    assert reads <= 2  # the lines and their days
    assert shuffles <= 2  # lines by supplier, days by week


def test_portfolios_read_the_cross_section_once(spark, sf):
    assert _lines_read(catalog.QUERIES["risk_test_portfolios"](spark, sf))[0] == 0  # but what was written once


def test_targets_from_the_rows_that_can_be_chosen(spark):
    """Equal to the choice among all rows, held names and full groups included; what comes to Python is limited before it."""
    rng = np.random.default_rng(7)
    n, day = 400, dt.date(2024, 1, 5)
    for spec, groups in ((portfolio.Construction(count=6, buy_rank=3, sell_rank=9, stock_cap=0.2, group_cap=0.3), 3), (portfolio.Construction(count=5, buy_rank=0, sell_rank=0, stock_cap=0.3, group_cap=0.2), 40)):
        df = pd.DataFrame({"decision_date": day, "code": [f"{i:04d}" for i in rng.permutation(n)], "score": np.round(rng.normal(size=n), 1), "volatility": rng.uniform(0.1, 0.5, n), "industry_group": [f"g{int(g)}" for g in np.minimum(rng.exponential(groups / 4, n), groups)], "held": rng.uniform(size=n) < 0.1})
        best = df.sort_values(["score", "code"], ascending=[False, True]).reset_index(drop=True)
        at = portfolio.buffered_selection(np.arange(1, n + 1), best["industry_group"].to_numpy(), best["held"].to_numpy(), spec)
        raw = portfolio.score_weights(best["score"].to_numpy()[at], best["volatility"].to_numpy()[at], spec)
        want = dict(zip(best["code"][at], portfolio.cap_and_redistribute(raw, best["industry_group"].to_numpy()[at], spec.equity, spec.stock_cap, spec.group_cap), strict=True))
        out = portfolio.target_weights(spark.createDataFrame(df), spec)
        assert {r.code: r.weight for r in out.collect()} == pytest.approx(want)
        assert "WindowGroupLimit" in out._jdf.queryExecution().sparkPlan().toString()


def test_ics_of_values_that_do_not_vary(spark):
    rows = spark.createDataFrame([(d, float(i), float(-i), 1.0 if d == 1 else float(i)) for d in (1, 2) for i in range(40)], "date int, a double, b double, y double")
    got = {(r.date, r.component): r.ic for r in scoring.component_ics(rows, ["a", "b"], "y", "date").collect()}
    assert got[(2, "a")] == pytest.approx(1) and got[(2, "b")] == pytest.approx(-1) and np.isnan(got[(1, "a")])
    assert "REPARTITION_BY_NUM" in scoring.component_ics(rows, ["a", "b"], "y", "date")._jdf.queryExecution().executedPlan().toString()

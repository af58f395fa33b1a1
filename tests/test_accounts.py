import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitlake.operators import alpha, crosssection, portfolio, risk
from pitlake.plans import build, evaluation
from pitlake.sources import reference, workbook_sink, workbooks

D = dt.date


def test_lot_aware_against_a_plain_pass(spark):
    rng = np.random.default_rng(3)
    rows = [(1, f"{i:06d}", i + 1, bool(rng.random() < 0.2), float(rng.choice([3, 8, 20, 90])), 100, str(rng.integers(0, 4))) for i in range(60)]
    spec = portfolio.Construction(equity=0.9, count=12, buy_rank=15, sell_rank=30, group_cap=0.3)
    value, slip = 20000.0, 0.002
    df = spark.createDataFrame(rows, "decision_date int, code string, rank int, held boolean, close double, min_lot int, industry_group string")
    got = [(r.code, r.minimum_weight) for r in portfolio.lot_aware_selection(df, value, spec, 4, 20.0).orderBy("pick").collect()]

    def place(r):
        return 0 if r[3] and r[2] <= 30 else 1 if r[2] <= 15 else 2

    budget = value * 0.9
    able = [(r[1], r[5] * r[4] * (1 + slip), r[6]) for r in sorted(rows, key=lambda r: (place(r), r[2])) if r[5] * r[4] * (1 + slip) <= budget / 4]
    n, spent = 0, 0.0
    for _, lot, _ in able:
        if n < 12 and spent + lot <= budget:
            n, spent = n + 1, spent + lot
    names = int(np.ceil(n * 0.3 / 0.9 - 1e-9))
    out, spent = [], 0.0
    for c, lot, g in able:
        own = [x for x in out if x[2] == g]
        if len(out) < n and len(own) < names and spent + lot <= budget and sum(x[1] for x in own) + lot <= value * 0.3:
            out.append((c, lot, g))
            spent += lot
    assert [c for c, _ in got] == [c for c, _, _ in out] and len(out) >= 4
    assert np.allclose([w for _, w in got], [lot / value for _, lot, _ in out])
    assert portfolio.lot_aware_selection(df.where("close < 0"), value, spec).count() == 0


def test_preferences_for_leading_and_defensive_groups(spark):
    def pick(prefer, equity=1.0, group_cap=1.0, count=6):
        spec = portfolio.Construction(equity=equity, count=count, buy_rank=20, sell_rank=20, group_cap=group_cap)
        rows = [(1, f"60{i:04d}", i + 1, i in (9, 10), 12 - i if i in (9, 10) else None, 10.0, 100, g, lead) for i, (g, lead) in enumerate([("bank", 0), ("bank", 0), ("power", None), ("bank", 0), ("tech", 2), ("power", 0), ("chip", 1), ("tech", 3), ("bank", 0), ("chip", 2), ("food", 0), (None, 0)])]
        df = spark.createDataFrame(rows, "decision_date int, code string, rank int, held boolean, retention_rank int, close double, min_lot int, industry_group string, leader_rank int")
        return [int(r.code[2:]) for r in portfolio.lot_aware_selection(df, 6000.0, spec, 1, 0.0, prefer).orderBy("pick").collect()]

    assert pick(portfolio.Preferences()) == [10, 9, 0, 1, 2, 3]  # held names by their own rank, then the rest
    guarded = portfolio.Preferences(defensive=(" Bank", "POWER"), defensive_fraction=0.34)
    assert pick(guarded) == [10, 9, 0, 1, 4, 6]  # two of six names at most
    assert pick(portfolio.Preferences(defensive=("bank", "power"), defensive_names=1)) == [10, 9, 0, 2, 4, 6]  # one of each
    # The first candidate of each leading group counts, by its rank among leaders: chip is led by the held name 9, of rank 2, like tech by 4.
    assert pick(portfolio.Preferences(leaders=2)) == [4, 9, 10, 0, 1, 2]
    assert pick(portfolio.Preferences(leaders=1), count=2) == [4, 10]
    assert pick(portfolio.Preferences(group_caps=(("bank", 0.0), ("UNKNOWN", 0.0)))) == [10, 9, 2, 4, 5, 6]
    assert pick(portfolio.Preferences(group_caps=(("bank", 1 / 6),), leaders=9)) == [4, 9, 10, 0, 2, 5]


def test_satellite_allocation_keeps_caps_and_total():
    desired, raw = np.array([0.3, 0.3, 0.2, 0.1]), np.array([1.0, 2.0, np.nan, 1.0])
    group, leader = np.array(["a", "a", "b", "c"]), np.array([False, True, True, True])
    assert np.allclose(portfolio.satellite_allocation(desired, raw, leader, group, 0.3, 0.9, 1.0, 1.0), 0.7 * desired + 0.3 * 0.9 * np.array([0, 2, 0, 1]) / 3)
    w = portfolio.satellite_allocation(desired, raw, leader, group, 0.9, 0.9, 0.35, 0.5)
    assert w.max() <= 0.35 + 1e-9 and w[:2].sum() <= 0.5 + 1e-9 and abs(w.sum() - 0.9) < 1e-6
    assert portfolio.satellite_allocation(desired, raw, leader & False, group, 0.3, 0.9, 1.0, 1.0) is desired


def test_variances_of_all_dates_equal_those_of_one(spark):
    rng = np.random.default_rng(1)
    rows = [(D(2020, 1, 3) + dt.timedelta(7 * t), c, float(rng.normal())) for t in range(40) for c in "abcde" if rng.random() < 0.9]
    s = spark.createDataFrame(rows, "model_date date, code string, value double")
    g = s.select("model_date", "code", F.when(F.col("code") < "c", "x").otherwise("y").alias("industry_group"))
    got = {(r.model_date, r.code): r.specific_variance for r in risk.specific_variance_by_date(s, g, 13.0, 10, shrink=0.0).collect()}
    for day in (D(2020, 6, 5), D(2020, 9, 25)):
        one = risk.specific_variance(s, g.select("code", "industry_group").distinct(), day, 13.0, 10, shrink=0.0).collect()
        for r in one:
            if (day, r.code) in got:
                assert abs(got[(day, r.code)] - r.specific_variance) < 1e-9 * abs(r.specific_variance)


def test_model_is_built_once_and_appended(spark, tmp_path):
    rng = np.random.default_rng(2)
    days = [D(2021, 1, 1) + dt.timedelta(7 * t) for t in range(14)]
    rows = [(d, f"s{c}", f"g{c % 3}", float(1 + c), float(rng.normal() / 50), float(rng.normal())) for d in days for c in range(30)]
    x = spark.createDataFrame(rows, "model_date date, code string, industry_group string, cap double, forward_return double, size double")
    model, folder = build.Model(("size",), window=8, least=5, half_life=4.0, least_specific=4), str(tmp_path / "m")
    first = x.where(F.col("model_date") <= F.lit(days[9]))
    assert build.build(spark, first, folder, model) == days[:10]
    assert build.build(spark, x, folder, model) == days[10:]
    whole = str(tmp_path / "w")
    assert build.build(spark, x, whole, model) == days
    read = lambda f, n, k: {tuple(r[c] for c in k): r for r in spark.read.parquet(f"{f}/{n}").collect()}
    for name, key, v in (("factor_return", ("model_date", "kind", "name"), "value"), ("factor_covariance", ("model_date", "factor_1", "factor_2"), "covariance"), ("specific_variance", ("model_date", "code"), "specific_variance")):
        a, b = read(folder, name, key), read(whole, name, key)
        assert a.keys() == b.keys() and len(a) > 20
        assert all(abs(a[k][v] - b[k][v]) < 1e-9 for k in a)
    assert min(k[0] for k in read(whole, "factor_return", ("model_date", "kind"))) == days[1]  # realised a week later


def test_reference_build(spark, tmp_path):
    spec = reference.Reference("t", {"code": ("code", ("Stkcd",)), "d": ("date", ()), "v": ("float", ())}, key=("code",), required=("d",), order=("d",), rules={"negative": "v < 0"})
    raw = spark.createDataFrame([("1.0", "2020-01-01", "1,5"), ("000001", "20200201", "2"), ("2", None, "1"), ("3", "2020-01-01", "-1"), ("", "2020-01-01", "1"), ("4", "2020/01/01", None)], "stkcd string, d string, v string")
    r = reference.build(spark, lambda name: raw, [spec], str(tmp_path)).first()
    assert (r["read"], r["refused"], r["kept"]) == (6, 3, 2)
    kept = {x.code: x.v for x in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert kept == {"000001": 2.0, "000004": None}
    later = reference.load_reference(raw.where("stkcd = '4'").withColumn("v", F.lit("9")), spec, spark.read.parquet(str(tmp_path / "t")))
    assert {x.code: x.v for x in later.collect()} == {"000001": 2.0, "000004": 9.0}
    with pytest.raises(ValueError):
        reference.parsed(raw.drop("stkcd"), spec)
    with pytest.raises(ValueError):
        reference.build(spark, lambda name: raw, [spec], str(tmp_path), ["other"])
    folder = tmp_path / "raw" / "t"
    raw.write.option("header", True).csv(str(folder))
    (tmp_path / "s.json").write_text(json.dumps([{"name": "t", "columns": {"code": ["code", ["Stkcd"]], "d": ["date", []]}, "key": ["code"], "required": ["d"]}]))
    reference.main(["--raw", str(tmp_path / "raw"), "--spec", str(tmp_path / "s.json"), "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out" / "t")).count() == 3


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("<a> & b", 1.5, D(2020, 1, 2), True), (None, None, None, None), ("x\x01y", float("nan"), D(2021, 1, 2), False)], "s string, v double, d date, f boolean")
    path = str(tmp_path / "r.xlsx")
    workbook_sink.write_workbook({"one/two": df, "ONE_two": df.limit(0)}, path)
    rows = list(workbooks.rows_of(path))
    assert [c for s, _, c in rows if s == "one_two"] == [["s", "v", "d", "f"], ["<a> & b", "1.5", "2020-01-02", "1"], [None] * 4, ["xy", None, "2021-01-02", "0"]]
    assert [s for s, _, _ in rows][-1] == "ONE_two_2"
    assert workbook_sink._letters(27) == "AB" and workbook_sink.sheet_names([""]) == ["Sheet1"]


def test_alpha_edges(spark):
    cols = "model_date int, code string, industry_group string, parent_net_profit_ttm double, operating_cashflow_ttm double, total_market_cap double, float_market_cap double, total_assets double, total_liabilities double, parent_equity double, revenue_growth double, earnings_growth double"
    rows = [(1, "a", "g", 10.0, None, 100.0, None, 50.0, 20.0, -1.0, 0.2, None), (1, "b", "h", 5.0, 4.0, None, 300.0, 0.0, 1.0, 1.0, None, None)]
    got = {r.code: r for r in alpha.weekly_alpha(spark.createDataFrame(rows, cols)).collect()}
    assert got["a"].earnings_yield_raw == pytest.approx(0.1) and got["b"].earnings_yield_raw is None
    assert got["a"].market_industry_weight == pytest.approx(0.25) and got["a"].growth_raw == pytest.approx(0.2) and got["b"].growth_raw is None
    assert got["a"].quality_raw is None  # below 20 names
    day = lambda *k: spark.createDataFrame([(x,) for x in k], "model_date int")
    todo = lambda w, b: sorted(r[0] for r in alpha.dates_to_build(w, b).collect())
    assert todo(day(1, 2, 3), day(1, 2)) == [3] and todo(day(2, 3), day(1, 2)) == [2, 3] and todo(day(1, 2), day(1).limit(0)) == [1, 2]


def test_no_task_of_the_alpha_inputs_holds_a_date(spark, sf):
    """Windows over a date, and maps of its distinct values, grow with the table where dates are few."""
    plan = entry.queries()["weekly_alpha"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan and plan.count("Window") <= 1  # of sums by group


def test_group_percentiles_are_exact(spark, monkeypatch):
    """With ties, nulls, NaN, missing keys, small groups, and where a sketch gives edges that miss."""
    rng = np.random.default_rng(5)
    rows = [(1, float(v), float(w)) for v, w in zip(rng.normal(size=30000) ** 3, rng.integers(0, 3, 30000), strict=True)]
    rows += [(2, float(i % 7), None) for i in range(40)] + [(None, 5.0, float("nan")), (None, 6.5, 1.0), (None, None, float("inf")), (3, None, None)]
    df = spark.createDataFrame(rows, "k int, v double, w double").repartition(5).cache()
    points = [0.01, 0.5, 0.99]
    want = {r.k: r for r in df.groupBy("k").agg(*[F.percentile(c, F.array(*map(F.lit, points))).alias(c) for c in "vw"]).collect()}
    sketch = F.percentile_approx
    for moved in (0, 100):
        monkeypatch.setattr(F, "percentile_approx", lambda c, *at, moved=moved: sketch(F.col(c) + moved, *at))
        got = {r.k: r for r in crosssection.group_percentiles(df, {"v": "v", "w": "w"}, ["k"], points).collect()}
        assert set(got) == {1, 2, None}
        for k, r in got.items():
            for c in "vw":
                assert (r[c] is None and want[k][c] is None) or np.array_equal(r[c], want[k][c], equal_nan=True), (moved, k, c)
    names = {"v": "a", "w": "b"}
    one = crosssection.robust_z(crosssection.robust_z(df, "v", ["k"], "a"), "w", ["k"], "b")
    key = lambda x: sorted(str([None if c is None else round(c, 9) + 0.0 for c in r]) for r in x.select("k", "v", "w", "a", "b").collect())
    assert key(one.where("k is not null")) == key(crosssection.wide_robust_z(df, names, ["k"]).where("k is not null"))
    df.unpersist()


def test_planted_factors_get_their_verdicts(spark, sf):
    p = evaluation.planted_panel(spark, sf).cache()
    assert p.count() == p.select("date", "code").distinct().count() > 3000
    assert p.agg(F.sum("premium")).first() == evaluation.planted_panel(spark, sf).agg(F.sum("premium")).first()
    out = evaluation.gates(p, ["premium", "stepped"], evaluation.CONTROLS)
    assert [(r.era, r.control) for r in out["constant controls"].collect()] == [("train", "frozen")]
    usable = {r.factor: r.usable_share for r in out["groupability"].collect()}
    assert usable == {"premium": 1.0, "stepped": 0.0}
    assert [(r.a, r.b) for r in evaluation.gates(p, ["premium"], ["discount", "shadow", "lot"])["collinear controls"].collect()] == [("discount", "shadow")]
    own = [f for f in evaluation.FACTORS if f != "stepped"]
    verdict = {r.factor: r.survived for r in evaluation.reversal(p, own, ["discount", "lot", "price"])["reversal retest"].collect()}
    assert verdict == {f: evaluation.VERDICTS[f] for f in own}
    told = {r.factor: r for r in evaluation.decoupling(p, ["premium", "fading"], [])["decoupling"].collect()}
    assert told["premium"].monotonicity == 1.0 and not told["premium"].avoidance_only and told["premium"].top_minus_pool > 0.01
    assert evaluation.profile(p, ["premium"], [])["quantile profile"].count() == 5
    p.unpersist()
    with pytest.raises(SystemExit):
        evaluation.main(["demo"])

"""The factor model against numpy: regressions, covariances, blocks of stock covariances and risk-aware weights."""

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitlake.operators import asof, attach, crosssection, evaluate, factors, risk_aware

D = dt.date
STYLES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def history():
    rng = np.random.default_rng(0)
    rows = []
    for t in range(12):
        n = 60
        g, cap, x = rng.integers(0, 4, n), rng.uniform(0.2, 90, n), rng.normal(size=(n, 3))
        y = rng.normal(size=n) * 0.02 + 0.01 * x[:, 0]
        y[:4] += 0.5
        rows += [(D(2020, 1, 3) + dt.timedelta(7 * t), f"c{i}", f"g{g[i]}", float(cap[i]), float(y[i]), *map(float, x[i])) for i in range(n)]
    return pd.DataFrame(rows, columns=["model_date", "code", "industry_group", "cap", "forward_return", *STYLES])


def plain_fit(d, k=2.5, rounds=2):
    """The regression as a matrix of a constant, styles and constrained group dummies."""
    caps = d.groupby("industry_group")["cap"].sum().sort_index()
    base = caps.idxmax()
    others = [g for g in caps.index if g != base]
    of = d["industry_group"].to_numpy()
    x = np.column_stack([np.ones(len(d)), d[STYLES].to_numpy(), *[(of == g).astype(float) - caps[g] / caps[base] * (of == base) for g in others]])
    root = np.sqrt(np.maximum(d["cap"], 1))
    w = np.minimum(root, np.quantile(root, 0.99)).to_numpy()
    y, own = d["forward_return"].to_numpy(), w.copy()
    for _ in range(rounds):
        q = np.sqrt(own)
        beta = np.linalg.lstsq(x * q[:, None], y * q, rcond=None)[0]
        r = y - x @ beta
        scale = 1.4826 * np.median(abs(r - np.median(r)))
        if scale <= 1e-12:
            break
        own = w / np.maximum(abs(r - np.median(r)) / scale / k, 1)
    f = dict(zip(["MARKET", *STYLES, *others], beta))
    f[base] = -sum(caps[g] * f[g] for g in others) / caps[base]
    mean = (own * y).sum() / own.sum()
    return f, dict(zip(d["code"], r)), 1 - (own * r * r).sum() / (own * (y - mean) ** 2).sum()


def test_factor_returns_equal_the_regression(spark, history):
    holes = pd.concat([history, history.head(3).assign(code="x", cap=np.nan), history.head(3).assign(code="y", a=np.nan)])
    got = factors.factor_returns(spark.createDataFrame(holes), factors.RegressionSpec(tuple(STYLES))).toPandas()
    for day, own in history.groupby("model_date"):
        f, r, r2 = plain_fit(own)
        rows = got[got["model_date"] == day]
        named = lambda kind, rows=rows: dict(rows[rows["kind"] == kind][["name", "value"]].itertuples(index=False))
        assert named("factor") == pytest.approx(f, abs=1e-12) and named("specific") == pytest.approx(r, abs=1e-12)
        assert rows["r2"].to_numpy() == pytest.approx(r2)


def test_degenerate_cross_sections(spark, history):
    day = history[history["model_date"] == history["model_date"].min()]
    exact = day.assign(forward_return=0.01 + 0.002 * day["a"], b=1.0)  # no residuals, and a style without variance
    got = {r.name: r.value for r in factors.factor_returns(spark.createDataFrame(exact), factors.RegressionSpec(tuple(STYLES))).where("kind = 'factor'").collect()}
    assert got["MARKET"] == pytest.approx(0.01) and got["a"] == pytest.approx(0.002) and got["b"] == 0 and got["g0"] == pytest.approx(0, abs=1e-12)
    few = spark.createDataFrame(day.head(6))
    assert factors.factor_returns(few, factors.RegressionSpec(tuple(STYLES))).count() == 0
    assert factors.factor_returns(few.limit(0), factors.RegressionSpec(tuple(STYLES))).count() == 0


def plain_covariance(x, half_life, lags, shrink=0.1, periods=52):
    w = 0.5 ** (np.arange(len(x) - 1, -1, -1) / half_life)
    w /= w.sum()
    c = x - w @ x
    out = (c * w[:, None]).T @ c
    lags = min(lags, len(x) - 1)
    for lag in range(1, lags + 1):
        own = w[lag:] / w[lag:].sum()
        g = (c[lag:] * own[:, None]).T @ c[:-lag]
        out += (1 - lag / (lags + 1)) * (g + g.T)
    return ((1 - shrink) * out + shrink * np.diag(np.diag(out))) * periods


@pytest.mark.parametrize(("window", "lags"), [(6, 3), (20, 2), (3, 4), (5, 0)])
def test_covariances_of_all_weeks(spark, window, lags):
    rng = np.random.default_rng(4)
    days = [D(2020, 1, 3) + dt.timedelta(7 * t) for t in range(14)]
    rows = [(d, "factor", k, float(rng.normal())) for i, d in enumerate(days) for k in ("m", "s", "t", "u") if not (k == "t" and i % 3 == 1) and not (k == "u" and i < 9)]
    r = spark.createDataFrame(rows, "model_date date, kind string, name string, value double")
    got = factors.raw_covariances(r, window, 2, 5.0, lags).toPandas()
    wide = pd.DataFrame(rows, columns=["d", "kind", "k", "v"]).pivot(index="d", columns="k", values="v").sort_index()
    for i, d in enumerate(days):
        x = wide.iloc[max(0, i - window + 1) : i + 1]
        x = x[[k for k in x if x[k].notna().any()]].fillna(0.0)
        own = got[got["model_date"] == d]
        if len(x) < 2:
            assert own.empty
            continue
        own = own.pivot(index="factor_1", columns="factor_2", values="covariance")
        assert list(own) == list(x) and np.allclose(own.to_numpy(), plain_covariance(x.to_numpy(), 5.0, lags), atol=1e-12)
    asked = spark.createDataFrame([(D(2020, 3, 1),), (D(2019, 1, 1),), (days[-1],)], "model_date date")
    out = factors.factor_covariance(r, asked, window, 2, 5.0, lags).toPandas()
    assert set(out["model_date"]) == {D(2020, 3, 1), days[-1]}
    last = out[out["model_date"] == days[-1]].pivot(index="factor_1", columns="factor_2", values="covariance").to_numpy()
    assert np.linalg.eigvalsh(last).min() > 0


def test_the_floor_leaves_good_matrices_alone():
    a = np.random.default_rng(1).normal(size=(6, 6))
    good = a @ a.T
    assert np.array_equal(factors.nearest_psd(good), (good + good.T) / 2)
    bad = good - 2 * np.eye(6) * np.linalg.eigvalsh(good)[0] - np.eye(6)
    mended = factors.nearest_psd(bad)
    assert np.linalg.eigvalsh(bad)[0] < 0 < np.linalg.eigvalsh(mended)[0] and np.allclose(mended, mended.T)


def test_stock_covariance_in_blocks(spark):
    rng = np.random.default_rng(2)
    names = ["f0", "f1", "f2"]
    size = {("p", 1): 23, ("p", 2): 1, ("q", 1): 9}
    x = {k: rng.normal(size=(n, 3)) for k, n in size.items()}
    d = {k: rng.uniform(0.1, 1, n) for k, n in size.items()}
    f = rng.normal(size=(3, 3))
    f = f @ f.T
    exposures = spark.createDataFrame([(*k, f"c{i:02d}", names[j], float(v[i, j])) for k, v in x.items() for i in range(len(v)) for j in range(3) if not (j == 2 and i == 4)], "p string, t int, code string, factor string, value double")
    specific = spark.createDataFrame([(*k, f"c{i:02d}", float(v)) for k, own in d.items() for i, v in enumerate(own) if i != 3], "p string, t int, code string, specific_variance double")
    for t_scale, on in (({1: 1.0, 2: 1.0}, []), ({1: 1.0, 2: 3.0}, ["t"])):
        cov = [(t, a, b, float(s * f[i, j])) for t, s in (t_scale.items() if on else [(0, 1.0)]) for i, a in enumerate(names) for j, b in enumerate(names)]
        cov = spark.createDataFrame(cov, "t int, factor_1 string, factor_2 string, covariance double")
        got = risk_aware.stock_covariance(exposures, cov if on else cov.drop("t"), specific, ["p", "t"], on, 1.1, block=5).collect()
        assert len(got) == sum(n * (n + 1) // 2 for n in size.values()) == len({(r.p, r.t, r.code_1, r.code_2) for r in got})
        for r in got:
            own = x[(r.p, r.t)].copy()
            if len(own) > 4:
                own[4, 2] = 0
            i, j = int(r.code_1[1:]), int(r.code_2[1:])
            want = t_scale[r.t] * own[i] @ f @ own[j] + (d[(r.p, r.t)][i] if i == j and i != 3 else 0)
            assert i <= j and r.covariance == pytest.approx(1.21 * want)


def test_stock_covariance_of_portfolios_with_factors_of_their_own(spark):
    """What goes through the shuffle is a portfolio's own factors, once for each of at most ``most`` blocks; tiles of a few pairs give the whole."""
    rng = np.random.default_rng(3)
    f = rng.normal(size=(9, 9))
    f = f @ f.T
    x = {(p, c): {0: 1.0, p + 1: float(rng.normal())} for p in range(8) for c in range(30)}
    exposures = spark.createDataFrame([(p, c, f"f{j}", v) for (p, c), own in x.items() for j, v in own.items()], "p int, code int, factor string, value double")
    cov = spark.createDataFrame([(f"f{i}", f"f{j}", float(f[i, j])) for i in range(9) for j in range(9)], "factor_1 string, factor_2 string, covariance double")
    specific = spark.createDataFrame([(p, c, 0.5) for p, c in x], "p int, code int, specific_variance double")
    out = risk_aware.stock_covariance(exposures, cov, specific, ["p"], block=2, most=3)
    got = {(r.p, r.code_1, r.code_2): r.covariance for r in out.collect()}
    assert len(got) == 8 * 30 * 31 // 2
    for (p, a, b), v in got.items():
        want = sum(u * w * f[i, j] for i, u in x[(p, a)].items() for j, w in x[(p, b)].items()) + (0.5 if a == b else 0)
        assert a <= b and v == pytest.approx(want)
    names, d = pa.array(rng.permutation(50)), rng.uniform(size=50)
    y = rng.normal(size=(50, 9))
    whole = y @ f @ y.T + np.diag(d)
    tiles = list(risk_aware._tiles(names, y, d, None, y, f, 1.0, pairs=200))
    assert len(tiles) > 10 and max(len(t[0]) for t in tiles) <= 200
    at = {c: i for i, c in enumerate(names.to_pylist())}
    cells = [(a, b, v) for t in tiles for a, b, v in zip(*(z.to_pylist() for z in t), strict=True)]
    assert len(cells) == 50 * 51 // 2 and all(a <= b and v == pytest.approx(whole[at[a], at[b]]) for a, b, v in cells)


def test_stock_covariance_reads_its_lines_once(spark, sf):
    """Four times the shuffle of the lines, and years held by one task each, were more disk than the limit."""
    plan = entry.queries()["stock_covariance"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem.parquet" not in plan and "l_extendedprice" not in plan and "Window" not in plan and "percentile(" not in plan
    assert plan.count("collect_list(") == 1  # codes are gathered once, and go to the pairs of blocks as rows


def test_wide_style_exposures_are_those_by_windows(spark):
    rng = np.random.default_rng(8)
    rows = [(int(t), f"g{i % 4}", float(rng.uniform(1, 99)), None if t > 1 and rng.random() < 0.1 or t == 3 and i % 4 == 1 else float(rng.normal() ** 3), 2.0 if t < 3 else None) for t in (1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "date int, g string, cap double, a double, b double")
    for part in (df, df.where("date = 1")):  # the last without missing values
        f = lambda x: sorted((r.date, r.g, r.cap, round(r.a, 9), round(r.b, 9)) for r in x.collect())
        got, want = (f(x(part, "cap", ["a", "b"], ["date"], "g").select("date", "g", "cap", "a", "b")) for x in (crosssection.wide_style_exposures, crosssection.style_exposures))
        assert len(got) == part.count() and got == want


def overlay(spark, weights, variances, groups=("10", "20"), **kw):
    codes = ["000001", "000002", "000003"][: len(weights)]
    day = D(2024, 1, 5)
    t = spark.createDataFrame([(day, c, w) for c, w in zip(codes, weights)], "decision_date date, code string, weight double")
    x = spark.createDataFrame([(day, c, "MARKET", 1.0) for c in codes], "decision_date date, code string, factor string, value double")
    own = spark.createDataFrame([(day, c, g, v) for c, g, v in zip(codes, groups, variances)], "decision_date date, code string, industry_group string, specific_variance double")
    f = spark.createDataFrame([(day, "MARKET", "MARKET", 0.0)], "decision_date date, factor_1 string, factor_2 string, covariance double")
    return {r.code: r for r in risk_aware.risk_aware_weights(t, x, own, f, risk_aware.Overlay(**kw)).collect()}


def test_weight_moves_to_the_calmer_stock(spark):
    out = overlay(spark, [0.5, 0.5], [0.36, 0.04], stock_cap=1.0, group_fraction=1.0, strength=0.5, target_volatility=1.0, least_scale=1.0)
    # Least loss by hand: (w - 1/2)^2 * 2 + (0.36 w^2 + 0.04 (1 - w)^2) / 2 is least at w = 1.02 / 2.2, half of 2.04 / 2.2.
    assert out["000001"].weight == pytest.approx(1.02 / 2.2, abs=2e-3) and out["000001"].weight + out["000002"].weight == pytest.approx(1)
    assert out["000001"].volatility_optimised < out["000001"].volatility_before == pytest.approx(0.1**0.5)


def test_volatility_limit_scales_the_total(spark):
    kw = dict(stock_cap=1.0, group_fraction=1.0, strength=0.0, target_volatility=0.10)
    out = overlay(spark, [0.5, 0.5], [0.04, 0.04], least_scale=0.5, **kw)
    assert out["000001"].volatility_after == pytest.approx(0.10) and out["000001"].weight == pytest.approx(0.5 * 0.1 / 0.02**0.5)
    held = overlay(spark, [0.5, 0.5], [0.04, 0.04], **kw)
    assert held["000001"].scale == 0.8 and held["000001"].weight == pytest.approx(0.4)


def test_caps_bind_and_unknown_risk_keeps_the_target(spark):
    out = overlay(spark, [0.5, 0.3, 0.2], [0.09, 0.09, 0.09], ("10", "10", "20"), stock_cap=0.4, group_fraction=0.6, strength=0.5, target_volatility=5.0)
    w = [out[c].weight for c in sorted(out)]
    assert max(w) <= 0.4 + 1e-9 and w[0] + w[1] <= 0.6 + 1e-9 and sum(w) == pytest.approx(1.0)
    kept = overlay(spark, [0.5, 0.5], [0.09, None])
    assert kept["000001"].weight == 0.5 and kept["000001"].volatility_before is None
    assert np.allclose(risk_aware.capped(np.array([3.0, 1.0, np.nan]), np.array(list("aab")), 1.0, 0.5, 0.8), [0.4, 0.4, 0.2])
    assert risk_aware.capped(np.zeros(4), np.array(list("abcd")), 0.8, 0.3, 0.3).tolist() == [0.2] * 4
    assert risk_aware.capped(np.ones(2), np.array(list("ab")), 0.0, 0.3, 0.3).tolist() == [0.0, 0.0]


def test_descent_against_a_dense_matrix():
    rng = np.random.default_rng(3)
    x, f, d = rng.normal(size=(20, 4)), np.diag([0.04, 0.02, 0.01, 0.03]), rng.uniform(0.05, 0.3, 20)
    group = np.array(list("abcd" * 5))
    base = risk_aware.capped(rng.random(20), group, 0.9, 0.1, 0.4)
    spec = risk_aware.Overlay(group_fraction=0.4, strength=0.5, target_volatility=0.3, least_scale=1.0, iterations=300)
    w, report = risk_aware.optimised(base, group, risk_aware.Factored(x, f, d), spec)
    dense = x @ f @ x.T + np.diag(d)
    loss = lambda v: 0.5 * ((v - base) ** 2).sum() / (base @ base) + 0.5 * (v @ dense @ v) / 0.09
    assert report["volatility_optimised"] == pytest.approx((w @ dense @ w) ** 0.5) and loss(w) < loss(base)
    for _ in range(200):  # no feasible neighbour is better by much
        v = risk_aware.capped(w + rng.normal(size=20) * 0.003, group, 0.9, 0.1, 0.36)
        assert loss(v) > loss(w) - 2e-3


def test_ladder_equals_regressions(spark, history):
    holes = history.assign(date=history["model_date"], b=np.where(np.arange(len(history)) % 7 == 0, np.nan, history["b"]), flat=1.0, twice=2 * history["a"] - 1)
    p = spark.createDataFrame(holes)
    got = {(r.date, r.layer): r.slope for r in evaluate.layer_slopes(p, "a", {"raw": [], "b": ["b", "flat"], "bc": ["b", "c"], "twin": ["twice"]}, least=20).collect()}
    assert len(got) == 36
    for (day, layer), slope in got.items():
        own = holes[holes["date"] == day].dropna(subset=["b"] if layer != "raw" else [])
        x = own[["a", *{"raw": [], "b": ["b"], "bc": ["b", "c"]}[layer]]].to_numpy()
        x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
        assert slope == pytest.approx(np.linalg.lstsq(x, own["forward_return"].to_numpy(), rcond=None)[0][1])


def test_rows_of_unknown_time_or_key_match_nothing(spark):
    left = spark.createDataFrame([("a", D(2020, 1, 1), 1), ("a", D(2022, 1, 1), 2), (None, D(2022, 1, 1), 3), ("a", None, 4), ("b", D(2022, 1, 1), 5), (None, D(2022, 1, 1), 3)], "k string, d date, i int")
    right = spark.createDataFrame([("a", None, 9.0), ("a", D(2021, 1, 1), 1.0), (None, D(2021, 1, 1), 5.0), ("b", None, 7.0)], "k string, e date, v double")
    got = sorted((r.i, r.v, r.e_asof) for r in asof.asof_join(left, right, ["k"], "d", "e", ["v"]).collect())
    assert [(i, v) for i, v, _ in got] == [(1, None), (2, 1.0), (3, None), (3, None), (4, None), (5, None)] and got[1][2] == D(2021, 1, 1)
    strict = asof.asof_join(left, right.withColumn("e", F.lit(D(2022, 1, 1))), ["k"], "d", "e", ["v"], strict=True)
    assert strict.where("v is not null").count() == 0
    newest = asof.newest_period_asof(left.select("k", "d"), spark.createDataFrame([("a", None, 3, 8.0), ("a", D(2021, 1, 1), 1, 2.0), (None, D(2021, 1, 1), 2, 4.0)], "k string, e date, p int, v double"), ["k"], "d", "e", "p", ["v"])
    assert sorted(r.v for r in newest.collect() if r.v is not None) == [2.0]
    h = spark.createDataFrame([("a", "P1", None, "K70"), ("b", "P1", D(2020, 1, 1), "C39"), (None, "P1", D(2020, 1, 1), "X1")], "k string, classification_id string, implement_date date, industry_code string")
    out = asof.prioritised_group_asof(left.where("d is not null").select("k", "d", "i"), h, "k", "d", [("P1", "2021-06-01")], 1)
    assert sorted((r.i, r.industry_group) for r in out.collect()) == [(1, "UNKNOWN"), (2, "UNKNOWN"), (3, "UNKNOWN"), (3, "UNKNOWN"), (5, "C")]
    rows = left.select(F.col("d").alias("date"), F.col("k").alias("code"))
    snaps = spark.createDataFrame([(None, "a", 9.0), (D(2021, 1, 1), "a", 1.0), (D(2021, 1, 1), None, 3.0)], "s date, code string, alpha double")
    seen = attach.augment(rows, snaps, "date", "s", "code", ["alpha"], 1000).collect()
    assert len(seen) == 6 and [r.alpha for r in seen if r.alpha is not None] == [1.0] and sum(r.snapshot_status == "no_causal_snapshot" for r in seen) == 2

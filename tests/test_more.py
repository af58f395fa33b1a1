import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pitlake.functions import sql
from pitlake.operators import reports, scoring
from pitlake.plans import config

D = dt.date


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT a_board('688001') b, a_legal_shares('688001', 205.7) s, a_legal_shares('000001', 199) l, a_legal_shares('000001', 99) z, a_tick(10.001, 'BUY') t").first()
    assert tuple(r) == ("STAR", 205, 100, 0, 10.01)


def test_config(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"count": 5}))
    (tmp_path / "b.json").write_text(json.dumps({"extends": "a.json", "equity": 0.5}))
    (tmp_path / "c.json").write_text(json.dumps({"extends": "c.json"}))
    (tmp_path / "d.json").write_text(json.dumps({"nonsense": 1}))
    s = config.load(tmp_path / "b.json")
    assert (s.count, s.equity) == (5, 0.5)
    for bad in ("c.json", "d.json"):
        with pytest.raises(ValueError):
            config.load(tmp_path / bad)
    assert config.weight_map({"x": 2, "y": -1}, ["x", "y"]) == {"x": 1.0, "y": 0.0}
    assert config.weight_map({}, ["x", "y"]) == {"x": 0.5, "y": 0.5}
    tiers = [(0, 50000, "small"), (50000, 300000, "mid"), (300000, None, "large")]
    assert [config.route(c, tiers) for c in (49999, 50000, 1e9)] == ["small", "mid", "large"]
    with pytest.raises(ValueError):
        config.route(1, [(0, 10, "a"), (20, None, "b")])


def test_account_report(spark):
    pos = spark.createDataFrame([("000001", 100, 9.0), ("000002", 10, 5.0), ("CASH", 0, 950.0)], "code string, shares long, cost_price double")
    prices = spark.createDataFrame([("000001", D(2024, 1, 2), 9.5), ("000001", D(2024, 1, 3), 10.0)], "code string, trade_date date, close double")
    w = reports.account_weights(pos, prices)
    got = {r.code: (r.value, r.weight) for r in w.collect()}
    assert got == {"000001": (1000.0, 0.5), "000002": (50.0, 0.025), "CASH": (950.0, 0.475)}
    x = spark.createDataFrame([("000001", "MARKET", 1.0), ("000002", "MARKET", 1.0)], "code string, factor string, value double")
    cov = spark.createDataFrame([("MARKET", "MARKET", 0.04)], "factor_1 string, factor_2 string, covariance double")
    own = spark.createDataFrame([("000001", 0.09)], "code string, specific_variance double")
    r = reports.account_risk(w, x, cov, own).first()
    assert r.volatility == pytest.approx((0.04 * 0.525**2 + 0.25 * 0.09) ** 0.5) and r.coverage == pytest.approx(0.5 / 0.525)


def test_covariance_validation(spark):
    rows = [(D(2024, 1, 5), a, b, 0.04 if a == b else 0.01) for a in "xy" for b in "xy"] + [(D(2024, 1, 12), a, b, 1.0 if a == b else 2.0) for a in "xy" for b in "xy"]
    got = {r.model_date.day: r for r in reports.validate_covariance(spark.createDataFrame(rows, "model_date date, factor_1 string, factor_2 string, covariance double")).collect()}
    assert got[5].complete and got[5].symmetric and got[5].least_eigenvalue > 0 > got[12].least_eigenvalue


def test_replacement_policies(spark):
    rows = spark.createDataFrame([(1, "a", 0.010, True), (1, "b", 0.012, False), (1, "c", 0.030, False)], "d int, code string, e double, held boolean")
    pick = lambda p: {r.code for r in scoring.keep_or_replace(rows, "d", "e", 0.005, 2, p).collect()}
    assert pick("none") == {"b", "c"} and pick("cost_aware") == {"a", "c"} and pick("always") == {"a", "c"}


def test_satellite_blend(spark):
    scored = spark.createDataFrame([(1, "g", 1.0, 0.0), (1, "g", 2.0, 5.0), (1, "h", 3.0, 1.0)], "d int, grp string, base double, tilt double")
    sat = spark.createDataFrame([(1, "g", 1.0)], "d int, grp string, strength double")
    out = scoring.blend_satellite(scored, sat, "d", "grp", "base", "tilt", 0.3, F.lit(0.5)).collect()
    assert sorted(r.satellite_weight for r in out) == [0.0, 0.15, 0.15]


def test_shuffles_begin_with_partitions_by_the_size_of_the_input(spark, sf, monkeypatch):
    from pitlake.operators import quality
    from pitlake.plans import views

    first = lambda: int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    want = quality.panel_checks(views.panel(spark, sf), ["code", "trade_date"]).collect()
    assert first() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # a small table
    monkeypatch.setattr(views, "FILES", 2000)
    rows = views.panel(spark, sf)
    assert first() > 20 and int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == views.PARTITION
    assert quality.panel_checks(rows, ["code", "trade_date"]).collect() == want
    monkeypatch.undo()
    views.panel(spark, sf)


def test_weighted_views_equal_the_windows(spark):
    from pitlake.operators import crosssection as X

    rows = [(i, 1990 + i % 2, None if i % 7 == 0 else i * 0.5, None if i % 11 == 0 else i * i * 1.0, None if i % 13 == 0 else 1.0 + i % 5, None if i % 17 == 0 else f"g{i % 3}") for i in range(80)] + [(99, 1995, 1.0, 2.0, 3.0, "g")]
    x = spark.createDataFrame(rows, "code long, date int, size double, amount double, cap double, g string")
    cap, by = F.col("cap"), ["date"]
    want = x.select("code", X.weighted_standardise(F.col("size"), cap, by).alias("a"), X.weighted_residual(F.col("amount"), F.col("size"), cap, by).alias("b"), X.cap_share(cap, by, "g").alias("c"))
    got = X.weighted_views(x, "size", "amount", "cap", by, "g").select("code", "standard", "residual", "share")
    near = lambda r: tuple(None if v is None else round(v, 7) for v in r)
    assert sorted(map(near, got.collect()), key=str) == sorted(map(near, want.collect()), key=str)

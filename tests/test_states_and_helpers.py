import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.functions import trading as T
from pitlake.operators import portfolio, quality
from pitlake.sources import panels, states
from pitlake.sources.manifest import SourceStore

D = dt.date


def test_account_states_belong_to_their_accounts(spark, tmp_path):
    store = SourceStore(spark, str(tmp_path / "s"), states.SCHEMA)
    make = lambda *rows: spark.createDataFrame(list(rows), "account string, state string")
    states.save(store, make(("a1", json.dumps({"account_id": "a1", "cash": 1.0})), (" a2 ", json.dumps({"cash": 5, "account_id": "a2"}))))
    got = states.load(store, ["a1", "a2", "a3"])
    assert json.loads(got["a1"]) == {"account_id": "a1", "cash": 1} and got["a2"] == '{"account_id":"a2","cash":5}' and got["a3"] is None
    for bad in ('{"cash": 1}', '{"account_id": "a2"}', "[1]", "{x", None):
        with pytest.raises(ValueError, match="saved"):
            states.save(store, make(("a1", bad), ("a2", '{"account_id": "a2"}')))
    states.save(store, make(("a1", '{"account_id": "a1", "cash": 2}')))
    assert json.loads(states.load(store, ["a1"])["a1"])["cash"] == 2 and states.load(store, ["a2"])["a2"] == got["a2"]
    foreign = spark.createDataFrame([("a9", '{"account_id": "a1"}', "a9")], "account string, state string, source string")
    store.replace(foreign, spark.createDataFrame([("a9", 1, 1, 1)], "source string, size long, mtime long, number long"))
    with pytest.raises(ValueError, match="a9: other account"):
        states.load(store, ["a1", "a9"])
    with pytest.raises(ValueError, match="bad account"):
        states.load(store, ["-x"])


def test_renamed_columns_defaults_and_bounds(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Code,w\na,0.5\nb,9\nc,\n")
    got = panels.read_renamed(spark, str(tmp_path / "in.csv"), {"code": ["Code"], "weight": ["w"], "note": []}, {"weight": 0.1, "note": "x"}, {"weight": (0.0, 1.0)})
    assert [tuple(r) for r in got.orderBy("code").collect()] == [("a", 0.5, "x"), ("b", 1.0, "x"), ("c", 0.1, "x")]
    assert panels.optional_table(spark, "no_such_table", "a int").count() == 0


def test_round_trip_cost(spark):
    r = spark.range(1).select(*[T.round_trip_cost(F.lit(v), F.lit("600000"), F.lit("000001"), F.lit(D(2024, 1, 5)), 0.0003, 5.0).alias(f"c{i}") for i, v in enumerate((10000.0, 100000.0, 0.0))]).first()
    # Small orders pay the least commission twice: at 10,000 that is 10 of cost beside stamp, handling, regulation and transfer.
    rates = 0.0005 + 2 * (0.0000341 + 0.00002 + 0.00001)
    assert r.c0 == pytest.approx(rates + 10 / 10000) and r.c1 == pytest.approx(rates + 2 * 0.0003) and np.isinf(r.c2)


def test_coverage(spark):
    rows = spark.createDataFrame([("x", 1.0, None), ("x", 2.0, 1.0), ("y", None, None)], "g string, a double, b double")
    got = {r.g: (r["rows"], r.a_coverage, r.b_coverage) for r in quality.coverage_by(rows, ["g"], ["a", "b"]).collect()}
    assert got == {"x": (2, 1.0, 0.5), "y": (1, 0.0, 0.0)}
    quality.require_coverage(rows, ["a"], 0.6)
    with pytest.raises(ValueError, match="b"):
        quality.require_coverage(rows, ["a", "b"], 0.5)
    with pytest.raises(ValueError):
        quality.require_coverage(rows.limit(0), ["a"])


def test_lots_of_a_portfolio(spark):
    rows = [(D(2024, 1, 5), "a", 0.5, 10.0, 100, 100), (D(2024, 1, 5), "b", 0.4, 33.0, 200, 1), (D(2024, 1, 5), "c", 0.1, None, 100, 100), (D(2024, 1, 6), "a", 0.0, 10.0, 100, 100)]
    df = spark.createDataFrame(rows, "decision_date date, code string, weight double, price double, min_lot int, lot_step int")
    got = {(r.decision_date, r.code): r.shares for r in portfolio.lots(df, 20000.0).collect()}
    assert got == {(D(2024, 1, 5), "a"): 1000, (D(2024, 1, 5), "b"): 242}


def test_stage_hashes_follow_what_a_stage_depends_on():
    from pitlake.plans import config

    stages = {"raw": ["start", "beta"], "model": None}
    a = {"start": "2019-01-01", "beta": 252, "caps": {"x": 1, "y": None}, "model_end_date": "2024-01-01"}
    h = config.stage_hashes(a, stages, "1")
    assert h == config.stage_hashes({"caps": {"y": None, "x": 1}, "model_end_date": "2025-01-01", "beta": 252, "start": "2019-01-01"}, stages, "1")
    other = config.stage_hashes({**a, "caps": {"x": 2, "y": None}}, stages, "1")
    assert other["raw"] == h["raw"] and other["model"] != h["model"]
    below = config.stage_hashes({**a, "beta": 120}, stages, "1")
    assert below["raw"] != h["raw"] and below["model"] != h["model"] and config.stage_hashes(a, stages, "2")["raw"] != h["raw"]
    assert config.extends_horizon(a, {**a, "model_end_date": "2024-02-01"}) and not config.extends_horizon(a, {**a, "model_end_date": "2023-12-01"})
    assert not config.extends_horizon(a, {**a, "beta": 1})


def test_feather_panels(spark, tmp_path):
    import pandas as pd
    from pyarrow import feather

    for k in range(2):
        df = pd.DataFrame({"date": ["2024-01-05", "20240112"], "code": [1, 2], "forward_return": [0.1, float("inf")], "f": ["x", "2.5"], "era": "train"})
        feather.write_feather(df, str(tmp_path / f"p{k}.feather"), compression="zstd" if k else "uncompressed")
    got = panels.read_panel(spark, str(tmp_path / "*.feather")).orderBy("date", "code").collect()
    assert len(got) == 4 and got[0].code == "1" and got[0].f is None and got[3].forward_return is None and got[3].date == D(2024, 1, 12) and got[3].f == 2.5
    with pytest.raises(ValueError, match="lacks"):
        panels.read_panel(spark, str(tmp_path / "p0.feather"), ("date", "beta"))

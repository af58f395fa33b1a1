"""Interval joins, adjusted prices and canonical settings against plain Python."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.functions import columns as C
from pitlake.operators import adjust

D = dt.date


def day(n):
    return D(2019, 11, 20) + dt.timedelta(int(n))


@pytest.mark.parametrize("bucket", [1, 7, 400])
def test_interval_join_against_all_pairs(spark, bucket):
    rng = np.random.default_rng(bucket)
    left = [(str(rng.choice(["a", "b", "c"])), day(rng.integers(0, 200)), i) for i in range(80)] + [(None, day(5), 80), ("a", None, 81)]
    spans = []
    for v in range(40):
        a = int(rng.integers(-30, 220))
        spans.append((str(rng.choice(["a", "b"])), day(a), None if rng.random() < 0.2 else day(a + rng.integers(-2, 60)), v))
    spans += [(None, day(0), None, 40), ("a", None, day(9), 41)]
    rows = spark.createDataFrame(left, "k string, d date, i int")
    got = adjust.interval_join(rows, spark.createDataFrame(spans, "k string, s date, e date, v int"), ["k"], "d", "s", "e", ["v"], bucket)
    want = []
    for k, d, i in left:
        hits = [v for c, s, e, v in spans if k and c == k and d and s and s <= d and (e is None or d < e)]
        want += [(i, v) for v in hits or [None]]
    assert sorted(((r.i, r.v) for r in got.collect()), key=str) == sorted(want, key=str)
    none = adjust.interval_join(rows.limit(0), spark.createDataFrame(spans, "k string, s date, e date, v int"), ["k"], "d", "s", "e", ["v"], bucket)
    assert none.count() == 0


def test_adjusted_prices_by_hand(spark):
    prices = spark.createDataFrame([("a", D(2020, 1, 1), 20.0), ("a", D(2020, 1, 2), 10.0), ("a", D(2020, 3, 1), 5.0), ("b", D(2020, 1, 1), 7.0)], "code string, d date, close double")
    events = spark.createDataFrame([("a", D(2020, 1, 2), 2.0), ("a", D(2020, 2, 1), 2.0), ("a", D(2020, 2, 1), 1.5), ("a", D(2020, 2, 2), None), ("a", D(2020, 2, 3), -1.0), (None, D(2020, 1, 1), 3.0)], "code string, ex date, f double")
    got = {(r.code, r.d): (r.backward_factor, r.backward_price, r.forward_price) for r in adjust.adjusted_prices(prices, events, ["code"], "d", "close", "ex", "f").collect()}
    assert got[("a", D(2020, 1, 1))] == pytest.approx((1.0, 20.0, 20.0 / 6)) and got[("a", D(2020, 1, 2))] == pytest.approx((2.0, 20.0, 20.0 / 6))
    assert got[("a", D(2020, 3, 1))] == pytest.approx((6.0, 30.0, 5.0)) and got[("b", D(2020, 1, 1))] == (1.0, 7.0, 7.0)


def test_no_limit_days_and_closing_views(spark):
    daily = spark.createDataFrame([("a", D(2020, 1, 1), 1.0, None, "x"), ("a", D(2020, 1, 2), 2.0, 1.0, "y"), ("b", D(2020, 1, 1), 3.0, 0.1, "z")], "code string, trade_date date, close double, daily_return double, name string")
    free = spark.createDataFrame([("a", D(2020, 1, 2), "resumed"), ("a", D(2020, 1, 2), "listed"), (None, D(2020, 1, 1), "x")], "code string, trade_date date, reason string")
    out = adjust.closing_views(adjust.with_no_limit(daily, free, ["code"], "trade_date"))
    assert {(r.code, r.latest_close, r.name) for r in out["stock_meta"].collect()} == {("a", 2.0, "y"), ("b", 3.0, "z")}
    assert {(r.code, r.no_limit, r.no_limit_reason) for r in out["latest_prices"].collect()} == {("a", 1, "listed"), ("b", 0, None)}
    assert out["returns"].count() == 2


def test_canonical_json(spark):
    texts = ['{"b": 1.0, "a": {"z": null, "y": [1, 2.50, {"q": 1e3, "p": "é \\" x"}]}}', '{"a":{"y":[1.00,2.5,{"p":"é \\" x","q":1000}],"z":null},"b":1}', "{}", "[1, [], \"1.0\"]", "no json", None]
    got = [r.j for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(C.canonical_json(F.col("t")).alias("j")).collect()]
    plain = json.loads(texts[1])
    plain["b"], plain["a"]["y"][0] = 1, 1
    assert got[0] == got[1] == json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[2:] == ["{}", '[1,[],"1.0"]', None, None]
    a, b = F.struct(F.lit(1).alias("x"), F.lit(None).cast("int").alias("y")), F.struct(F.lit(None).cast("int").alias("y"), F.lit(1).alias("x"))
    r = spark.range(1).select(C.config_hash(a.alias("s"), F.lit("v").alias("k")).alias("p"), C.config_hash(F.lit("v").alias("k"), b.alias("s")).alias("q"), C.config_hash(a.alias("s")).alias("o")).first()
    assert r.p == r.q != r.o and len(r.p) == 64


def test_numbers_of_canonical_json_at_any_size(spark):
    """As Python and DuckDB write doubles, without ``.0``; whole numbers of any length stay exact."""
    values = [0.0001, -0.00034921, 9999999.99, 1e7, 12345678.9, 45169500.0, -0.0, 0.0, 4.51695e16, 1e-5]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    got = [r.j for r in rows.select(C.canonical_json(F.to_json(F.struct("v"))).alias("j")).collect()]
    assert got == ['{"v":' + repr(v).removesuffix(".0") + "}" for v in values]
    texts = ["[100000000000000001.00, 1.50E1, 123456789012345678901234567890]", '{"a":"-0.0, 1e9 \\\\"}', '{"a":1,"a":2}', "[NaN]", "[1,]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r.j for r in rows.select(C.canonical_json(F.col("t")).alias("j")).collect()] == ["[100000000000000001,15,123456789012345678901234567890]", '{"a":"-0.0, 1e9 \\\\"}', None, None, None]


def test_dates_of_serials_beyond_the_usual_bound(spark):
    r = spark.range(1).select(C.parse_date(F.lit("70022")).alias("none"), C.parse_date(F.lit("70022"), (20000, 2**31 - 1)).alias("day")).first()
    assert r.none is None and r.day == D(2091, 9, 16)

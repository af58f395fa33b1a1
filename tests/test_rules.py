"""Literal vectors of the exchange rules and parsers."""

import pytest
from pyspark.sql import functions as F

from pitlake.functions import columns as C
from pitlake.functions import trading as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def cost(spark, gross, side, code, day, shares, commission=0.0, minimum=0.0):
    return value(spark, T.trade_cost(F.lit(gross), F.lit(side), F.lit(code), F.lit(day).cast("date"), F.lit(shares), commission, minimum))


def test_costs(spark):
    assert cost(spark, 1.0, "SELL", "000001", "2021-01-05", 0) == pytest.approx(0.0010887)
    assert cost(spark, 1.0, "SELL", "000001", "2024-01-05", 0) == pytest.approx(0.0005641)
    assert cost(spark, 10000.0, "BUY", "600000", "2010-01-05", 1000) == pytest.approx(2.0)
    assert cost(spark, 10000.0, "BUY", "000001", "2010-01-05", 1000) == pytest.approx(1.875)
    assert cost(spark, 1000.0, "BUY", "000001", "2024-01-05", 100, 0.0003, 5.0) == pytest.approx(5.0641)
    assert cost(spark, 20000.0, "SELL", "000001", "2024-01-05", 100, 0.0003, 5.0) == pytest.approx(17.282)


@pytest.mark.parametrize("code,low,step", [("000001", 100, 100), ("688001", 200, 1), ("830001", 100, 1)])
def test_lots(spark, code, low, step):
    assert value(spark, T.minimum_lot(F.lit(code))) == low and value(spark, T.lot_increment(F.lit(code))) == step


def test_ticks(spark):
    assert value(spark, T.tick_price(F.lit(10.001), F.lit("BUY"))) == 10.01
    assert value(spark, T.tick_price(F.lit(10.009), F.lit("SELL"))) == 10.00


@pytest.mark.parametrize("code,day,st,rate", [("920001", "2024-01-04", False, 0.30), ("300001", "2019-01-04", False, 0.10), ("300001", "2021-01-04", False, 0.20), ("600000", "2021-01-04", True, 0.05)])
def test_limits(spark, code, day, st, rate):
    assert value(spark, T.limit_rate(F.lit(code), F.lit(day).cast("date"), F.lit(st))) == rate


def test_floors(spark):
    f = lambda kind, **k: value(spark, T.trade_floor(F.lit(kind), F.lit(566446.71), 20000.0, 2000.0, **k))
    assert (f("ENTRY"), f("EXIT"), f("ADJUST")) == (2000.0, 0.0, 20000.0)
    assert value(spark, T.trade_floor(F.lit("ADJUST"), F.lit(566446.71), 0.0, 0.0, 0.02, 0.0035)) == pytest.approx(11328.9342)
    r = lambda side, now, to: value(spark, T.risk_floor(F.lit(1500.0), F.lit(20000.0), F.lit(side), F.lit(now), F.lit(to), 0.05, 0.01, 0.01))
    assert (r("SELL", 0.80, 0.55), r("BUY", 0.55, 0.80), r("SELL", 0.57, 0.55)) == (200.0, 200.0, 1500.0)
    assert T.commission_floor(5.0, 0.002) == 2500


def test_corporate_action_and_auction(spark):
    assert round(1000 * value(spark, T.share_factor(F.lit(-0.0144), F.lit(15.81), F.lit(11.13)))) == 1400
    assert value(spark, T.action_cash(F.lit(15.81), F.lit(0.0046), F.lit(-0.0144), F.lit(1000.0))) == pytest.approx(300.39)
    limit = lambda side: value(spark, T.auction_limit(F.lit(10.0), F.lit(-0.02), F.lit(0.03), F.lit(side), 2.0))
    assert (limit("BUY"), limit("SELL")) == (10.31, 9.79)
    assert value(spark, T.marketable(F.lit("BUY"), F.lit(10.31), F.lit(10.50))) is False


def test_parsers(spark):
    code = lambda s: value(spark, C.parse_code(F.lit(s)))
    assert [code(x) for x in ("1", "600000.0", " cash ", "SZ000001", "1234567", "x")] == ["000001", "600000", "CASH", "000001", "1234567", None]
    day = lambda s: str(value(spark, C.parse_date(F.lit(s))))
    assert [day(x) for x in ("44197", "2021-01-01", "2021/01/01", "20210101", "junk")] == ["2021-01-01"] * 4 + ["None"]
    number = lambda s: value(spark, C.parse_float(F.lit(s)))
    assert [number(x) for x in ("1,234.5", "x", "NaN")] == [1234.5, None, None]
    assert value(spark, C.turnover_percent(F.lit(114093292.0), F.lit(11.10), F.lit(215.388e9), F.lit(None).cast("double"))) == pytest.approx(0.588, abs=1e-3)
    agreed = lambda pref, *pairs: value(spark, C.agreed_price(F.lit(pref).cast("double"), F.array(*[F.lit(p) for p in pairs])))
    assert agreed(None, 86.82, 86.82) == 86.82 and agreed(None, 86.82, 100.0) is None and agreed(6.1, 86.82, 100.0) == 6.10
    assert value(spark, C.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None

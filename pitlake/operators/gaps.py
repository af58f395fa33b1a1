"""Opening gaps: quantiles of each code's last gaps after every day, drawn towards the market's.

A code's last gaps are kept sorted while days enter and leave, so a day costs a search and two moves, not a sort. The same
order statistic serves the batch, over partitions sorted by code and day, and the stream, whose state is the gaps in order of time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gaps:
    """lookback: valid gaps of a code; least: for full trust in them; fill: probability of the outer quantiles; shrink: gaps that weigh as much as the market; market_days: days of market quantiles; widest: valid gap."""

    lookback: int = 252
    least: int = 60
    fill: float = 0.90
    shrink: float = 40.0
    market_days: int = 60
    widest: float = 0.35

    @property
    def levels(self) -> tuple[float, float, float]:
        return 1 - self.fill, 0.5, self.fill


#: What stands for the market before any day: no gap, and 1.5 % to either side.
NO_MARKET = (-0.015, 0.0, 0.015)


class SortedRing:
    """The last ``size`` values in order of size, with interpolated quantiles."""

    def __init__(self, size: int, values: Iterable[float] = ()):
        self.size = size
        self.by_time = deque(values)
        self.sorted = sorted(self.by_time)

    def add(self, x: float) -> None:
        if len(self.by_time) == self.size:
            del self.sorted[bisect_left(self.sorted, self.by_time.popleft())]
        self.by_time.append(x)
        insort(self.sorted, x)

    def quantile(self, q: float) -> float:
        at = q * (len(self.sorted) - 1)
        low = int(at)
        a = self.sorted[low]
        return a if low + 1 == len(self.sorted) else a + (at - low) * (self.sorted[low + 1] - a)


def gap(open_: Column, prev_close: Column, widest: float) -> Column:
    """The opening gap; null where a price is missing or not positive, or the gap is wider than any valid one."""
    g = F.when((open_ > 0) & (prev_close > 0), open_ / prev_close - 1)
    return F.when(~F.isnan(g) & (F.abs(g) <= widest), g)


_OWN = ["code", "trade_date", "observations", "stock_low", "stock_mid", "stock_high"]


def stock_quantiles(days: DataFrame, spec: Gaps = Gaps()) -> DataFrame:
    """(code, trade_date, observations, stock_low, stock_mid, stock_high) after each day of each code; null quantiles before the first valid gap.

    ``days``: code, trade_date, open, prev_close, one row a code and day. One shuffle on the code.
    """
    rows = days.select("code", "trade_date", gap(F.col("open"), F.col("prev_close"), spec.widest).alias("gap"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, ring = None, SortedRing(spec.lookback)
        for batch in batches:
            out: list[tuple] = []
            for c, g in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c != code:
                    code, ring = c, SortedRing(spec.lookback)
                if g is not None:
                    ring.add(g)
                n = len(ring.sorted)
                out.append((n, *(ring.quantile(q) if n else None for q in spec.levels)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.float64()) for k in (1, 2, 3))], _OWN)

    schema = f"code {kinds['code']}, trade_date {kinds['trade_date']}, observations long, stock_low double, stock_mid double, stock_high double"
    return rows.repartition("code").sortWithinPartitions("code", "trade_date").mapInArrow(run, schema)


def market_quantiles(days: DataFrame, spec: Gaps = Gaps()) -> DataFrame:
    """(trade_date, market_low, market_mid, market_high): medians over the last days with gaps of each day's quantiles over all codes."""
    rows = days.select("trade_date", gap(F.col("open"), F.col("prev_close"), spec.widest).alias("gap"))
    daily = rows.groupBy("trade_date").agg(F.percentile("gap", F.array(*map(F.lit, spec.levels))).alias("q")).where("q is not null")
    last = Window.orderBy("trade_date").rowsBetween(1 - spec.market_days, 0)  # a row a day
    kept = daily.select("trade_date", *[F.array_sort(F.collect_list(F.col("q")[i]).over(last)).alias(f"market_{k}") for i, k in enumerate(("low", "mid", "high"))])
    middle = lambda c: (F.get(c, ((F.size(c) - 1) / 2).cast("int")) + F.get(c, (F.size(c) / 2).cast("int"))) / 2
    return kept.select("trade_date", *[middle(F.col(c)).alias(c) for c in kept.columns[1:]])


def opening_gaps(days: DataFrame, spec: Gaps = Gaps()) -> DataFrame:
    """(code, trade_date, observations, lower_gap, expected_gap, upper_gap, source) for the opening after each day of each code, in ascending order of the three.

    The trust in a code's own quantiles is n / (n + shrink), times n / least below ``least`` gaps; the rest is the market's, or ``NO_MARKET``
    before its first day.
    """
    calendar = days.select("trade_date").distinct()
    known = market_quantiles(days, spec)
    upto = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    names = ["market_low", "market_mid", "market_high"]
    market = calendar.join(known, "trade_date", "left").select("trade_date", *[F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(d)).alias(c) for c, d in zip(names, NO_MARKET, strict=True)])
    rows = stock_quantiles(days, spec).join(market, "trade_date")
    n = F.col("observations")
    trust = n / (n + spec.shrink) * F.least(F.lit(1.0), n / float(spec.least))
    mixed = [F.when(n > 0, trust * F.col(s) + (1 - trust) * F.col(m)).otherwise(F.col(m)) for s, m in zip(_OWN[3:], names, strict=True)]
    rows = rows.withColumn("_three", F.array_sort(F.array(*mixed)))
    source = F.when(n == 0, "market_fallback").when(trust < 0.999, "stock_market_shrunk").otherwise("stock_history")
    return rows.select("code", "trade_date", "observations", *[F.col("_three")[i].alias(k) for i, k in enumerate(("lower_gap", "expected_gap", "upper_gap"))], source.alias("source"))


def stream_step(spec: Gaps):
    """State function of a stream of days: a code's rows in, its quantiles after each day out; the state is its last gaps in order of time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring = SortedRing(spec.lookback, state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values("trade_date", kind="stable")
        out = []
        for day, o, c in rows[["trade_date", "open", "prev_close"]].itertuples(index=False):
            g = o / c - 1 if o is not None and c is not None and o > 0 and c > 0 else np.nan
            if abs(g) <= spec.widest:
                ring.add(float(g))
            n = len(ring.sorted)
            out.append((key[0], day, n, *(ring.quantile(q) if n else None for q in spec.levels)))
        state.update((list(ring.by_time),))
        yield pd.DataFrame(out, columns=_OWN)

    return run

"""Labels that wait: each is held in state from its arrival and comes out once, when the watermark has passed its exit.

The state of a key is a map from a label's identity to its exit and value; a timer at the exit wakes the key, so nothing is scanned that is not due.
The watermark follows the labels' entry times. Rules for what comes late or twice:

* a label that enters behind the watermark is late and dropped by the engine, as for any event-time operator;
* a label whose exit the watermark has passed already when it arrives, but whose entry it has not, comes out at once;
* a label that arrives again while it waits replaces the one that waits; one that arrives after it came out is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "code string, entry timestamp, exit timestamp, value double"


def matured(labels: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Labels whose exit is known by a date, and those that still wait."""
    known = F.col("exit_date") <= F.lit(as_of)
    return labels.where(known), labels.where(~known)


class Maturing(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "entry long, exit long", "value double")

    def _row(self, code: str, entry: int, exit_: int, value: float) -> tuple:
        return code, pd.Timestamp(entry, unit="ms"), pd.Timestamp(exit_, unit="ms"), value

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["code", "entry", "exit", "value"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:
            for entry, exit_, value in zip(batch["entry_ms"], batch["exit_ms"], batch["value"], strict=True):
                entry, exit_, value = int(entry), int(exit_), float(value)
                if exit_ <= mark:
                    out.append(self._row(key[0], entry, exit_, value))
                else:
                    self.waiting.updateValue((entry, exit_), (value,))
                    self.handle.registerTimer(exit_)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (entry, exit_), (value,) in list(self.waiting.iterator()):
            if exit_ <= due:
                out.append(self._row(key[0], entry, exit_, value))
                self.waiting.removeKey((entry, exit_))
        yield self._frame(out)

    def close(self) -> None:
        pass


def mature(labels: DataFrame, delay: str) -> DataFrame:
    """A stream of labels (code, entry, exit, value) to the same labels, each once the watermark, ``delay`` behind the latest entry, has reached its exit.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which keeps maps and timers.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    rows = labels.withColumn("entry", F.col("entry").cast("timestamp")).withWatermark("entry", delay)
    rows = rows.select("code", "entry", ms("entry").alias("entry_ms"), ms("exit").alias("exit_ms"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("code").transformWithStateInPandas(statefulProcessor=Maturing(), outputStructType=OUT, outputMode="append", timeMode="EventTime")

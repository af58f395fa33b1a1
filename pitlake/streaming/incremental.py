"""Incremental surfaces: daily files as a stream, late events, and a stateful gap estimator; labels that wait are in ``maturing``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from pitlake.operators.gaps import Gaps, stream_step
from pitlake.sources.manifest import SourceStore, current
from pitlake.sources.upsert import upsert

def daily_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New daily files of a folder; each is read once (the checkpoint remembers)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def ingest(stream: DataFrame, store: SourceStore, key: list[str], order: str, checkpoint: str):
    """Upsert all files that are there into the store and stop; a restart goes on where it ended.

    The store's sources are years. A batch writes a new version of each year it holds, from the current one and its own rows, so readers
    see a year before or after the batch, and a batch that is repeated gives the same.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        fresh = batch.withColumn("source", F.year(order).cast("string"))
        numbers = current(store.manifest()).select("source", F.col("number").alias("_n"))
        years = fresh.groupBy("source").agg(F.count("*").alias("size")).join(numbers, "source", "left")
        versions = years.select("source", "size", F.lit(epoch).cast("long").alias("mtime"), (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("number"))
        old = store.read().join(F.broadcast(versions.select("source")), "source", "left_semi")  # the years of one batch
        store.replace(upsert(old.select(fresh.columns), fresh, key, [F.desc(order)]), versions)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_events(events: DataFrame, ts: str, delay: str, key: list[str]) -> DataFrame:
    """Counts and sums per day and key; events later than the delay are dropped by the watermark."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), *key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def gap_estimator(days: DataFrame, spec: Gaps = Gaps()) -> DataFrame:
    """A stream of (code, trade_date, open, prev_close), each code's days in order of time, to its gap quantiles after each day, as ``gaps.stock_quantiles`` has them."""
    kinds = dict(days.dtypes)
    schema = f"code {kinds['code']}, trade_date {kinds['trade_date']}, observations long, stock_low double, stock_mid double, stock_high double"
    return days.groupBy("code").applyInPandasWithState(stream_step(spec), schema, "gaps array<double>", "append", GroupStateTimeout.NoTimeout)

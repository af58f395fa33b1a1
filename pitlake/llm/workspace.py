"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_name(name: str) -> str:
    """A column name that no table of a user has."""
    return f"_{name}_{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="pitlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def prepare(spark: SparkSession) -> None:
    """Arrow batches bounded in bytes, as texts may be long; shuffle files go when a step has been written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Folders of this process' calls, by application, for ``clear``.
_roots: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all written tables of this session's calls; results that were not stored elsewhere go with them."""
    for root in _roots.pop(spark.sparkContext.applicationId, []):
        _delete(spark, root)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the tables of calls made inside, once what follows from them has been written."""
    mine = _roots.setdefault(spark.sparkContext.applicationId, [])
    before = set(mine)
    yield
    for root in [x for x in mine if x not in before]:
        _delete(spark, root)
        mine.remove(root)


class Workspace:
    """Written tables of one operator call: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.live: set[str] = set()
        self.count = 0
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def save(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.saved_path = path
        self.live.add(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete saved tables that no later step reads."""
        for df in frames:
            _delete(self.spark, df.saved_path)
            self.live.discard(df.saved_path)

    def finish(self, df: DataFrame) -> DataFrame:
        """Write the result, the only table of the call that stays (until ``clear``)."""
        before = set(self.live)
        out = self.save(df)
        for path in before:
            _delete(self.spark, path)
        self.live -= before
        return out


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: sizes groups and buckets so that a task's share stays the same at any input size."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def groups_for(total: int, per_group: int) -> int:
    return max(1, -(-total // per_group))

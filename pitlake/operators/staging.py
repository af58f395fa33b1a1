"""Written intermediate tables: they cut lineage, survive lost executors and tell the optimiser their size."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; where it is unset, a temporary folder in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pitlake-staged-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, cleaned: bool = False) -> DataFrame:
    """``df`` written once and read again: for tables that several later steps read. Deleted when the program ends; ``cleaned``: shuffle files of the writing go at its end."""
    spark = df.sparkSession
    path = f"{folder(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, str(cleaned or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 (the session has ended)
            return

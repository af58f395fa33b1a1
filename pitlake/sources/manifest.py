"""A store of sources that are replaced as a whole: versions in partitions of their own, and a manifest that says which counts.

A load writes ``running`` records, then each source's rows under a new version, then ``complete`` records. Readers take the
rows of the last complete version of each source, so they see the old rows or the new ones and never a mix; what a killed load
has left has no complete record, is read by nobody, and makes the next load take the source again. Two loads at once write
different versions; the later number counts, and of equal numbers one of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "source string, size long, mtime long, number long, version string, status string, rows long, at timestamp"


def current(manifest: DataFrame) -> DataFrame:
    """(source, size, mtime, number, version, rows): the last complete version of each source."""
    order = F.struct("number", "version")
    last = manifest.where("status = 'complete'").groupBy("source").agg(F.max_by(F.struct("size", "mtime", "number", "version", "rows"), order).alias("_last"))
    return last.select("source", "_last.*")


def to_load(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source, size, mtime, number): sources whose last complete version has another size or time, or none; with the number of the version to write."""
    done = current(manifest).select("source", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    highest = manifest.groupBy("source").agg(F.max("number").alias("_number"))
    out = found.join(done, "source", "left").join(highest, "source", "left")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    return out.where(~same).select("source", "size", "mtime", (F.coalesce("_number", F.lit(0)) + 1).cast("long").alias("number"))


class SourceStore:
    """``folder``: any folder that Spark can write; ``schema``: of the rows, without source and version."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> DataFrame:
        at, fs = self._fs(f"{self.folder}/manifest")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest") if fs.exists(at) else self.spark.createDataFrame([], MANIFEST)

    def read(self) -> DataFrame:
        """Rows of the current versions, with source."""
        at, fs = self._fs(f"{self.folder}/rows")
        schema = f"{self.schema}, source string, version string"
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema).drop("version")
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/rows")
        return rows.join(current(self.manifest()).select("source", "version"), ["source", "version"]).drop("version")

    def replace(self, rows: DataFrame, versions: DataFrame) -> None:
        """``rows`` (with source) become the whole content of the sources in ``versions`` (source, size, mtime, number); sources without rows become empty."""
        tag = uuid.uuid4().hex[:12]
        named = versions.withColumn("version", F.concat(F.lpad(F.col("number").cast("string"), 9, "0"), F.lit(f"-{tag}")))
        records = [tuple(r) for r in named.select("source", "size", "mtime", "number", "version").collect()]  # of one load, a row a source
        if not records:
            return
        named = self.spark.createDataFrame(records, "source string, size long, mtime long, number long, version string")
        self._record(named.withColumns({"status": F.lit("running"), "rows": F.lit(None).cast("long")}))
        path = f"{self.folder}/rows"
        rows.join(named.select("source", "version"), "source").write.mode("append").partitionBy("source", "version").parquet(path)
        written = self.spark.read.schema(f"{self.schema}, source string, version string").parquet(path).join(named.select("source", "version"), ["source", "version"], "left_semi").groupBy("source", "version").agg(F.count("*").alias("rows"))
        self._record(named.join(written, ["source", "version"], "left").withColumns({"status": F.lit("complete"), "rows": F.coalesce("rows", F.lit(0))}))

    def _record(self, rows: DataFrame) -> None:
        ordered = rows.withColumn("at", F.current_timestamp()).selectExpr(*[c.split()[0] for c in MANIFEST.split(", ")])
        ordered.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def load(self, found: DataFrame, reader: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Replace what is new or has changed of ``found`` (source, size, mtime); ``reader`` turns (source, size, mtime, number) into rows with source. Returns the sources taken."""
        todo = self.spark.createDataFrame([tuple(r) for r in to_load(found, self.manifest()).collect()], "source string, size long, mtime long, number long")
        self.replace(reader(todo), todo)
        return sorted(r.source for r in todo.select("source").collect())

    def vacuum(self) -> int:
        """Delete the folders of versions that do not count, of killed loads among them; returns how many. Not while a load runs."""
        at, fs = self._fs(f"{self.folder}/rows")
        if not fs.exists(at):
            return 0
        kept = {(r.source, r.version) for r in current(self.manifest()).select("source", "version").collect()}
        gone = 0
        for source in fs.listStatus(at):
            if not source.isDirectory() or not source.getPath().getName().startswith("source="):
                continue
            for version in fs.listStatus(source.getPath()):
                name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
                if (name(source.getPath().getName()[7:]), name(version.getPath().getName()[8:])) not in kept:
                    fs.delete(version.getPath(), True)
                    gone += 1
        return gone

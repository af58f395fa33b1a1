"""Readers of panels and small inputs, and the daily ingestion that cleans, chains and merges prices."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from pitlake.functions import columns as C
from pitlake.operators import quality

REQUIRED = ("date", "code", "forward_return")


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Feather files (Arrow IPC) of one schema, a task for each; read through Spark's file systems, so only a schema comes to the driver."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def schema_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = from_arrow_schema(pa.ipc.open_file(pa.py_buffer(content.as_buffer())).schema)
                yield pa.record_batch([pa.array([found.json()])], ["schema"])

    first = files.limit(1).mapInArrow(schema_of, "schema string").first()
    if first is None:
        raise ValueError(f"{path} has no file")
    schema = StructType.fromJson(json.loads(first["schema"]))
    names = schema.fieldNames()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                book = pa.ipc.open_file(pa.py_buffer(content.as_buffer()))
                for i in range(book.num_record_batches):
                    part = book.get_batch(i)
                    yield pa.record_batch([part.column(part.schema.get_field_index(n)) for n in names], names)

    return files.mapInArrow(rows_of, schema)


def read_panel(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A factor panel from parquet, CSV or Feather: required columns, and all but keys as numbers (bad ones missing)."""
    df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else read_feather(spark, path) if path.endswith(".feather") else spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    keys = {"date": C.parse_date(F.col("date")), "code": F.col("code").cast("string")}
    return df.select(*[keys[c].alias(c) if c in keys else F.col(c) if c == "era" else C.finite(F.col(c).try_cast("double")).alias(c) for c in df.columns])


def optional_table(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A catalog table, or no rows where it does not exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def read_renamed(spark: SparkSession, path: str, names: dict[str, list[str]], defaults: dict[str, object] | None = None, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A CSV whose columns go by several names, with defaults and bounds."""
    df = spark.read.option("header", True).csv(path)
    out = []
    for name, others in names.items():
        found = next((c for c in [name, *others] if c in df.columns), None)
        c = F.col(found) if found else F.lit(None).cast("string")
        if bounds and name in bounds:
            c = C.clip(c.try_cast("double"), *bounds[name])
        if defaults and name in defaults:
            c = F.coalesce(c, F.lit(defaults[name]).cast("double" if bounds and name in bounds else "string"))
        out.append(c.alias(name))
    return df.select(*out)


def clean_daily(raw: DataFrame) -> DataFrame:
    """Daily rows with parsed codes, dates and numbers, and the reason against each (null if accepted)."""
    rows = raw.select(
        C.parse_code(F.col("code")).alias("code"), C.parse_date(F.col("trade_date")).alias("trade_date"),
        *[C.parse_float(F.col(c)).alias(c) for c in raw.columns if c not in ("code", "trade_date", "currency", "listed_state", "name")],
        *[C.text_or_null(F.col(c)).alias(c) for c in ("currency", "listed_state", "name") if c in raw.columns],
    )
    rules = [("missing essential", F.col("code").isNull() | F.col("trade_date").isNull() | F.col("close").isNull())]
    if "currency" in raw.columns:
        rules.append(("not CNY", F.coalesce(F.col("currency") != "CNY", F.lit(False))))
    if "listed_state" in raw.columns:
        rules.append(("not listed", F.coalesce(F.col("listed_state") != "Norm", F.lit(False))))
    return quality.rejected(rows, rules)


def chain_prices(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """New rows with an adjusted close chained from the last adjusted close before them by compounded returns.

    Codes without history start from their first close. Rows not after the anchor are overlaps, left out.
    """
    anchor = history.groupBy("code").agg(F.max_by("adj_close", "trade_date").alias("_anchor"), F.max("trade_date").alias("_last"))
    rows = fresh.join(anchor, "code", "left").where(F.col("_last").isNull() | (F.col("trade_date") > F.col("_last")))
    w = Window.partitionBy("code").orderBy("trade_date")
    first = F.row_number().over(w) == 1
    step = F.when(first & F.col("_anchor").isNull(), F.lit(0.0)).otherwise(F.log1p(F.coalesce("daily_return", F.lit(0.0))))
    base = F.coalesce("_anchor", F.first("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = rows.withColumn("adj_close", base * F.exp(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return out.drop("_anchor", "_last")


def overlap_report(history: DataFrame, fresh: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: overlapping rows, and those whose close differs."""
    both = history.select("code", "trade_date", F.col("close").alias("_close")).join(fresh, ["code", "trade_date"])
    return both.agg(F.count("*").alias("overlap"), F.count_if(F.abs(F.col("close") - F.col("_close")) > tolerance).alias("mismatched"))


def first_positive_cap(raw: DataFrame, columns: list[str], unit: float = 1.0) -> DataFrame:
    """Market capitalisation from the first column with a positive value."""
    return raw.withColumn("cap", F.coalesce(*[C.positive(F.col(c)) for c in columns]) * unit)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file whose first header begins with a byte-order mark, for spreadsheets; other headers as they are."""
    first, *others = df.columns
    marked = df.select(F.col(first).alias("\ufeff" + first), *others)
    marked.coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A small result as JSON lines; NaN and infinities become null, and null fields are written."""
    cleaned = df.select(*[C.finite(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])
    cleaned.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)

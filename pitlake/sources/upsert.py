"""Upserts by key and latest-wins dimensions, as unions with explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: of all old and new rows the first in ``order``; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(*order, F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def update_dimension(old: DataFrame, new: DataFrame, key: str, date: str, keep_if_null: list[str]) -> DataFrame:
    """A dimension takes newer rows; attributes that are null there keep their value."""
    n = new.select(key, F.col(date).alias("_date"), *[F.col(c).alias(f"_{c}") for c in new.columns if c not in (key, date)])
    out = old.join(n, key, "full")
    newer = F.col("_date").isNotNull() & (F.col(date).isNull() | (F.col("_date") >= F.col(date)))
    columns = []
    for c in old.columns:
        if c == key:
            columns.append(F.col(c))
        elif c == date:
            columns.append(F.greatest(F.col(date), F.col("_date")).alias(c))
        else:
            value = F.coalesce(F.col(f"_{c}"), F.col(c)) if c in keep_if_null else F.col(f"_{c}")
            columns.append(F.when(newer, value).otherwise(F.col(c)).alias(c))
    return out.select(*columns)


def changed_sources(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (source_file, size, mtime) without a complete entry of the same size and time."""
    done = manifest.where("status = 'complete'")
    return found.join(done, ["source_file", "size", "mtime"], "left_anti")


def union_at_cutover(before: DataFrame, after: DataFrame, date: str, cutover: str) -> DataFrame:
    """Two stores of one schema, split at a date."""
    if before.schema.simpleString() != after.schema.simpleString():
        raise ValueError("the two stores differ in schema")
    return before.where(F.col(date) < F.lit(cutover).cast("date")).unionByName(after.where(F.col(date) >= F.lit(cutover).cast("date")))

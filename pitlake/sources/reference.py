"""Reference tables from raw text columns: one declarative loader, and builds of several tables in stages."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlake.functions import columns as C

#: How a column of each kind is read from text.
KINDS: dict[str, Callable[[Column], Column]] = {
    "code": C.parse_code,
    "date": C.parse_date,
    "float": C.parse_float,
    "int": lambda c: F.floor(C.parse_float(c)).cast("long"),
    "text": lambda c: C.text_or_null(c.cast("string")),
    "flag": C.correction,
}


@dataclass(frozen=True)
class Reference:
    """``columns``: name -> (kind, headers it may go by). Of rows with one key the last in ``order`` stays."""

    name: str
    columns: dict[str, tuple[str, tuple[str, ...]]]
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)  # reason -> SQL condition that refuses a row


def parsed(raw: DataFrame, spec: Reference) -> DataFrame:
    """The columns of the table by their kinds, and ``reason``: why a row is refused, null for accepted ones."""
    at = {h.strip().lower(): h for h in raw.columns}
    out = []
    for name, (kind, headers) in spec.columns.items():
        found = next((at[h.lower()] for h in (name, *headers) if h.lower() in at), None)
        if found is None and name in (*spec.key, *spec.required):
            raise ValueError(f"{spec.name}: no header for {name}")
        c = F.col(f"`{found}`") if found else F.lit(None).cast("string")
        out.append(KINDS[kind](c).alias(name))
    df = raw.select(*out)
    reason = F.lit(None).cast("string")
    for why, broken in reversed(spec.rules.items()):
        reason = F.when(F.coalesce(F.expr(broken), F.lit(False)), F.lit(why)).otherwise(reason)
    for c in reversed((*spec.key, *spec.required)):
        reason = F.when(F.col(c).isNull(), F.lit(f"no {c}")).otherwise(reason)
    return df.withColumn("reason", reason)


def accepted(rows: DataFrame, spec: Reference) -> DataFrame:
    """One accepted row per key: the last in the order given, ties by all columns, so that reruns agree."""
    own = rows.where("reason is null").drop("reason")
    w = Window.partitionBy(*spec.key).orderBy(*[F.desc_nulls_last(c) for c in (*spec.order, *[x for x in own.columns if x not in (*spec.key, *spec.order)])])
    return own.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def load_reference(raw: DataFrame, spec: Reference, before: DataFrame | None = None) -> DataFrame:
    """The table after this load: new rows over those from before, by key."""
    fresh = accepted(parsed(raw, spec), spec)
    return fresh if before is None else fresh.unionByName(before.join(fresh.select(*spec.key), list(spec.key), "left_anti"))


def build(spark: SparkSession, raw: Callable[[str], DataFrame], specs: list[Reference], folder: str, stages: list[str] | None = None) -> DataFrame:
    """Write each table of the stages asked for under ``folder``; one row per table: rows read, accepted and refused.

    A stage that is run again overwrites its own table alone, from the same raw rows: a rerun after a failure gives the same tables.
    """
    unknown = set(stages or []) - {s.name for s in specs}
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    summary = None
    for spec in specs:
        if stages and spec.name not in stages:
            continue
        rows = parsed(raw(spec.name), spec)
        target = os.path.join(folder, spec.name)
        accepted(rows, spec).write.mode("overwrite").parquet(target)
        counts = rows.agg(F.count("*").alias("read"), F.count("reason").alias("refused")).crossJoin(spark.read.parquet(target).agg(F.count("*").alias("kept")))  # one row
        one = counts.select(F.lit(spec.name).alias("name"), "read", "refused", "kept")
        summary = one if summary is None else summary.union(one)
    return summary


def main(argv: list[str] | None = None) -> None:
    """``--raw FOLDER`` (one CSV folder a table), ``--spec FILE.json`` (a list of Reference fields), ``--out FOLDER``, ``--stage NAME`` (repeatable)."""
    import argparse
    import json

    p = argparse.ArgumentParser()
    p.add_argument("--raw", required=True)
    p.add_argument("--spec", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--stage", action="append")
    a = p.parse_args(argv)
    with open(a.spec, encoding="utf-8") as f:
        specs = [Reference(**{**s, "columns": {k: (v[0], tuple(v[1])) for k, v in s["columns"].items()}, **{k: tuple(s.get(k, ())) for k in ("key", "required", "order")}}) for s in json.load(f)]
    spark = SparkSession.builder.getOrCreate()
    build(spark, lambda name: spark.read.option("header", True).csv(os.path.join(a.raw, name)), specs, a.out, a.stage).show(truncate=False)


if __name__ == "__main__":
    main()

"""Corpus pipeline: language ID, near-dedup, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first rejects
documents without a language; the second keeps one document of each group of near duplicates (five-word
shingles, similarity 0.8); the third drops documents that contain a benchmark item; the fourth replaces
secrets in place and keeps every document; the last packs what is left into sequences of token ids.
Rows with a null doc_id and rows that repeat one take part in all stages: deduplication numbers the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm import decontaminate, language_id, near_dedup, packing, secret_scan
from pitlake.llm.workspace import Workspace, fresh_name, temporary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = fresh_name("row")
    numbered = Workspace(spark, "numbered").save(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_dedup.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), near_dedup.NearDedup(k=5))
    gone = found.where("not kept").select(F.col("doc_id").alias(row))
    return numbered.join(gone.hint("merge"), row, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("secret_scan", secrets), ("packing", packed)]

#: SQL can express neither the language model nor the tokenizer; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with temporary(spark):
            after = ws.save(stage(spark, docs, sf_dir))
        if k:
            ws.drop(docs)
        docs = after
    return docs

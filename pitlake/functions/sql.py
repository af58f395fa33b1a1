"""Exchange rules for SQL users, as temporary SQL functions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Signatures and bodies.
FUNCTIONS = {
    "a_board(code STRING) RETURNS STRING": "CASE WHEN code RLIKE '^(688|689)' THEN 'STAR' WHEN code RLIKE '^(300|301)' THEN 'CHINEXT' WHEN code RLIKE '^(8|4|920)' THEN 'BSE' ELSE 'MAIN' END",
    "a_min_lot(code STRING) RETURNS INT": "CASE WHEN code RLIKE '^(688|689)' THEN 200 ELSE 100 END",
    "a_lot_step(code STRING) RETURNS INT": "CASE WHEN code RLIKE '^(688|689|8|4|920)' THEN 1 ELSE 100 END",
    "a_legal_shares(code STRING, shares DOUBLE) RETURNS BIGINT": "CASE WHEN shares >= a_min_lot(code) THEN CAST(a_min_lot(code) + FLOOR((shares - a_min_lot(code)) / a_lot_step(code)) * a_lot_step(code) AS BIGINT) ELSE 0 END",
    "a_tick(price DOUBLE, side STRING) RETURNS DOUBLE": "ROUND(CASE WHEN side = 'BUY' THEN CEIL(price / 0.01 - 1e-10) ELSE FLOOR(price / 0.01 + 1e-10) END * 0.01, 2)",
}


def register(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")

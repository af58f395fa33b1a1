"""Domain roles of the standard tables: an entity-time panel, an entity dimension, orders, events and cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a shuffle's partition; of the files read for each partition that a shuffle begins with.
PARTITION, FILES = 8 << 20, 2 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """``rows``, with the session's shuffles dealt by the size of the input: many partitions at first, joined up to one size, so that a task's memory stays as the input grows."""
    conf = rows.sparkSession.conf
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files
    conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(int(conf.get("spark.sql.shuffle.partitions")), min(size // FILES, 20_000))))
    conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(PARTITION))
    return rows


def panel(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Daily rows of suppliers: amount, volume, close (their ratio) and return on the row before; ``by`` "code": with one shuffle, of the lines, for what goes on by supplier."""
    lines = dealt(table(spark, sf_dir, "lineitem")).select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date"), "l_extendedprice", "l_quantity")
    rows = (lines.repartition(by) if by else lines).groupBy("code", "trade_date")
    out = rows.agg(F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("volume")).withColumn("close", F.col("amount") / F.col("volume"))
    return out.withColumn("daily_return", F.col("close") / F.lag("close").over(Window.partitionBy("code").orderBy("trade_date")) - 1)


PANEL = """
base AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date, sum(l_extendedprice) AS amount, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2),
panel AS (
  SELECT *, amount / volume AS close, (amount / volume) / lag(amount / volume) OVER (PARTITION BY code ORDER BY trade_date) - 1 AS daily_return
  FROM base)"""


def market(daily: DataFrame) -> DataFrame:
    """Mean clipped return per day."""
    r = F.when(F.col("daily_return").isNotNull(), F.greatest(F.lit(-0.12), F.least(F.lit(0.12), F.col("daily_return"))))
    return daily.groupBy("trade_date").agg(F.avg(r).alias("market_return"))


MARKET = """
market AS (
  SELECT trade_date, avg(CASE WHEN daily_return IS NOT NULL THEN greatest(-0.12, least(0.12, daily_return)) END) AS market_return
  FROM panel GROUP BY 1)"""


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cross-section a year of parts sold: brand as group, price as cap, order statistics as factors."""
    li, part = dealt(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "part")
    rows = li.groupBy(F.col("l_partkey").alias("code"), F.year("l_shipdate").alias("date")).agg(
        F.sum("l_extendedprice").alias("amount"), F.avg("l_discount").alias("value_style"), F.avg("l_quantity").alias("size"), F.avg("l_tax").alias("momentum"), F.count("*").alias("n")
    )
    rows = rows.join(part.select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("industry_group"), F.col("p_retailprice").alias("cap")), "code")
    nxt = F.lead("amount").over(Window.partitionBy("code").orderBy("date"))
    return rows.withColumn("forward_return", nxt / F.col("amount") - 1)


CROSS = """
sold AS (
  SELECT l_partkey AS code, CAST(year(l_shipdate) AS INTEGER) AS date, sum(l_extendedprice) AS amount, avg(l_discount) AS value_style,
         avg(l_quantity) AS size, avg(l_tax) AS momentum, count(*) AS n
  FROM lineitem GROUP BY 1, 2),
cross_section AS (
  SELECT sold.*, p_brand AS industry_group, p_retailprice AS cap,
         lead(amount) OVER (PARTITION BY code ORDER BY date) / amount - 1 AS forward_return
  FROM sold JOIN part ON p_partkey = code)"""

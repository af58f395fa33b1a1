"""Account states: JSON documents of many accounts, kept as sources of a versioned store, and only used by the account they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions import columns as C
from pitlake.sources.manifest import SourceStore, current

SCHEMA = "account string, state string"


def checked(states: DataFrame) -> DataFrame:
    """(account, state) with status: ``new`` (no state yet), ``bad account`` (an id that cannot be used), ``no object``, ``no account id``, ``other account`` or ``ok``."""
    kind = F.schema_of_variant(F.try_parse_json("state"))
    owner = F.trim(F.get_json_object("state", "$.account_id"))
    status = (
        F.when(C.account_id(F.col("account")).isNull(), "bad account").when(F.col("state").isNull(), "new").when(kind.isNull() | ~kind.startswith("OBJECT"), "no object")
        .when(F.coalesce(owner, F.lit("")) == "", "no account id").when(owner != F.trim("account"), "other account").otherwise("ok")
    )
    return states.withColumn("status", status)


def load(store: SourceStore, accounts: list[str]) -> dict[str, str | None]:
    """The states of some accounts, None for new ones; an error for those that are not their own."""
    spark = store.spark
    asked = spark.createDataFrame([(a,) for a in accounts], "account string")
    rows = checked(asked.join(store.read().select(F.col("account").alias("_a"), "state"), F.trim("account") == F.col("_a"), "left").select("account", "state")).collect()
    wrong = sorted(f"{r.account}: {r.status}" for r in rows if r.status not in ("ok", "new"))
    if wrong:
        raise ValueError(f"account states that cannot be used: {wrong}")
    return {r.account: r.state for r in rows}


def save(store: SourceStore, states: DataFrame) -> None:
    """Replace the states of the accounts in (account, state), in one canonical form of JSON; refused as a whole if one is not its account's own."""
    rows = checked(states.select(F.trim("account").alias("account"), C.canonical_json(F.col("state")).alias("state")))
    wrong = rows.where("status <> 'ok'").select("account", "status").limit(20).collect()
    if wrong:
        raise ValueError(f"account states that cannot be saved: {sorted(map(tuple, wrong))}")
    numbers = current(store.manifest()).select("source", F.col("number").alias("_n"))
    versions = rows.select(F.col("account").alias("source"), F.octet_length("state").cast("long").alias("size"), F.xxhash64("state").alias("mtime")).join(numbers, "source", "left")
    store.replace(rows.select("account", "state", F.col("account").alias("source")), versions.select("source", "size", "mtime", (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("number")))

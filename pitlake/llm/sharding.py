"""Sharding (operator 12): sampled splitters, range partitioning by content, law ``bytes``.

Records are ordered by (hash of the text, doc_id, row), so equal texts are neighbours and shards are mixed alike.
A sample of keys, drawn with weights of size and count, gives splitters at its quantiles; records are dealt to the
ranges between them. Ranges that came out overfull are subdivided by a sample of their own; a key that overfills a
range by itself is cut by doc_id and row. A range is then one bounded group: running sums within it and the sums of the
ranges before it give each record's exact place among all bytes, and from that its shard and its slot. Splitters decide
how the work is dealt, never the result.

Law ``bytes``: a record lies in the shard in which the middle of its bytes falls, with shards of equal length. Equal texts
whose bytes together are at most ``1 / whole`` of a shard's stay together (the middle of the group's bytes decides); larger
groups are cut at shard boundaries like other records.

Defined results: null text has no bytes and counts as the empty text in hash, size and crc; null doc_ids come first among
equal texts; repeated rows are records of their own; no records, no rows; other columns, of any name, are ignored by
``shard`` and kept by ``write_shards``.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, fresh_name, groups_for


@dataclass(frozen=True)
class Sharding:
    """shards: their number; ranges: for each shard at least, more where a range would have over ``range_rows``; per_range: sampled keys a range; whole: equal texts of up to this part of a shard stay together."""

    shards: int = 8
    ranges: int = 64
    range_rows: int = 1_000_000
    per_range: int = 16
    whole: int = 20


Bound = tuple[int, int | None, int]


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5 hash."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def records(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, key, row: what the placement of a document depends on; texts go no further. ``row``: a number of its own for each."""
    row = F.monotonically_increasing_id() if row is None else row
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(docs["text"]).alias("key"), row.alias("row"))


def _longs(values: list[int | None]) -> Column:
    """An array literal of any length in one leaf of the plan."""
    return F.transform(F.split(F.lit(",".join("" if x is None else str(x) for x in values)), ","), lambda x: F.when(x != "", x.cast("bigint")))


def range_of(bounds: list[Bound]) -> Column:
    """How many of the sorted ``bounds`` are not above (key, doc_id, row): a binary search."""
    if not bounds:
        return F.lit(0)
    sizes = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    me = F.struct(F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("row").alias("r"))

    def find(at: Column) -> Column:
        return F.aggregate(sizes, F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(at, lo + s - 1) <= me), lo + s).otherwise(lo))

    text = "[" + ",".join(f'{{"k":{k},"d":{"null" if d is None else d},"r":{r}}}' for k, d, r in bounds) + "]"
    return find(F.from_json(F.lit(text), "array<struct<k:bigint,d:bigint,r:bigint>>"))


def _order(b: Bound) -> tuple:
    return b[0], b[1] is not None, b[1] or 0, b[2]


def _sample(rows: DataFrame, weight: Column, n: int, total: float) -> list[Bound]:
    """About ``n`` keys in order, each record drawn by itself with a chance that grows with its weight; ``total``: of all weights.

    A record comes with the chance 1 - exp(-n * weight / total), so the expected number, ``n`` at most, bounds what comes to the driver from any number of tasks.
    """
    u = (F.pmod(F.xxhash64("row"), F.lit(1 << 52)) + 1) / float(1 << 52)
    drawn = rows.where(-F.ln(u) < weight * (n / total)).select("key", "doc_id", "row").collect()
    return sorted((tuple(r) for r in drawn), key=_order)


def _quantiles(drawn: list[Bound], pieces: int) -> set[Bound]:
    """Splitters at the quantiles of a sample: before all records of a key, and inside the key if several quantiles fall in it."""
    found = [drawn[len(drawn) * i // pieces] for i in range(1, pieces)] if drawn else []
    out: set[Bound] = set()
    for key, n in Counter(b[0] for b in found).items():
        out.add((key, None, -1))
        if n > 1:
            out |= {(key + 1, None, -1), *(b for b in found if b[0] == key)}
    return out


def splitters(rows: DataFrame, conf: Sharding, total: int, count: int) -> tuple[list[Bound], list[tuple]]:
    """Sorted bounds, and for each range (its number, bytes, records, first key, last key)."""
    ranges = max(conf.shards * conf.ranges, groups_for(count, conf.range_rows))
    weight = F.col("size") / float(total) + F.lit(1.0 / count)
    fair = 2.0 / ranges  # all weights sum to 2
    bounds = sorted(_quantiles(_sample(rows, weight, conf.per_range * ranges, 2.0), ranges), key=_order)
    while True:
        found = rows.groupBy(range_of(bounds).alias("range")).agg(F.sum("size"), F.count("*"), F.min("key"), F.max("key")).collect()
        table = sorted(tuple(r) for r in found)
        over = {r: math.ceil((size / total + n / count) / fair) for r, size, n, _, _ in table if n > 1 and size / total + n / count > 2 * fair}
        if not over:
            return bounds, table
        inside = rows.withColumn("range", range_of(bounds)).where(F.col("range").isin(list(over)))
        drawn = _sample(inside, weight, 2 * conf.per_range * sum(over.values()), sum(size / total + n / count for r, size, n, _, _ in table if r in over))
        more = set(bounds)
        edges = [_order(b) for b in bounds]
        for r, pieces in over.items():
            mine = [b for b in drawn if (r == 0 or _order(b) >= edges[r - 1]) and (r == len(edges) or _order(b) < edges[r])]
            if mine:
                more |= _quantiles(mine, pieces)
        if len(more) == len(bounds):  # records that no bound tells apart
            return bounds, table
        bounds = sorted(more, key=_order)


def _placed(rows: DataFrame, conf: Sharding, total: int, bounds: list[Bound], table: list[tuple]) -> DataFrame:
    """``rows`` with shard and index, the record's number in the order of all."""
    n = len(bounds) + 1
    size_at, rows_at = [0] * n, [0] * n
    for r, size, count, _, _ in table:
        size_at[r], rows_at[r] = size, count
    first_byte, first_row = ([0, *accumulate(x)][:-1] for x in (size_at, rows_at))
    # Keys cut over several ranges: where they begin, and their bytes.
    begin: list[int | None] = [None] * n
    whole: list[int | None] = [None] * n
    at: dict[int, list[int]] = {}
    for r, _, _, low, high in table:
        for key in {low, high}:
            at.setdefault(key, []).append(r)
    for cut in at.values():
        if len(cut) > 1:
            for r in cut:
                begin[r], whole[r] = first_byte[cut[0]], sum(size_at[x] for x in cut)
    here = Window.partitionBy("range").orderBy("key", "doc_id", "row")
    same = Window.partitionBy("range", "key")
    literal = lambda values: F.get(_longs(values), F.col("range"))
    out = rows.withColumn("range", range_of(bounds)).withColumn("end", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(here))
    out = out.withColumn("start", literal(first_byte) + F.col("end") - F.col("size"))
    out = out.withColumn("group_start", F.coalesce(literal(begin), F.min("start").over(same))).withColumn("group", F.coalesce(literal(whole), F.sum("size").over(same)))
    together = F.col("group") * conf.shards * conf.whole <= total
    twice_middle = F.when(together, 2 * F.col("group_start") + F.col("group")).otherwise(2 * F.col("start") + F.col("size"))
    shard = F.call_function("div", twice_middle * conf.shards, F.lit(2 * total).cast("long"))
    return out.select("doc_id", "size", "text_crc32", "row", shard.cast("int").alias("shard"), (literal(first_row) + F.col("nth") - 1).alias("index"))


def _assigned(rows: DataFrame, conf: Sharding, ws: Workspace) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot of saved ``records``."""
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.select("doc_id", "size", "text_crc32", "row", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed = ws.save(_placed(rows, conf, total, *splitters(rows, conf, total, count)))
    first = dict(map(tuple, placed.groupBy("shard").agg(F.min("index")).collect()))
    slot = F.col("index") - F.get(_longs([first.get(s, 0) for s in range(conf.shards)]), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", "row", "shard", slot.alias("slot"))


def shard(docs: DataFrame, conf: Sharding = Sharding()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law): one row per document."""
    ws = Workspace(docs.sparkSession, "sharding")
    out = _assigned(ws.save(records(docs)), conf, ws)
    return ws.finish(out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, conf: Sharding = Sharding()) -> DataFrame:
    """Write ``docs`` to ``path``, a folder ``shard=`` for each shard, files and rows by slot; returns (shard, records, bytes). A column shard or slot of ``docs`` is replaced."""
    ws = Workspace(docs.sparkSession, "sharding")
    row = fresh_name("row")
    numbered = ws.save(docs.drop("shard", "slot").withColumn(row, F.monotonically_increasing_id()))
    placed = ws.save(_assigned(ws.save(records(numbered, F.col(row))), conf, ws).select(F.col("row").alias(row), "size", "shard", "slot"))
    dealt = numbered.join(placed.select(row, "shard", "slot"), row).drop(row).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)
    return ws.finish(placed.groupBy("shard").agg(F.count("*").alias("records"), F.sum("size").alias("bytes")))

"""Benchmark decontamination (operator 3): short test items inside long documents.

Items are partitioned by the size of their set of 5-word shingles. Each partition is an index of its
own: its items are entered under the m smallest values of one hash over their shingles, their MinHash
sketches, with m one more than the shingles that an item of the partition may lack at the least
containment, so a document that contains an item to that degree holds one of them for certain. A
document is far longer than an item, so minima of its own would say nothing of it: it probes, with all
its shingles, the partitions whose items it has shingles enough to contain. Each candidate is confirmed
by the exact share of the item's shingles that the document holds.

Items of one text are one entry. The different texts are dealt by hash into blocks of about ``block_bytes``;
the index of one block at a time is broadcast, and documents are neither shuffled nor grouped. A benchmark of any
size takes this path, with a pass over the documents for each block, so what is broadcast or held by a task does not grow.

Words are runs of letters and digits of any script with their marks, lower-cased; in scripts written
without spaces (Chinese, Japanese, Thai and others) each character is a word. An item of fewer than five
words is one shingle of its own length; an item without words matches nothing. Null text is empty text; a
null doc_id or item_id stays null in the rows it makes; repeated documents and items each make their
rows; other columns, of any name, are ignored by ``contaminated`` and kept by ``clean``. A very long text
costs one array of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .workspace import Workspace, fresh_name, groups_for, prepare


FOUND = "doc_id long, key long, n_item long, n_shared long, containment double"


@dataclass(frozen=True)
class Containment:
    """k: words in a shingle; least: share of an item's shingles; block_bytes: item text in a block, on average."""

    k: int = 5
    least: float = 0.8
    block_bytes: int = 16 << 20


@dataclass
class Partition:
    """Items of about one size and one shingle length: sorted sketch values, the item of each, and the fewest shingles a container has."""

    k: int
    fewest: int
    keys: np.ndarray
    item: np.ndarray


@dataclass
class Index:
    ids: list[int]
    sets: list[np.ndarray]
    partitions: list[Partition]
    seen: np.ndarray  # which low bits any sketch value has


def lacking(size: int, least: float) -> int:
    """Shingles that a set of this size may lack: those of the largest size in its partition bound a sketch."""
    return int(np.floor((1 - least) * size + 1e-9))


def partition_top(size: int) -> int:
    """The largest set size in the partition of ``size``: partitions grow by a quarter."""
    top = 4
    while top < size:
        top = top + max(1, top // 4)
    return top


def item_of(text: str, spec: Containment) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Words in a shingle, the set and its sketch; None without words."""
    _, _, buf, offs = next(wh.slices(pa.array([text]), 1 << 40))
    start, end, first = wh.words(buf, offs, wh.ALNUM)
    k = min(spec.k, len(start))
    if not k:
        return None
    s = np.unique(wh.shingles(wh.word_hashes(buf, start, end), first, k, False)[0])
    m = min(len(s), lacking(partition_top(len(s)), spec.least) + 1)
    return k, s, s[np.argsort(wh.mix(s ^ np.uint64(0x51ED)))[:m]]


def build_index(rows: list[tuple[int, str]], spec: Containment) -> Index:
    ids, sets, groups = [], [], {}
    for key, text in rows:
        found = item_of(text, spec)
        if found:
            k, s, sketch = found
            groups.setdefault((k, partition_top(len(s))), []).append((len(ids), len(s), sketch))
            ids.append(key)
            sets.append(s)
    partitions, seen = [], np.zeros(1 << 22, bool)
    for (k, _), items in sorted(groups.items()):
        keys = np.concatenate([x for _, _, x in items])
        owner = np.repeat([i for i, _, _ in items], [len(x) for _, _, x in items])
        order = np.argsort(keys, kind="stable")
        fewest = int(np.ceil(spec.least * min(n for _, n, _ in items) - 1e-9))
        partitions.append(Partition(k, fewest, keys[order], owner[order]))
        seen[(keys & np.uint64(len(seen) - 1)).astype(np.int64)] = True
    return Index(ids, sets, partitions, seen)


def _hits(text: pa.Array, ix: Index, spec: Containment) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of confirmed matches."""
    for lo, _, buf, offs in wh.slices(text):
        start, end, first = wh.words(buf, offs, wh.ALNUM)
        h = wh.word_hashes(buf, start, end)
        for k in sorted({p.k for p in ix.partitions}):
            sh, begin = wh.shingles(h, first, k, False)
            at = np.flatnonzero(ix.seen[(sh & np.uint64(len(ix.seen) - 1)).astype(np.int64)])
            owner = np.searchsorted(begin, at, "right") - 1
            room = np.diff(begin)
            pairs = []
            for part in ix.partitions:
                if part.k == k:
                    may = room[owner] >= part.fewest
                    value = sh[at[may]]
                    left, right = np.searchsorted(part.keys, value), np.searchsorted(part.keys, value, "right")
                    n = right - left
                    item = part.item[np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    pairs.append(np.repeat(owner[may], n) * len(ix.ids) + item)
            last, own = -1, None
            for pair in np.unique(np.concatenate(pairs)):
                d, i = divmod(int(pair), len(ix.ids))
                if d != last:
                    last, own = d, sh[begin[d] : begin[d + 1]]
                shared = int(np.isin(ix.sets[i], own).sum())
                if shared >= spec.least * len(ix.sets[i]) - 1e-9:
                    yield lo + d, i, shared


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, key, text: rows of one text have one key."""
    text = wh.lettered(F.coalesce(F.col("text"), F.lit("")), digits=True)
    return benchmark.select(F.col("item_id").cast("long"), text.alias("text")).withColumn("key", F.xxhash64("text"))


def _blocks(items: DataFrame, spec: Containment) -> Iterator[Broadcast]:
    """Indices of the different item texts, dealt by hash into blocks of about ``block_bytes``."""
    spark = items.sparkSession
    prepare(spark)
    different = items.groupBy("key").agg(F.first("text").alias("text"))
    count = groups_for(different.agg(F.sum(F.octet_length("text"))).first()[0] or 0, spec.block_bytes)
    for block in range(count):
        rows = different.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(count)) == block).orderBy("key").collect()
        yield spark.sparkContext.broadcast(build_index([tuple(r) for r in rows], spec))


def _found(texts: DataFrame, shared: Broadcast, spec: Containment) -> DataFrame:
    """FOUND of (doc_id, text) and one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            hits = list(_hits(batch.column(1), ix, spec)) if ix.ids else []
            if hits:
                row, item, n = map(list, zip(*hits))
                size = [len(ix.sets[i]) for i in item]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array([ix.ids[i] for i in item], pa.int64()), pa.array(size), pa.array(n), pa.array([a / b for a, b in zip(n, size)])],
                    ["doc_id", "key", "n_item", "n_shared", "containment"],
                )

    return texts.mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, spec: Containment = Containment()) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: one row per document and item that it contains.

    A pass over the documents for each block of items; what one finds is written before the next is made.
    """
    texts = docs.select(F.col("doc_id").cast("long"), wh.lettered(F.col("text"), digits=True).alias("text"))
    items = _items(benchmark)
    ws = Workspace(docs.sparkSession, "decontaminate")
    found = None
    for shared in _blocks(items, spec):
        own = ws.save(_found(texts, shared, spec))
        found = own if found is None else found.union(own)
    # Few rows meet the ids of their items: which side is small is left to the measured sizes.
    return ws.finish(found.join(items.drop("text"), "key").select("doc_id", "item_id", "n_item", "n_shared", "containment"))


def _cleaned(docs: DataFrame, shared: Broadcast, spec: Containment) -> DataFrame:
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            dirty = {row for row, _, _ in _hits(batch.column(len(names)), ix, spec)} if ix.ids else ()
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array([i not in dirty for i in range(len(batch))], pa.bool_()))

    return docs.select("*", wh.lettered(docs["text"], digits=True).alias(fresh_name("lower"))).mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, spec: Containment = Containment()) -> DataFrame:
    """The documents that contain no item, with all their columns: each block of items passes on what is free of it, written before the next."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    out, last = docs, None
    for shared in _blocks(_items(benchmark), spec):
        if last is not None:
            out = ws.save(_cleaned(out, last, spec))
        last = shared
    return _cleaned(out, last, spec)

"""MinHash near-duplicate detection (operator 6).

Signatures of many universal hash minima are cut into bands; documents that agree on a band are
candidates, a short sketch of further minima drops most false ones, and a link counts only when the
full shingle sets confirm it. Components come from alternating large-star and small-star.

Documents with equal shingle sets are one class, so a group of copies of any size is one row from the
profile on. Inside a bucket no pairs of all members are made: members are compared with one centre and
what that links is merged. A pair that is still apart then has a member outside the largest component of
its bucket; such members are compared with that component and with each other in blocks of bounded size,
inside the tasks, where only links leave a block. Pairs within one component need no check, so no
component is lost.

Chance that a pair at similarity 0.8 is missed: (1 - 0.8**6)**48 < 5e-7 that it shares none of the 48
bands of 6 rows, and under 2e-8 that fewer than ``least_bits`` of its sketch agree.

Families of texts at a similarity of about 0.5 to 0.8 share buckets but link nowhere. Their members are
then all compared with each other, in blocks of bounded size, most pairs by their sketches alone: the
time for such a family, not a task's memory, grows with the square of its different texts.

Classes have numbers of their own, given when their table is written, so rows that share a doc_id and
differ in text are told apart. Very long texts cost one array of hashes per text.

Defined results: null or empty text, or text without words, has n_shingles 0 and is its own component;
a null doc_id stays as a row with null component_id and kept = true; repeated rows each get a row;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .components import connected_components
from .workspace import Workspace

#: Most classes, and most shingles on average, of either side of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 18


@dataclass(frozen=True)
class NearDedup:
    """k: words in a shingle; percent: least similarity; bands x rows minima make a signature."""

    k: int = 4
    percent: int = 80
    bands: int = 48
    rows: int = 6
    short: bool = True
    seed: int = 7

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def least_bits(self) -> int:
        """Sketch bits (one of each minimum) that agree; a pair at the least similarity has fewer only 5.5 deviations off its mean."""
        p = (1 + self.percent / 100) / 2
        return int(self.minima * p - 5.5 * (self.minima * p * (1 - p)) ** 0.5)


def _profile(spec: NearDedup):
    rng = np.random.default_rng(spec.seed)
    n = spec.bands * spec.rows
    a = (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
    b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    wide = -(-n // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for lo, hi, buf, offs in wh.slices(text):
                start, end, first = wh.words(buf, offs)
                sh, begin = wh.shingles(wh.word_hashes(buf, start, end), first, spec.k, spec.short)
                m = hi - lo
                count, fp = np.zeros(m, np.int64), np.zeros((2, m), np.uint64)
                keys = np.zeros((m, spec.bands), np.uint64)
                sketch = np.zeros((m, wide), np.uint64)
                have = np.flatnonzero(np.diff(begin))
                if len(have):
                    doc = np.repeat(np.arange(m), np.diff(begin))
                    order = np.lexsort((sh, doc))
                    sh, doc = sh[order], doc[order]
                    new = np.ones(len(sh), bool)
                    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
                    sh, doc = sh[new], doc[new]
                    count = np.bincount(doc, minlength=m)
                    at = np.concatenate([[0], np.cumsum(count)])[:-1][have]
                    fp[0, have] = np.add.reduceat(wh.mix(sh), at)
                    fp[1, have] = np.bitwise_xor.reduceat(wh.mix(sh ^ np.uint64(0xA5A5)), at)
                    x = (sh >> np.uint64(32)).astype(np.uint32)
                    for band in range(spec.bands):
                        key = np.full(len(have), band, np.uint64)
                        for i in range(band * spec.rows, (band + 1) * spec.rows):
                            least = np.minimum.reduceat(x * a[i] + b[i], at).astype(np.uint64)
                            key = wh.mix(key * np.uint64(31) + least)
                            sketch[have, i // 64] |= (wh.mix(least) & np.uint64(1)) << np.uint64(i % 64)
                        keys[have, band] = key
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[lo:hi], pa.array(count), *(pa.array(f.view(np.int64)) for f in fp),
                        pa.ListArray.from_arrays(np.arange(0, m * wide + 1, wide, dtype=np.int32), pa.array(sketch.ravel().view(np.int64))),
                        pa.ListArray.from_arrays(np.arange(0, m * spec.bands + 1, spec.bands, dtype=np.int32), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["doc_id", "n_shingles", "fp1", "fp2", "sketch", "bands"],
                )

    return run


def _sets(spec: NearDedup):
    """The fingerprints and the sorted set of shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in wh.slices(batch.column(0)):
                start, end, first = wh.words(buf, offs)
                sh, begin = wh.shingles(wh.word_hashes(buf, start, end), first, spec.k, spec.short)
                sets = [np.unique(sh[i:j]) for i, j in zip(begin, begin[1:])]
                fp = [np.array([f(wh.mix(x ^ np.uint64(seed))) for x in sets], np.uint64) for f, seed in ((np.add.reduce, 0), (np.bitwise_xor.reduce, 0xA5A5))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x) for x in sets], pa.int64()), *(pa.array(x.view(np.int64)) for x in fp), pa.array([x.tobytes() for x in sets], pa.binary())], ["n_shingles", "fp1", "fp2", "shingles"]
                )

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(spec: NearDedup):
    """Links between the two sides of a block, whose rows are (side, cid, component, sketch, shingles)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        side, cid = rows.column("side").to_numpy(), rows.column("cid").to_numpy()
        part = rows.column("component").to_numpy()
        sketch = np.array(rows.column("sketch").to_pylist(), np.int64)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
        size = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        u, v = [], []
        if len(left) and len(right):
            agree = spec.minima - sum(np.bitwise_count((sketch[left, k][:, None] ^ sketch[right, k][None]).view(np.uint64)).astype(np.int64) for k in range(sketch.shape[1]))
            small, large = np.minimum(size[left][:, None], size[right][None]), np.maximum(size[left][:, None], size[right][None])
            maybe = (agree >= spec.least_bits) & (100 * small >= spec.percent * large) & (part[left][:, None] != part[right][None])
            for i in np.flatnonzero(maybe.any(1)):
                js = right[maybe[i]]
                own = sets[left[i]]
                # One search for all of a row's candidates: which of their shingles are its own.
                flat = np.concatenate([sets[j] for j in js])
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.add.reduceat(own[at] == flat, np.concatenate([[0], np.cumsum(size[js])[:-1]]), dtype=np.int64)
                linked = 100 * both >= spec.percent * (len(own) + size[js] - both)
                u += [cid[left[i]]] * int(linked.sum())
                v += cid[js[linked]].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, spec: NearDedup = NearDedup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    ws = Workspace(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    profile = ws.save(docs.mapInArrow(_profile(spec), "doc_id long, n_shingles long, fp1 long, fp2 long, sketch array<long>, bands array<long>"))
    same = ["n_shingles", "fp1", "fp2"]
    usable = profile.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch"))
    classes = ws.save(classes.withColumn("cid", F.monotonically_increasing_id()))

    # Buckets of two classes at least, each with its least class as centre.
    entries = classes.select("cid", F.explode("bands").alias("key"))
    centres = entries.groupBy("key").agg(F.min("cid").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = ws.save(entries.join(centres, "key"))
    wanted = classes.drop("bands").join(buckets.select("cid").distinct(), "cid", "left_semi")
    # The merge hints keep the same plan at every size.
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(spec), "n_shingles long, fp1 long, fp2 long, shingles binary")
    sets = ws.save(sets.join(wanted.drop("rep").hint("merge"), same).dropDuplicates(same).drop("fp1", "fp2"))

    bits = spec.minima - F.aggregate(F.zip_with("a.sketch", "b.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    alike = (bits >= spec.least_bits) & (100 * F.least("a.n_shingles", "b.n_shingles") >= spec.percent * F.greatest("a.n_shingles", "b.n_shingles"))
    pairs = buckets.where("cid <> centre").select(F.col("centre").alias("u"), F.col("cid").alias("v")).distinct()
    # Sketches first: only the pairs that they let pass fetch sets.
    sketches = sets.select("cid", "n_shingles", "sketch")
    maybe = ws.save(pairs.join(sketches.alias("a").hint("merge"), F.col("u") == F.col("a.cid")).join(sketches.alias("b").hint("merge"), (F.col("v") == F.col("b.cid")) & alike).select("u", "v"))
    own = sets.select("cid", "shingles")
    both = maybe.join(own.alias("a").hint("merge"), F.col("u") == F.col("a.cid")).join(own.alias("b").hint("merge"), F.col("v") == F.col("b.cid"))
    links = ws.save(both.select("u", "v", "a.shingles", "b.shingles").toDF("u", "v", "a", "b").mapInArrow(_confirm(spec.percent), "u long, v long"))
    parts = connected_components(links, ws)

    # Where a bucket still has several components, its members outside the largest go with that one.
    placed = buckets.select("key", "cid").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    outside = ws.save(placed.join(main, "key").where("component <> main").select(F.col("main").alias("g"), "cid", "component").distinct())
    ws.drop(buckets)
    inside = parts.select(F.col("component").alias("g"), F.col("node").alias("cid"), "component").union(parts.select(F.col("component").alias("g"), F.col("component").alias("cid"), "component"))
    groups = outside.select("g").distinct()
    inside = inside.union(groups.select("g", F.col("g").alias("cid"), F.col("g").alias("component"))).distinct().join(groups, "g", "left_semi")
    sided = outside.withColumn("side", F.lit(0)).union(inside.union(outside).withColumn("side", F.lit(1)))
    sided = ws.save(sided.join(classes.select("cid", "n_shingles"), "cid"))
    # Written, so that the join below has plain shuffles on both sides and a hot group is split.
    chunks = ws.save(sided.groupBy("g").agg(
        *(F.greatest(F.ceil(F.count(F.when(F.col("side") == s, 1)) / BLOCK_ROWS), F.ceil(F.sum(F.when(F.col("side") == s, F.col("n_shingles"))) / BLOCK_SHINGLES), F.lit(1)).alias(f"n{s}") for s in (0, 1))
    ))
    own, other = F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0"))
    spread = sided.drop("n_shingles").join(chunks, "g").withColumn("c", F.pmod(F.xxhash64("cid"), own)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    spread = spread.select("g", "side", "cid", "component", F.when(F.col("side") == 0, F.col("c")).otherwise(F.col("o")).alias("i"), F.when(F.col("side") == 0, F.col("o")).otherwise(F.col("c")).alias("j"))
    blocks = spread.join(sets.select("cid", "sketch", "shingles").hint("merge"), "cid")
    more = ws.save(blocks.groupBy("g", "i", "j").applyInArrow(_blocks(spec), "u long, v long"))
    ws.drop(outside, sided, chunks, sets)
    parts = connected_components(links.union(more), ws)

    # A component's id is its least doc_id; class numbers follow no such order.
    nodes = parts.union(parts.select(F.col("component").alias("node"), "component")).distinct()
    named = ws.save(classes.select(F.col("cid").alias("node"), "rep").join(nodes, "node"))
    least = ws.save(named.groupBy("component").agg(F.min("rep").alias("least")))
    of_class = classes.select(*same, F.col("cid").alias("node"), "rep").join(named.join(least, "component").select("node", "least"), "node", "left").select(*same, F.coalesce("least", "rep").alias("component"))
    out = profile.select("doc_id", *same).join(of_class, same, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return ws.finish(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))

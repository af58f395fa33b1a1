"""Approximate nearest neighbours by multi-index hashing (operator 4).

Vectors become binary codes: centred, turned to principal axes and rotated so that signs lose least
(iterative quantisation); a code has the signs of ``rotations`` such rotations, learned on a bounded
sample. Codes are cut into substrings; each block of rows holds one index per substring. A query probes
the values near its own, nearest first: by the pigeonhole principle a code within radius s*m + a agrees
with it but for s bits in one of the first a + 1 of m substrings, or but for s - 1 bits in another, so all codes
of the radius are retrieved. They are ranked by exact distance on the original vectors, and the radius
grows, from one that few of the sample's k-th neighbours are within, until k rows are confirmed: until it is as large as the Hamming distance that ``share`` of the
sample's pairs at the k-th distance found so far have at most. So queries with near neighbours probe
little; where all rows are about equally far, as in directions drawn at random, most values are probed and
only the codes within the radius, a few in a hundred rows, are ranked.

Every row is indexed, in blocks of ``block`` rows by a hash of vec_id; the query set meets each block in
chunks, and only each block's k nearest leave it.

Defined results: vectors that are null, zero, not of the commonest dimension, or hold null or non-finite
components take no part; neither do rows without vec_id; rows with a query's own vec_id are not its
candidates; of queries with one vec_id the least vector asks; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import groups_for


@dataclass(frozen=True)
class Spec:
    """share: of pairs whose Hamming distance the last radius covers; substring: bits of one; sample: rows that codes are learned on."""

    k: int = 10
    share: float = 0.85
    rotations: int = 4
    substring: int = 16
    sample: int = 20000
    rounds: int = 30
    block: int = 1 << 15
    chunk: int = 4096


@dataclass
class Codes:
    """Signs of turned vectors, the Hamming distance that ``share`` of pairs at each of some distances have at most, and the first radius."""

    mean: np.ndarray
    turn: np.ndarray
    distance: np.ndarray
    reach: np.ndarray
    start: int = 0

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.turn > 0

    def radius(self, distance: float) -> float:
        return float(np.interp(distance, self.distance, self.reach))


def learn_codes(x: np.ndarray, spec: Spec) -> Codes:
    mean = x.mean(0)
    z = x - mean
    _, axes = np.linalg.eigh(z.T @ z)
    z = z @ axes
    rng = np.random.default_rng(3)
    turns = []
    for _ in range(spec.rotations):
        turn, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
        for _ in range(spec.rounds):
            b = np.where(z @ turn > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(b.T @ z)
            turn = (u @ vt).T
        turns.append(axes @ turn)
    codes = Codes(mean, np.concatenate(turns, 1), np.zeros(1), np.zeros(1))
    # Pairs of some sample rows with all others: the nearest of each, and ever more of the farther ones.
    bits = codes.of(x)
    ask = rng.permutation(len(x))[:200]
    pairs, kth = [], []
    for i in ask:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = np.argsort(d)[1:]
        kth += (bits[order[spec.k - 1 : spec.k]] != bits[i]).sum(1).tolist()
        order = order[np.unique(np.append(np.arange(min(50, len(order))), np.geomspace(1, max(len(order), 1), 60).astype(int) - 1)[: len(order) + 60].clip(0, max(len(order) - 1, 0)))] if len(order) else order
        pairs.append(np.stack([d[order], (bits[order] != bits[i]).sum(1)]))
    codes.start = int(np.quantile(kth, 0.05)) if kth else 0
    d, h = np.concatenate(pairs, 1)
    order = np.argsort(d)
    parts = np.array_split(order, max(1, len(order) // 400))
    if len(order):
        codes.distance = np.append(0.0, [d[p].max() for p in parts])
        codes.reach = np.maximum.accumulate(np.append(0.0, [np.quantile(h[p], spec.share) for p in parts]))
    return codes


class MultiIndex:
    """The codes of a block, indexed by each of their substrings."""

    def __init__(self, bits: np.ndarray, substring: int):
        self.cuts = [slice(a, min(a + substring, bits.shape[1])) for a in range(0, bits.shape[1], substring)]
        self.packed = np.packbits(bits, axis=1)
        self.values = [self._value(bits[:, c]) for c in self.cuts]
        self.order = [np.argsort(v, kind="stable") for v in self.values]
        self.begin = [np.searchsorted(v[o], np.arange((1 << (c.stop - c.start)) + 1)) for v, o, c in zip(self.values, self.order, self.cuts)]
        self.masks = {}
        for n in {c.stop - c.start for c in self.cuts}:
            apart = np.bitwise_count(np.arange(1 << n))
            self.masks[n] = [np.flatnonzero(apart == s) for s in range(n + 1)]

    @staticmethod
    def _value(bits: np.ndarray) -> np.ndarray:
        return bits @ (1 << np.arange(bits.shape[1])[::-1])

    def growing(self, code: np.ndarray, start: int, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Radius, the rows that come into it and their Hamming distances, for growing radii up to all bits."""
        m, bits = len(self.cuts), len(code)
        own, packed = [int(self._value(code[None, c])[0]) for c in self.cuts], np.packbits(code)[None]
        found, self.probed = np.zeros(len(self.packed), bool), 0
        waiting, apart = np.zeros(0, np.int64), np.zeros(0, np.int64)
        radius, done = min(start, bits), 0  # ``done`` probes: distance s in substring i is probe s * m + i
        while True:
            fresh = []
            for probe in range(done, min(radius, bits) + 1):
                s, i = divmod(probe, m)
                masks = self.masks[self.cuts[i].stop - self.cuts[i].start]
                if s < len(masks):
                    value = own[i] ^ masks[s]
                    first = self.begin[i][value]
                    n = self.begin[i][value + 1] - first
                    value, first, n = value[n > 0], first[n > 0], n[n > 0]
                    rows = self.order[i][np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    rows = rows[~found[rows]]
                    found[rows] = True
                    fresh.append(rows)
            done = radius + 1
            self.probed += sum(map(len, fresh))
            rows = np.concatenate([np.zeros(0, np.int64), *fresh])
            waiting = np.append(waiting, rows)
            apart = np.append(apart, np.bitwise_count(self.packed[rows] ^ packed).sum(1, dtype=np.int64))
            inside = apart <= radius
            yield radius, waiting[inside], apart[inside]
            waiting, apart = waiting[~inside], apart[~inside]
            if radius >= bits:
                return
            radius = min(radius + step, bits)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within the radius."""
        _, rows, _ = next(self.growing(code, radius, 1))
        return np.sort(rows)


def search(index: MultiIndex, codes: Codes, x: np.ndarray, ids: np.ndarray, q: np.ndarray, code: np.ndarray, own: int, spec: Spec) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of the k nearest found, their distances, and how many rows were ranked."""
    m = len(index.cuts)
    best, dist, ranked = np.zeros(0, np.int64), np.zeros(0), 0
    for radius, rows, _ in index.growing(code, max(m - 1, codes.start), max(1, m // 4)):
        rows = rows[ids[rows] != own]
        ranked += len(rows)
        d = np.sqrt(((x[rows] - q) ** 2).sum(1))
        best, dist = np.append(best, rows), np.append(dist, d)
        top = np.lexsort((ids[best], dist))[: spec.k]
        best, dist = best[top], dist[top]
        if len(best) == spec.k and radius >= codes.radius(dist[-1]):
            break
    return best, dist, ranked


def _search(codes: Broadcast, spec: Spec):
    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(rows) and len(asked):
            matrix = lambda t: np.asarray(t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(t), -1)
            x, q = matrix(rows), matrix(asked)
            ids, query = rows.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
            index, bits = MultiIndex(codes.value.of(x), spec.substring), codes.value.of(q)
            for i in range(len(q)):
                best, d, _ = search(index, codes.value, x, ids, q[i], bits[i], query[i], spec)
                out += zip([int(query[i])] * len(best), ids[best].tolist(), d.tolist())
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, spec: Spec = Spec()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which the column ``is_query`` holds."""
    x = F.col("embedding").cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    usable = vectors.select(F.col("vec_id").cast("long"), x.alias("x"), is_query.alias("asks"))
    usable = usable.where("vec_id is not null and x is not null and size(x) > 0").where(~F.exists("x", bad) & F.exists("x", lambda v: v != 0))
    sizes = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.where(F.size("x") == sizes["d"])
    share = min(1.0, spec.sample / sizes["n"])
    sample = usable.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("x").limit(2 * spec.sample).toPandas()["x"]
    codes = vectors.sparkSession.sparkContext.broadcast(learn_codes(np.stack(sample.to_list()), spec))  # dimension x code numbers
    n = groups_for(sizes["n"], spec.block)
    asked = usable.where("asks").groupBy("vec_id").agg(F.min("x").alias("x"))
    chunks = groups_for(asked.count(), spec.chunk)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    rows = usable.select("vec_id", "x", part(n).alias("b"), every(chunks).alias("c"))
    asked = asked.select("vec_id", "x", every(n).alias("b"), part(chunks).alias("c"))
    found = rows.groupBy("b", "c").cogroup(asked.groupBy("b", "c")).applyInArrow(_search(codes, spec), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")

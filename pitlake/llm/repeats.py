"""Removal of repeated 200-byte strings over a whole corpus (operator 10).

Suffixes only matter by their first 200 bytes, and only by whether another suffix begins alike. They
are treated in the blockwise manner of a difference-cover construction:

1. The cover sample: positions whose place in the document, modulo 133, is in a perfect difference
   cover of 12. Any two positions have a sample position at one common distance under 133, so two equal
   200-byte strings hold an equal 68-byte string at a sample position of both. The sample's ranks (names
   of its 68 bytes) are computed once; a suffix near no repeated name is settled: nothing begins alike.
2. The other suffixes fall into buckets by content (the least 32-byte string within their first 200
   bytes). Consecutive suffixes of a bucket form a stretch. Stretches of a bucket that tie all along are
   settled by the stretch's name; a bucket with one stretch holds no repeat.
3. Of stretches that differ within a bucket, and one of each set of equal ones, every suffix's 200 bytes
   are named and counted, one bucket of names at a time.

Names are 64-bit (with the number of the bucket as further bits in step 3); ranks serve for equality,
so names need no alphabetic order. Documents are dealt into groups of about ``group_bytes``; groups ask
for the names they hold, each once, and get one bit for each, so a string that is everywhere costs one
question per group. Nothing is collected but counts of bytes.

Defined results: null text is empty text; documents under 200 bytes keep everything; a null doc_id stays
null; repeated rows are documents of their own and remove each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .workspace import Workspace, groups_for, text_bytes

# A perfect difference cover modulo 133.
PERIOD = 133
COVER = np.array([0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109])
ANCHOR = 32
#: A place in a slice; Arrow holds no text of 4 GB. The rest of a key are the anchor's upper bits.
_POS_BITS = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)


@dataclass(frozen=True)
class Spec:
    length: int = 200
    group_bytes: int = 24 << 20

    @property
    def named(self) -> int:
        """Bytes of a sample's name: what is left of a string behind the farthest common sample."""
        return self.length - PERIOD + 1


def _text_slices(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return wh.slices(table.column("text"), 1 << 20)


def _sums(buf: np.ndarray, seed: int) -> np.ndarray:
    """Running sums of a polynomial over byte values: any stretch's hash is a difference of two."""
    values = wh.mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 1))
    power, _ = wh._power_tables(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * power[: len(buf)], out=out[1:])
    return out


def _names(sums: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    _, inverse = wh._power_tables(len(sums))
    return wh.mix((sums[start + size] - sums[start]) * inverse[start])


def cover_sample(offs: np.ndarray, spec: Spec) -> np.ndarray:
    """Positions of the sample in documents that are long enough."""
    size = np.diff(offs)
    room = np.where(size >= spec.length, size - spec.named + 1, 0)
    n = -(-room // PERIOD)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = (k * PERIOD)[:, None] + COVER[None]
    keep = place < room[doc][:, None]
    return (place + offs[doc][:, None])[keep]


def _sample_names(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names of the ``size`` bytes from each position, eight bytes at a time."""
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    word = np.ndarray((len(buf) + 1,), np.uint64, pad.data, 0, (1,))
    h = np.full(len(at), size, np.uint64)
    for j in [*range(0, size - 8, 8), size - 8]:
        h ^= word[at + j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return wh.mix(h)


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


class Names:
    """The distinct names a group holds, by bucket; asks for them and spreads the answers."""

    def __init__(self, name: np.ndarray, other: np.ndarray, buckets: int, width: int):
        self.width, self.n = width, len(name)
        bucket = (other % np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in range(buckets):
            at = order[cut[b] : cut[b + 1]]
            if len(at):
                key, back, count = np.unique(name[at], return_inverse=True, return_counts=True)
                self.of[b] = (key, at, back, count)

    def asked(self, mp: int) -> pa.Table:
        rows = [(mp, b, np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, : self.width]).tobytes(), np.packbits(count > 1).tobytes()) for b, (key, _, _, count) in self.of.items()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["mp", "bucket", "names", "several"])

    def answered(self, rows: list[tuple[int, bytes]]) -> np.ndarray:
        out = np.zeros(self.n, bool)
        for b, packed in rows:
            key, at, back, _ = self.of[b]
            out[at] = _bits(packed, len(key))[back]
        return out


ASKED = "mp long, bucket long, names binary, several binary"
ANSWER = "mp long, kind int, bucket long, bits binary"


def _count(width: int, kind: int):
    """One bucket of names: which of them two groups hold, or one group twice."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        parts = []
        for x in rows.column("names"):
            raw = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :width] = raw
            parts.append(wide.view(np.uint64).ravel())
        several = [_bits(s.as_py(), len(p)) for s, p in zip(rows.column("several"), parts)]
        name = np.concatenate(parts)
        order = np.argsort(name, kind="stable")
        s = name[order]
        more = np.zeros(len(s), bool)
        same = s[1:] == s[:-1]
        more[1:] |= same
        more[:-1] |= same
        repeated = np.concatenate(several)
        repeated[order] |= more
        bits = [np.packbits(x).tobytes() for x in np.split(repeated, np.cumsum([len(p) for p in parts])[:-1])]
        n = len(bits)
        return pa.table([rows.column("mp").combine_chunks(), pa.array([kind] * n, pa.int32()), rows.column("bucket").combine_chunks(), pa.array(bits, pa.binary())], names=["mp", "kind", "bucket", "bits"])

    return run


class Group:
    """One group's documents, and what is known of their suffixes after each step."""

    def __init__(self, docs: pa.Table, answers: pa.Table, spec: Spec, buckets: int):
        self.spec, self.docs, self.buckets = spec, docs, buckets
        self.answers: dict[int, list[tuple[int, bytes]]] = {}
        for kind, bucket, bits in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "bits"))):
            self.answers.setdefault(kind, []).append((bucket, bits))

    def sample(self) -> Names:
        found = []
        for _, _, buf, offs in _text_slices(self.docs):
            found.append(_sample_names(buf, cover_sample(offs, self.spec), self.spec.named))
        h = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return Names(h >> np.uint64(24), h & np.uint64((1 << 24) - 1), self.buckets, 5)

    def open_suffixes(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices with the starts of suffixes that a repeated sample name follows within the cover's period."""
        repeated = self.sample().answered(self.answers.get(1, []))
        done = 0
        for lo, hi, buf, offs in _text_slices(self.docs):
            at = cover_sample(offs, self.spec)
            flag = repeated[done : done + len(at)]
            done += len(at)
            s = at[flag]
            doc = np.searchsorted(offs, s, "right") - 1
            a, b = np.maximum(s - (PERIOD - 1), offs[doc]), np.minimum(s, offs[doc + 1] - self.spec.length)
            ok = b >= a
            edge = np.bincount(a[ok], minlength=len(buf) + 1) - np.bincount(b[ok] + 1, minlength=len(buf) + 1)[: len(buf) + 1]
            yield lo, hi, buf, offs, np.flatnonzero(np.cumsum(edge[: len(buf)]) > 0)

    def stretches(self) -> Iterator[tuple]:
        """Each slice with its open suffixes, the first of each stretch among them, and bucket and name of the stretches."""
        width = self.spec.length - ANCHOR + 1
        for lo, hi, buf, offs, start in self.open_suffixes():
            if not len(start):
                yield lo, hi, buf, offs, start, start, np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
                continue
            one = _sums(buf, 1)
            n = len(buf) - ANCHOR + 1
            anchor = _names(one, np.arange(n), ANCHOR)
            # Least anchor of each run of ``width``: prefix and suffix minima of blocks of that size.
            key = ((anchor >> _POS_BITS) << _POS_BITS) | np.arange(n, dtype=np.uint64)
            full = -(-n // width) * width
            grid = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
            grid[:n] = key
            grid = grid.reshape(-1, width)
            head = np.minimum.accumulate(grid, axis=1).ravel()
            tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            place = (np.minimum(tail[start], head[start + width - 1]) & _LOW).astype(np.int64)
            new = np.ones(len(start), bool)
            new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            size = start[last] - start[first] + self.spec.length
            name = wh.mix(_names(one, start[first], size) ^ wh.mix(size.astype(np.uint64)) ^ wh.mix((place[first] - start[first]).astype(np.uint64) + np.uint64(1 << 40)))
            yield lo, hi, buf, offs, start, first, anchor[place[first]], name, one

    def settled(self) -> Iterator[tuple]:
        """Each slice with its open suffixes: whether its stretch settles it as repeated, and whether its 200 bytes must be named."""
        codes = self.answers.get(2, [(0, b"")])[0][1]
        table = np.frombuffer(codes, np.uint64).reshape(-1, 2)
        taken: set[int] = set()
        for lo, hi, buf, offs, start, first, _, name, one in self.stretches():
            n = np.diff(np.append(first, len(start)))
            code = np.zeros(len(name), np.uint64)
            if len(table) and len(name):
                at = np.minimum(np.searchsorted(table[:, 0], name), len(table) - 1)
                code = np.where(table[at, 0] == name, table[at, 1], np.uint64(0))
            known, name_it = (code & np.uint64(1)) > 0, (code & np.uint64(2)) > 0
            for k in np.flatnonzero(name_it & known):  # of equal stretches one in the owning group
                name_it[k] = int(name[k]) not in taken
                taken.add(int(name[k]))
            yield lo, hi, buf, offs, start, np.repeat(known, n), np.repeat(name_it, n), one

    def suffix_names(self) -> Names:
        a, b = [], []
        for _, _, buf, _, start, _, name_it, one in self.settled():
            at = start[name_it]
            if len(at):
                a.append(_names(one, at, self.spec.length))
                b.append(_names(_sums(buf, 2), at, self.spec.length))
        z = np.zeros(0, np.uint64)
        return Names(np.concatenate([z, *a]), np.concatenate([z, *b]), self.buckets, 8)

    def result(self) -> pa.Table:
        repeated = self.suffix_names().answered(self.answers.get(3, []))
        done, out = 0, []
        ids = self.docs.column("doc_id").to_pylist()
        for lo, hi, buf, offs, start, known, name_it, _ in self.settled():
            flag = known.copy()
            n = int(name_it.sum())
            flag[name_it] |= repeated[done : done + n]
            done += n
            s = start[flag]
            edge = np.zeros(len(buf) + 1, np.int64)
            edge[s] += 1
            edge[s + self.spec.length] -= 1
            gone = np.cumsum(edge[: len(buf)]) > 0
            for d in range(lo, hi):
                a, z = offs[d - lo], offs[d - lo + 1]
                g = gone[a:z]
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                out.append((ids[d], int(z - a), int(g.sum()), spans, hashlib.sha256(buf[a:z][~g].tobytes() if spans else buf[a:z].tobytes()).hexdigest()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])



def _asked_stretches(g: Group, mp: int) -> pa.Table:
    anchors, names = [], []
    for _, _, _, _, _, _, anchor, name, _ in g.stretches():
        anchors.append(anchor)
        names.append(name)
    z = np.zeros(0, np.uint64)
    name, one, n = np.unique(np.concatenate([z, *names]), return_index=True, return_counts=True)
    anchor = np.concatenate([z, *anchors])[one]
    return pa.table({"mp": pa.array([mp] * len(name), pa.int64()), "anchor": anchor.view(np.int64), "name": name.view(np.int64), "n": n.astype(np.int64)})


def _packed_codes(key: tuple, rows: pa.Table) -> pa.Table:
    name, code = rows.column("name").to_numpy().view(np.uint64), rows.column("code").to_numpy().astype(np.uint64)
    order = np.argsort(name)
    return pa.table({"mp": [key[0].as_py()], "kind": pa.array([2], pa.int32()), "bucket": pa.array([0], pa.int64()), "bits": pa.array([np.stack([name[order], code[order]], 1).tobytes()], pa.binary())})


def remove_repeats(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document."""
    spark = docs.sparkSession
    ws = Workspace(spark, "repeats")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = groups_for(text_bytes(docs), spec.group_bytes)
    # Rows with one text (and so copies, however many) are spread as well.
    docs = docs.withColumn("mp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).repartition(n, "mp")

    def stage(answers: DataFrame | None, f: Callable[[Group, int], pa.Table], schema: str) -> DataFrame:
        if answers is None:

            def alone(key: tuple, rows: pa.Table) -> pa.Table:
                return f(Group(rows, _none, spec, n), key[0].as_py())

            return docs.groupBy("mp").applyInArrow(alone, schema)

        def run(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
            if not len(rows):
                return f(Group(rows, _none, spec, n), key[0].as_py()).slice(0, 0)
            return f(Group(rows, known, spec, n), key[0].as_py())

        return docs.groupBy("mp").cogroup(answers.repartition(n, "mp").groupBy("mp")).applyInArrow(run, schema)

    first = stage(None, lambda g, mp: g.sample().asked(mp), ASKED)
    ranks = ws.save(first.repartition(n, "bucket").groupBy("bucket").applyInArrow(_count(5, 1), ANSWER))

    found = ws.save(stage(ranks, _asked_stretches, "mp long, anchor long, name long, n long"))
    # Both are written: the join then has plain shuffles on both sides, and that of an anchor with many contexts is split.
    same = ws.save(found.groupBy("anchor", "name").agg(F.sum("n").alias("n"), F.min("mp").alias("owner")))
    buckets = ws.save(same.groupBy("anchor").agg(F.count("*").alias("kinds")))
    judged = same.join(buckets, "anchor").where("n > 1 or kinds > 1")
    judged = found.select("mp", "name", "anchor").join(judged, ["anchor", "name"])
    code = F.when(F.col("n") > 1, 1).otherwise(0) + F.when((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("mp") == F.col("owner"))), 2).otherwise(0)
    codes = judged.select("mp", "name", code.alias("code")).groupBy("mp").applyInArrow(_packed_codes, ANSWER)
    known = ws.save(ranks.union(codes))
    ws.drop(found, same, buckets)

    last = stage(known, lambda g, mp: g.suffix_names().asked(mp), ASKED)
    known = ws.save(known.union(last.repartition(n, "bucket").groupBy("bucket").applyInArrow(_count(8, 3), ANSWER)))
    return ws.finish(stage(known, lambda g, mp: g.result(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


_none = pa.table({"mp": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})

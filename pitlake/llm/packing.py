"""Best-fit packing by minimum bin slack (operator 7).

Documents become token ids (the public vocabulary's, then id 0); longer ones than a sequence are cut
into full pieces and, first, a shorter remainder. Pieces of one length are interchangeable, so what has
to be decided is how many pieces of each length share a sequence: a histogram of at most ``capacity``
numbers, whatever the size of the corpus. For each sequence a subset-sum programme over bitsets finds
the fullest combination of available lengths, seeded with the longest; the combination is taken as
often as the counts allow. Pieces then find their place by their rank among pieces of their length:
ranks are local ranks plus offsets per (written part, length), so no task ever sees a whole length.

Defined results: null or empty text is the one id 0; a null doc_id stays null; repeated rows are packed
each; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

CAPACITY = 2048
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(2)
def _encoders(json_path: str, ranks_path: str, pattern: str):
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Tokenizer.from_file(json_path), tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> tuple[str, str, str]:
    """Paths of the vocabulary for both libraries, and its pattern of words."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def encode(texts: list[str], paths: tuple[str, str, str]) -> Iterator[np.ndarray]:
    """The ids that ``tokenizers`` gives, without special tokens added.

    ``tiktoken`` reads the same vocabulary several times faster and gives the same ids for ASCII and
    Latin letters; a text with other characters or a special token's string goes to ``tokenizers``.
    """
    slow, fast = _encoders(*paths)
    for text in texts:
        if "<|" in text or (not text.isascii() and max(text) > "ɏ") or "\x85" in text or "\xa0" in text or not text.replace("\n", " ").isprintable():
            yield np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            yield np.array(fast.encode_ordinary(text), np.uint32)


def _pieces(capacity: int, paths: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0] * (capacity + 1)  # pieces of each length so far in this part
        at = TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([x or "" for x in part.column(1).to_pylist()], paths)):
                    ids = np.append(ids, np.uint32(0)).astype("<u4")
                    first = len(ids) % capacity if len(ids) > capacity else len(ids)
                    cuts = sorted({0, *range(first, len(ids) + 1, capacity)})
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), at, seen[b - a]))
                        seen[b - a] += 1
                types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return run


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, copies) of a fullest combination that holds the longest available piece.

    Subset sums are bits of an integer; lengths are added from the longest on, copies in powers of two,
    until a sum fills the sequence; then the choices are read back.
    """
    longest = max(counts)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    left = dict(counts)
    left[longest] -= 1
    reach, steps = 1, []
    for length in sorted((n for n, c in left.items() if c and n <= room), reverse=True):
        copies, size = min(left[length], room // length), 1
        while copies:
            size = min(size, copies)
            steps.append((reach, length, size))
            reach |= (reach << (length * size)) & mask
            copies -= size
            size *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used = {longest: 1}
    for before, length, size in reversed(steps):
        if not before >> at & 1:
            at -= length * size
            used[length] = used.get(length, 0) + size
    return sorted(used.items(), reverse=True)


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, combination) for all pieces: each combination is the fullest of what was left."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        combination = fullest(left, capacity)
        times = min(left[n] // c for n, c in combination)
        for n, c in combination:
            left[n] -= c * times
            if not left[n]:
                del left[n]
        out.append((times, combination))
    return out


def _slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first rank, last rank + 1, first sequence, copies, offset: where pieces of these ranks go."""
    sequence, rank, out = 0, {}, []
    for times, combination in plan:
        offset = 0
        for n, c in combination:
            r = rank.get(n, 0)
            out.append((n, r, r + c * times, sequence, c, offset))
            rank[n] = r + c * times
            offset += n * c
        sequence += times
    return out


def _placed(slots: list[tuple[int, int, int, int, int, int]]):
    by: dict[int, np.ndarray] = {}
    for s in slots:
        by.setdefault(s[0], []).append(s[1:])
    by = {n: np.array(v, np.int64) for n, v in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    n = length[part[0]]
                    t = by[int(n)]
                    s = t[np.searchsorted(t[:, 0], rank[part], "right") - 1]
                    x = rank[part] - s[:, 0]
                    seq[part] = s[:, 2] + x // s[:, 3]
                    off[part] = s[:, 4] + x % s[:, 3] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    ws = Workspace(docs.sparkSession, "packing")
    pieces = ws.save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(capacity, vocabulary()), f"{PIECE}, part long, local long"))
    local = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # Pieces of a length in earlier parts.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = ws.save(local.withColumn("base", before))
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = _slots(minimum_bin_slack(counts, capacity))
    ranked = pieces.join(bases.drop("n"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(_placed(slots), f"{PIECE}, sequence_id long, offset long")

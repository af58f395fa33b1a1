r"""Ranked lexical search (operator 13): WAND per document shard, shard heaps merged.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. One scan of
the documents writes the index: a row for each block of documents, with postings (document, count) by
term. A bitmap of fixed size says which terms any query has, so other terms leave no postings; a term that the
bitmap lets through by chance is found by no query. Term weights follow from sums over blocks.

Queries go to the tasks in chunks of bounded size. A task is a document shard: it takes its blocks in turn and
keeps a heap of the best k documents for each query. In a block, cursors on the query's postings are kept in the order
of their documents; the pivot is the first document at which the maximum impacts of the cursors so far could reach
the heap's least score, and cursors before it skip to it. The heaps of all shards are merged in two steps.

Defined results: null text has no terms, takes no rank and counts in neither N nor L; an item without terms has
no rows; items that repeat an item_id are ranked each for itself; repeated rows of documents are documents of their own;
equal scores go by ascending doc_id, null ids last; other columns, of any name, are ignored. Terms are compared by
64-bit hashes.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .wordhash import ALNUM, slices, word_hashes, words
from .workspace import Workspace, fresh_name, groups_for


@dataclass(frozen=True)
class LexicalSearch:
    """k: documents an item; bitmap_bits: log2 of the bitmap's bits, 1 MiB by default; chunk_terms: terms of the queries that go to the tasks at once, on average."""

    k: int = 10
    bitmap_bits: int = 23
    chunk_terms: int = 200_000


_BLOCK_BYTES = 1 << 23
_INDEX = "doc_id array<bigint>, n array<int>, term array<bigint>, size array<int>, doc array<int>, tf array<int>"
_NULL_LAST = 1 << 64


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, term hashes, where each row's begin) of blocks of rows."""
    for a, b, buf, offsets in slices(column, _BLOCK_BYTES):
        start, end, first = words(buf, offsets, ALNUM)
        yield a, b, word_hashes(buf, start, end), first


def query_terms(items: DataFrame, ids: str) -> DataFrame:
    """(ids, term, c): each term of each item with its count; ``items`` has ``ids`` and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, first in _terms(batch.column(1)):
                row = np.repeat(np.arange(a, b), np.diff(first))
                yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], ["id", "term"])

    found = items.select(F.col(ids).cast("long"), "text").mapInArrow(run, "id long, term long")
    return found.groupBy(F.col("id").alias(ids), "term").agg(F.count("*").alias("c"))


def _bitmap(terms: DataFrame, bits: int) -> np.ndarray:
    """Which values of the hash's first ``bits`` bits occur; at most 2**bits / 64 rows come to the driver."""
    at = F.shiftrightunsigned("term", 64 - bits)
    rows = terms.groupBy(F.shiftrightunsigned(at, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - bits}) & 63 as int))")).alias("v")).toPandas()
    out = np.zeros(max(1, (1 << bits) >> 6), np.int64)
    out[rows["i"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return out.view(np.uint8)


def build_index(docs: DataFrame, bitmap: np.ndarray, bits: int) -> DataFrame:
    """A row for each block of documents that have terms: ids, numbers of terms, and postings by term of those in the bitmap."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, first in _terms(batch.column(1)):
                n = np.diff(first)
                ids = batch.column(0).slice(a, b - a)
                at = h >> shift
                hit = np.flatnonzero((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                term, inverse = np.unique(h[hit], return_inverse=True)
                doc = np.searchsorted(first, hit, "right") - 1
                posting, tf = np.unique(inverse * (b - a) + doc, return_counts=True)
                size = np.bincount(posting // (b - a), minlength=len(term))
                lists = [ids, pa.array(n, pa.int32()), pa.array(term.view(np.int64)), pa.array(size, pa.int32()), pa.array(posting % (b - a), pa.int32()), pa.array(tf, pa.int32())]
                if n.any():
                    yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], ["doc_id", "n", "term", "size", "doc", "tf"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _INDEX)


def weighted(terms: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """``terms`` with the weight w; those in no document are left out."""
    counted = index.select(F.inline(F.arrays_zip("term", "size"))).groupBy("term").agg(F.sum("size").alias("df"))
    w = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    return terms.join(counted, "term").withColumn("w", w.cast("long"))


def _wand(cursors: list[list], heap: list, k: int, keys: list[int]) -> None:
    """Push the best documents of a block to ``heap``; cursors: [document, place, maximum impact, documents, impacts]."""
    by_doc = itemgetter(0)
    cursors.sort(key=by_doc)
    while cursors:
        least = heap[0][0] if len(heap) == k else 1
        bound = 0
        for pivot, cursor in enumerate(cursors):
            bound += cursor[2]
            if bound >= least:
                break
        else:
            return
        doc = cursors[pivot][0]
        moved = 0
        if cursors[0][0] == doc:
            score = 0
            for cursor in cursors:
                if cursor[0] != doc:
                    break
                at = cursor[1]
                score += cursor[4][at]
                cursor[1] = at + 1
                moved += 1
            entry = (score, -keys[doc])
            if len(heap) < k:
                if score > 0:
                    heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        else:
            for cursor in cursors:
                if cursor[0] >= doc:
                    break
                cursor[1] = bisect_left(cursor[3], doc, cursor[1] + 1)
                moved += 1
        ended = False
        for cursor in cursors[:moved]:
            if cursor[1] < len(cursor[3]):
                cursor[0] = cursor[3][cursor[1]]
            else:
                cursor[2], ended = -1, True
        if ended:
            cursors = [c for c in cursors if c[2] >= 0]
        cursors.sort(key=by_doc)


def _search(index: DataFrame, queries: list[tuple[int, list[int], list[int], list[int]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score, shard): the best k documents of each document shard for the queries (item, terms, weights, counts)."""
    vocabulary = np.unique(np.concatenate([np.array(q[1], np.int64) for q in queries]))
    weight = np.zeros(len(vocabulary), np.int64)
    asked = []
    for item, term, w, c in queries:
        place = np.searchsorted(vocabulary, np.array(term, np.int64))
        weight[place] = w
        asked.append((item, list(zip(place.tolist(), c, strict=True))))

    def block(row: pa.RecordBatch, i: int, heaps: list[list]) -> None:
        # Impacts of the block's postings, and per term their list; documents in the order of their ids.
        ids, n, term, size, doc, tf = (np.asarray(row.column(j)[i].values) if j else row.column(0)[i].values for j in range(6))
        keys = [_NULL_LAST if x is None else x for x in ids.to_pylist()]
        m = 25 + (75 * n.astype(np.int64) * n_docs) // n_terms
        place = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
        known = vocabulary[place] == term
        tf = tf.astype(np.int64)
        impact = np.repeat(weight[place] * known, size) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        begin = np.concatenate([[0], np.cumsum(size)])
        lists = {int(place[j]): (doc[begin[j] : begin[j + 1]].tolist(), impact[begin[j] : begin[j + 1]]) for j in np.flatnonzero(known)}
        most = {p: int(x.max()) for p, (_, x) in lists.items()}
        plain = {p: (d, x.tolist()) for p, (d, x) in lists.items()}
        for (_, terms), heap in zip(asked, heaps, strict=True):
            there = [(p, c) for p, c in terms if p in most]
            # A block whose maxima cannot reach the least score of the heap is skipped whole.
            if len(heap) == k and sum(most[p] * c for p, c in there) < heap[0][0]:
                continue
            cursors = []
            for p, c in there:
                d, x = plain[p]
                cursors.append([d[0], 0, most[p] * c, d, x if c == 1 else [y * c for y in x]])
            _wand(cursors, heap, k, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                block(batch, i, heaps)
        rows = [(item, None if key == -_NULL_LAST else -key, score) for (item, _), heap in zip(asked, heaps, strict=True) for score, key in heap]
        yield pa.record_batch([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long").withColumn("shard", F.spark_partition_id())


def _best(hits: DataFrame, k: int, *within: str) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("item", *within).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, conf: LexicalSearch = LexicalSearch()) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` its ``k`` best rows of ``docs``, whole texts, scores above 0."""
    ws = Workspace(docs.sparkSession, "lexical")
    row = fresh_name("row")
    numbered = ws.save(items.select("item_id", "text").withColumn(row, F.monotonically_increasing_id()))
    asked = ws.save(query_terms(numbered, row).withColumnRenamed(row, "item"))
    index = ws.save(build_index(docs, _bitmap(asked, conf.bitmap_bits), conf.bitmap_bits))
    sums = index.select(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"), F.size(F.filter("n", lambda x: x > 0)).alias("d")).agg(F.sum("l"), F.sum("d")).first()
    n_terms, n_docs = sums[0] or 0, sums[1] or 0
    rated = ws.save(weighted(asked, index, n_docs).groupBy("item").agg(F.collect_list("term").alias("term"), F.collect_list("w").alias("w"), F.collect_list("c").alias("c")))
    chunks = groups_for(rated.agg(F.sum(F.size("term"))).first()[0] or 0, conf.chunk_terms)
    hits = None
    for chunk in range(chunks):
        queries = [tuple(r) for r in rated.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == chunk).select("item", "term", "w", "c").collect()]
        if queries:
            found = ws.save(_search(index, queries, n_docs, n_terms, conf.k))
            hits = found if hits is None else hits.union(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # Heaps of shards meet in groups first, so that the last step gets few rows for an item at any number of shards.
    near = _best(hits.withColumn("part", F.pmod("shard", F.lit(64))), conf.k, "part").drop("rank")
    best = _best(near, conf.k).select("item", "rank", "doc_id", "score")
    named = numbered.select(F.col(row).alias("item"), F.col("item_id").cast("long"))
    return ws.finish(best.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))

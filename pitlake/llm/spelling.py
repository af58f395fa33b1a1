r"""Spelling variant grouping (operator 11): a positional q-gram index with a count filter.

Words are maximal runs of letters, with one code point deleted in every ``typo``-th (document, run) by a checksum. Their
trigrams, padded at both ends, are numbered by position. One edit destroys at most three of them and leaves the
others in place, or moves them up by one if it inserts, so two near words share all but three of the longer word's. The first
in the order of (frequency, trigram, position) that they share is then one of the first four of either (three of a shorter word): words meet where
(trigram, position, length) of such a one sends them. There, postings by trigram and position are merged with a heap, the
shortest lists first, under the length and position limits; what reaches the overlap bound is verified. A meeting place with
many words is cut into blocks that meet in pairs.

Forms point to words of at least twice the count, so chains are no longer than the logarithm of the largest count;
roots follow by pointer jumping.

Defined results: null text has no words; a null doc_id counts as the empty string in the checksum; repeated rows count
again; words of any length take part; no words, no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, prepare

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Q = 3
#: Trigrams that one edit may destroy, and one more: of a word's rarest so many, near words share one.
PREFIX = Q + 1
_BEFORE, _AFTER = "\x01" * (Q - 1), "\x02" * (Q - 1)


@dataclass(frozen=True)
class Spelling:
    """least_length: code points; least_count: occurrences; typo: one (document, run) in so many loses a code point, 0 for none; growth: a form occurs so many times as often at least; block: words that meet at once are two blocks at most."""

    least_length: int = 5
    least_count: int = 3
    typo: int = 97
    growth: int = 2
    block: int = 256


def words(docs: DataFrame, conf: Spelling = Spelling()) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    text = F.col("text")
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    # Shorter runs give no word, with or without a deletion.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(lowered, F.lit(f"[A-Za-zÀ-ÿ]{{{conf.least_length},}}"), F.lit(0))).alias("word"))
    if conf.typo:
        h = F.crc32(F.concat("d", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(h % conf.typo == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= conf.least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= conf.least_count)


def grams(word: Column) -> Column:
    padded = F.concat(F.lit(_BEFORE), word, F.lit(_AFTER))
    return F.transform(F.sequence(F.lit(1), F.length(word) + Q - 1), lambda i: F.substring(padded, i, F.lit(Q)))


def _cells(vocabulary: DataFrame, conf: Spelling, ws: Workspace) -> DataFrame:
    """(gram, pos, size, lo, hi, block, shorter, word, n): words of ``size`` code points, and shorter ones, where their rarest trigrams send them."""
    # A row for each trigram over an alphabet of 90 letters and two pads: under 800,000 rows at any size of the vocabulary.
    frequency = vocabulary.select(F.explode(grams(F.col("word"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("f"))
    rated = vocabulary.select("word", "n", F.posexplode(grams(F.col("word"))).alias("pos", "gram")).join(F.broadcast(frequency), "gram")
    rarest = rated.groupBy("word", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct("f", "gram", "pos"))), 1, PREFIX).alias("rarest"))
    size = F.length("word")

    def places(i: int) -> list[Column]:
        x = F.get("rarest", F.lit(i))
        at = lambda pos, size, shorter: F.struct(x["gram"].alias("gram"), pos.alias("pos"), size.alias("size"), F.lit(shorter).alias("shorter"))
        # The shorter of two words shares all but two of its trigrams, so that its first three suffice.
        return [at(x["pos"], size, False), *([at(x["pos"], size + 1, True), at(x["pos"] + 1, size + 1, True)] if i < PREFIX - 1 else [])]

    met = rarest.select("word", "n", F.inline(F.array(*[x for i in range(PREFIX) for x in places(i)])))
    met = ws.save(met)
    cell = ["gram", "pos", "size"]
    large = met.groupBy(cell).agg(F.ceil(F.count("*") / conf.block).cast("int").alias("blocks")).where(F.col("blocks") > 1)
    dealt = met.join(large, cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*cell, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "shorter", "word", "n")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes b of a; b is as long as a or longer by one."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a != b and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _place(p: int) -> str:
    """A place as one code point, or two beyond 65535: no two places share a string."""
    return chr(p) if p <= 0xFFFF else chr(p & 0xFFFF) + chr(p >> 16)


class Keys:
    """A word's trigrams with their places, and those with places one up, as strings; kept while words of one trigram and length pass by."""

    def __init__(self) -> None:
        self.of: dict[str, tuple[list[str], frozenset[str]]] = {}
        self.raised: dict[str, tuple[list[str], frozenset[str]]] = {}

    def here(self, word: str) -> tuple[list[str], frozenset[str]]:
        found = self.of.get(word)
        if found is None:
            padded = _BEFORE + word + _AFTER
            keys = [padded[p : p + Q] + _place(p) for p in range(len(word) + Q - 1)]
            found = self.of[word] = keys, frozenset(keys)
        return found

    def both(self, word: str) -> tuple[list[str], frozenset[str]]:
        found = self.raised.get(word)
        if found is None:
            padded = _BEFORE + word + _AFTER
            keys = [padded[p : p + Q] + _place(q) for p in range(len(word) + Q - 1) for q in (p, p + 1)]
            found = self.raised[word] = keys, frozenset(keys)
        return found


def near_in_cell(rows: list[tuple[int, bool, str, int]], across: bool, keys: Keys) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near word, its n) of words of one length with each other and with words shorter by one; rows: (block, shorter, word, n); across: only pairs of different blocks.

    Trigrams that an edit leaves keep their place in a word of the same length, and keep it or move up by one in a longer one.
    """
    sides: tuple[dict, dict] = ({}, {})
    for block, shorter, word, n in rows:
        sides[shorter][word] = (word, n, block)
    homes = list(sides[0].values())
    if not homes or len(homes) + len(sides[1]) < 2:
        return
    postings: dict[str, list[int]] = {}
    for i, (word, _, _) in enumerate(homes):
        for key in keys.here(word)[0]:
            if key in postings:
                postings[key].append(i)
            else:
                postings[key] = [i]
    exact = [keys.here(word)[1] for word, _, _ in homes]
    for after, (word, n, block) in [*enumerate(homes), *((-1, x) for x in sides[1].values())]:
        size = len(word)
        if after >= 0:
            own, mine = keys.here(word)
            least, lists = size - 1, [postings[key] for key in own]
            lists.sort(key=len)
            # Who shares ``least`` of the word's trigrams is in one of the shortest lists; the rest of the count needs no merge.
            short = [tail for x in lists[: size + Q - least] if (tail := x[bisect_right(x, after) :])]
        else:
            own, mine = keys.both(word)
            least, found = size, [postings.get(key) for key in own]
            pairs = [(len(x or ()) + len(y or ()), x, y) for x, y in zip(found[::2], found[1::2], strict=True)]
            pairs.sort(key=_first)
            short = [x for _, *both in pairs[: size + Q - least] for x in both if x]
        last = -1
        for v in heapq.merge(*short) if len(short) > 1 else short[0] if short else ():
            if v == last:
                continue
            last = v
            other = homes[v]
            if across and other[2] == block:
                continue
            if len(mine & exact[v]) >= least and one_edit(word, other[0]):
                # Words of one length in their order: rows come in any, and another place that has both must give the same pair.
                yield (other[0], other[1], word, n) if after >= 0 and other[0] < word else (word, n, other[0], other[1])


_first = itemgetter(0)


_PAIRS = "word string, n long, near string, m long"


def near_pairs(vocabulary: DataFrame, conf: Spelling, ws: Workspace) -> DataFrame:
    """Each pair of near words once: (word, n, near, m)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple[tuple, list]]:
            key, rows = None, []
            for batch in batches:
                for gram, size, pos, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (gram, size, pos, lo, hi) != key:
                        if rows:
                            yield key, rows
                        key, rows = (gram, size, pos, lo, hi), []
                    rows.append(row)
            if rows:
                yield key, rows

        out: list[tuple] = []
        near, keys = None, Keys()
        for key, rows in cells():
            if key[:2] != near:
                near, keys = key[:2], Keys()
            for pair in near_in_cell(rows, key[3] != key[4], keys):
                out.append(pair)
                if len(out) == 20_000:
                    yield _batch(out)
                    out = []
        yield _batch(out)

    cells = _cells(vocabulary, conf, ws)
    # Dealt by trigram and length; the places of one follow each other, so that words seen at one are known at the next.
    dealt = cells.select("gram", "size", "pos", "lo", "hi", "block", "shorter", "word", "n").repartition("gram", "size", "lo", "hi")
    return dealt.sortWithinPartitions("gram", "size", "pos", "lo", "hi").mapInArrow(run, _PAIRS).distinct()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array([r[j] for r in rows], kinds[j]) for j in range(4)], ["word", "n", "near", "m"])


def _roots(forms: DataFrame, ws: Workspace) -> DataFrame:
    """(word, root) of the words that have a form, from (word, root): each round doubles the steps taken."""
    now = ws.save(forms)
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = ws.save(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ws.drop(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_groups(docs: DataFrame, conf: Spelling = Spelling()) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word."""
    prepare(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "spelling")
    vocabulary = ws.save(words(docs, conf))
    pairs = ws.save(near_pairs(vocabulary, conf, ws))
    both = pairs.union(pairs.select("near", "m", "word", "n"))
    # Least of (-m, near): the largest count, then the first in code-point order, which is that of UTF-8 bytes.
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    is_form = -F.col("best.m") >= conf.growth * F.col("n")
    rated = ws.save(near.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")))
    roots = _roots(rated.where("form is not null").select("word", F.col("form").alias("root")), ws)
    out = vocabulary.join(rated, "word", "left").join(roots, "word", "left")
    return ws.finish(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))

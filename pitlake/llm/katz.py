"""Language-model scoring with Katz backoff (operator 9), bigrams over words.

Counts of words and of word pairs are gathered over all training documents, with no cut-off, in tables
partitioned by a hash. Counts up to ``k`` are discounted by Good-Turing; a context's withheld mass goes to
the words not seen after it, in proportion to their own probability, with a weight that makes the
probabilities after every context sum to exactly 1 over the training words and one unknown word:

    p(w | h) = d(r) r / c(h)            if the pair (h, w) has count r > 0
             = weight(h) p(w)           else;  weight(h) = (1 - sum p(seen | h)) / (1 - sum p(seen))
    p(w)     = d(c) c / N               if w has count c > 0;  the unknown word has what is withheld

A context in which nothing is discounted (all counts above k) counts one more than it has, and the one
is withheld. A count for which Good-Turing gives no factor in (0, 1] has an absolute discount, n1 / (n1 + 2 n2).

Documents are dealt into groups of about ``group_bytes``; a group asks each bucket for the words, pairs
and contexts it holds, each once with its own counts, and gets totals back. So a frequent word costs one
question per group. A hot context, which has more tokens than a bucket on average, is spread over buckets;
its sums are added up in one table of at most as many rows as buckets (64 bytes each; some hundredths of
that for natural text), which every group reads. There are as many buckets as groups, and as many
partitions, so a task's share stays the same at any size; a group writes a row for each bucket that it
has a question for, so never more rows than questions.
Words are 64-bit hashes; behind a given context 48 bits of them, and the bucket for a context that is
spread, tell followers apart.

Defined results: null text is empty text, whose one token is the end; a null doc_id is neither held out
nor learned from; repeated rows each count and each get a row; without training text every known
probability is that of the unknown word, 1; other columns are ignored. A very long text is a group's
largest part and is read whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .workspace import Workspace, groups_for, text_bytes

END, BEGIN = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)


@dataclass(frozen=True)
class Spec:
    """k: the highest discounted count."""

    k: int = 5
    group_bytes: int = 8 << 20


def discounts(n: np.ndarray, k: int) -> np.ndarray:
    """d(0..k) from the numbers n[r] of types with count r (r up to k + 1); d(0) is unused."""
    d = np.ones(k + 1)
    r = np.arange(1, k + 1)
    with np.errstate(all="ignore"):
        a = (k + 1) * n[k + 1] / n[1]
        turing = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - a) / (1 - a)
        absolute = 1 - n[1] / (n[1] + 2 * n[2]) / r
    good = lambda x: np.isfinite(x) & (x > 0) & (x <= 1)
    d[1:] = np.where(good(turing), turing, np.where(good(absolute), absolute, 1.0))
    return d


@dataclass
class Unigrams:
    """What all words' counts come to: tokens, types, types by count, and the discounts that follow."""

    tokens: int
    types: int
    by_count: np.ndarray

    def finish(self, k: int) -> Unigrams:
        self.d = discounts(self.by_count, k)
        kept = self.tokens - sum((1 - self.d[r]) * r * self.by_count[r] for r in range(1, k + 1))
        self.total = self.tokens if self.tokens - kept > 1e-9 * max(self.tokens, 1) else self.tokens + 1
        self.unknown = 1.0 - kept / self.total
        return self

    def p(self, c: np.ndarray) -> np.ndarray:
        d = self.d[np.minimum(c, len(self.d) - 1)]
        d = np.where(c >= len(self.d), 1.0, d)
        return np.where(c > 0, d * c / self.total, self.unknown)


def squeeze(v: np.ndarray) -> bytes:
    """Counts in one byte each, larger ones in two or eight more behind."""
    v = np.asarray(v, np.int64)
    large = v[v >= 255]
    huge = large[large >= 65535]
    return len(v).to_bytes(8, "little") + np.minimum(v, 255).astype(np.uint8).tobytes() + np.minimum(large, 65535).astype(np.uint16).tobytes() + huge.tobytes()


def unsqueeze(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    v = np.frombuffer(x, np.uint8, n, 8).astype(np.int64)
    at = np.flatnonzero(v == 255)
    large = np.frombuffer(x, np.uint16, len(at), 8 + n).astype(np.int64)
    huge = np.frombuffer(x[8 + n + 2 * len(at) :], np.int64)
    large[large == 65535] = huge
    v[at] = large
    return v


def six_bytes(v: np.ndarray) -> bytes:
    """The low 48 bits: enough for the followers of one context in one bucket."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(x: bytes) -> np.ndarray:
    raw = np.frombuffer(x, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view(np.uint64).ravel()


def tokens_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, documents one after the other, and where each document's begin."""
    parts, counts = [], []
    for _, _, buf, offs in wh.slices(table.column("text")):
        start, end, first = wh.words(buf, offs)
        h = wh.word_hashes(buf, start, end)
        n = np.diff(first)
        out = np.full(len(h) + len(n), END)
        out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        parts.append(out)
        counts.append(n + 1)
    z = np.zeros(0, np.uint64)
    return np.concatenate([z, *parts]), np.concatenate([[0], *counts]).cumsum().astype(np.int64)


def _by_bucket(bucket: np.ndarray, then: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """For each bucket that occurs the places that have it, in order or by ``then``: one sort, whatever the number of buckets."""
    order = np.argsort(bucket, kind="stable") if then is None else np.lexsort((then, bucket))
    found, first = np.unique(bucket[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, first[1:]), strict=True)) if len(order) else {}


class Group:
    def __init__(self, docs: pa.Table, answers: pa.Table | None, buckets: int, uni: Unigrams | None, spec: Spec):
        self.docs, self.buckets, self.uni, self.spec = docs, buckets, uni, spec
        self.token, self.begin = tokens_of(docs)
        learned = docs.column("learned").to_numpy(zero_copy_only=False).astype(bool)
        self.learned = np.repeat(learned, np.diff(self.begin))
        self.answers: dict[int, dict[int, tuple[bytes, bytes]]] = {1: {}, 2: {}}
        if answers is not None:
            for kind, bucket, a, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "a", "b"))):
                self.answers[kind][bucket] = (a, b)
        self.word, of = np.unique(self.token, return_inverse=True)
        self.word_of = of.astype(np.int32)
        del self.token
        #: Places of each bucket's words; buckets without any are not there.
        self.words_by_bucket = _by_bucket((self.word % np.uint64(buckets)).astype(np.int64))

    def asked_words(self, mp: int) -> Iterator[tuple]:
        own = np.bincount(self.word_of, self.learned, len(self.word)).astype(np.uint32)
        for b, at in self.words_by_bucket.items():
            yield mp, b, self.word[at].tobytes(), squeeze(own[at]), b"", b"", b"", b""

    def counts(self) -> np.ndarray:
        c = np.zeros(len(self.word), np.int64)
        for b, (a, _) in self.answers[1].items():
            c[self.words_by_bucket[b]] = unsqueeze(a)
        return c

    def pairs(self) -> None:
        """Distinct pairs whose words are both known: bucket by bucket, by context."""
        self.count = self.counts()
        before = np.empty(len(self.word_of), np.int32)  # index of the word before, or -1
        before[1:] = self.word_of[:-1]
        before[self.begin[:-1]] = -1
        self.before = before
        ctx = np.where(before >= 0, self.word[before], BEGIN)
        known = (self.count[self.word_of] > 0) & ((before < 0) | (self.count[before] > 0))
        wide = len(self.word) + 1
        code = np.where(known, (before.astype(np.int64) + 1) * wide + self.word_of, -1)
        lone_ctx = np.unique(ctx[(self.count[self.word_of] == 0) & ((before < 0) | (self.count[before] > 0))])
        self.pair, first, of = np.unique(code, return_index=True, return_inverse=True)
        self.pair_of = of.astype(np.int32)
        del code, known, of
        self.pair_n = np.bincount(self.pair_of, self.learned, len(self.pair)).astype(np.uint32)
        self.skip = int(len(self.pair) and self.pair[0] < 0)  # the first entry stands for unknown pairs
        at = first[self.skip :]
        self.pair_ctx, self.pair_w = ctx[at], self.word[self.word_of[at]]
        self.pair_c = self.count[self.word_of[at]]
        n_ctx = np.where(before[at] >= 0, self.count[before[at]], self.uni.by_count[0])
        hot = n_ctx > self.uni.tokens / self.buckets
        spread = wh.mix(self.pair_ctx + np.where(hot, wh.mix(self.pair_w), np.uint64(0)))
        self.pair_bucket = (spread % np.uint64(self.buckets)).astype(np.int64)
        self.hot = np.unique(self.pair_ctx[hot])
        # Contexts of unknown words alone: no pair asks for their weight.
        lone = np.setdiff1d(lone_ctx, self.pair_ctx)
        lone_n = np.where(lone == BEGIN, self.uni.by_count[0], self.count[np.minimum(np.searchsorted(self.word, lone), len(self.word) - 1)]) if len(lone) else np.zeros(0)
        lone = lone[lone_n <= self.uni.tokens / self.buckets]
        lone_bucket = (wh.mix(lone + np.uint64(0)) % np.uint64(self.buckets)).astype(np.int64)
        self.place: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own_of, lone_of = _by_bucket(self.pair_bucket, self.pair_ctx), _by_bucket(lone_bucket)
        none = np.zeros(0, np.int64)
        for b in sorted(own_of.keys() | lone_of.keys()):
            own = own_of.get(b, none)
            self.place[b] = own, np.unique(np.concatenate([self.pair_ctx[own], lone[lone_of.get(b, none)]]))

    def asked_pairs(self, mp: int) -> Iterator[tuple]:
        self.pairs()
        n = self.pair_n[self.skip :]
        for b, (own, contexts) in self.place.items():
            runs = np.searchsorted(self.pair_ctx[own], contexts, "right") - np.searchsorted(self.pair_ctx[own], contexts)
            yield mp, b, contexts.tobytes(), squeeze(runs), six_bytes(self.pair_w[own]), squeeze(n[own]), squeeze(self.pair_c[own]), np.packbits(np.isin(contexts, self.hot)).tobytes()

    def result(self, d2: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> pa.Table:
        """``hot``: the hot contexts, sorted, and their statistics."""
        self.pairs()
        k, uni = self.spec.k, self.uni
        r = np.zeros(len(self.pair), np.int64)
        ctx_all, stat_all = [], []
        for b, (own, contexts) in self.place.items():
            a, s = self.answers[2][b]
            r[self.skip + own] = unsqueeze(a)
            cold = contexts[~np.isin(contexts, self.hot)]
            ctx_all.append(cold)
            m = len(cold)
            stat_all.append(np.concatenate([unsqueeze(s[8 * m :]).reshape(k + 1, m), np.frombuffer(s, np.float64, m)[None]]))
        ctx = np.concatenate([*ctx_all, hot[0]])
        stats = np.concatenate([*stat_all, hot[1]], 1)
        order = np.argsort(ctx)
        ctx, stats = ctx[order], stats[:, order]
        # stats: types with count 1..k, tokens of counts above k, probability of the followers.
        rs = np.arange(1, k + 1)[:, None]
        total = (rs * stats[:k]).sum(0) + stats[k]
        kept = (d2[1 : k + 1][:, None] * rs * stats[:k]).sum(0) + stats[k]
        total = np.where(total - kept > 1e-9 * total, total, total + 1)
        weight = (1 - kept / total) / np.maximum(1 - stats[k + 1], 1e-15)
        # Every token: its context's place among the contexts asked for, if it was.
        c = self.count[self.word_of]
        p1 = uni.p(c)
        own_ctx = np.where(self.before >= 0, self.word[self.before], BEGIN)
        names = np.concatenate([self.word, [BEGIN]])
        at = np.searchsorted(ctx, names)
        at[at >= len(ctx)] = 0
        there = ctx[at] == names if len(ctx) else np.zeros(len(names), bool)
        token_ctx = np.where(self.before >= 0, self.before, len(self.word))
        has, i = there[token_ctx], at[token_ctx]
        count = r[self.pair_of]
        low = np.minimum(count, k)
        if len(ctx):
            seen = np.where(count > k, 1.0, d2[low]) * count / total[i]
            p = np.where(count > 0, seen, np.where(has, weight[i], 1.0) * p1)
        else:
            p = p1
        base = np.log10((c + 1) / (uni.tokens + 1 * (uni.types + 1)))
        doc = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        m = len(self.begin) - 1
        add = lambda v: np.bincount(doc, v, m)
        return pa.table({
            "doc_id": self.docs.column("doc_id"), "held_out": self.docs.column("held_out"), "n_tokens": np.diff(self.begin), "n_known": add(c > 0).astype(np.int64),
            "train_tokens": np.full(m, uni.tokens, np.int64), "base_score": add(base), "score": add(np.log10(p)),
        })


ASKED = "mp long, bucket long, a binary, b binary, c binary, d binary, e binary, f binary"
ANSWER = "mp long, kind int, bucket long, a binary, b binary"
_ASKED_TYPES = (pa.int64(), pa.int64(), *[pa.binary()] * 6)
_ANSWER_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())


def _table(rows: list[tuple], types: tuple, names: str) -> pa.Table:
    cols = zip(*rows) if rows else [[]] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in names.split(", ")])


def _by_count(n: np.ndarray, k: int) -> np.ndarray:
    out = np.bincount(np.minimum(n, k + 2), minlength=k + 3)[: k + 2].astype(np.int64)
    return out


def _blobs(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _counts(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [unsqueeze(x.as_py()) for x in column]


def _total(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each row's is among them, and the sums of n."""
    distinct, back = np.unique(key, return_inverse=True)
    return distinct, back, np.bincount(back, n, len(distinct)).astype(np.int64)


def _words(spec: Spec):
    """One bucket of the word table: totals for those who asked, and a row of statistics (mp -1)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        words, own = _blobs(rows.column("a"), np.uint64), _counts(rows.column("b"))
        _, back, n = _total(np.concatenate(words), np.concatenate(own))
        b, mps = key[0].as_py(), rows.column("mp").to_pylist()
        cut = np.cumsum([len(w) for w in words])[:-1]
        out = [(mp, 1, b, squeeze(n[x]), b"") for mp, x in zip(mps, np.split(back, cut))]
        stats = np.concatenate([[n.sum(), (n > 0).sum()], _by_count(n, spec.k)])
        return _table([*out, (-1, 1, b, stats.astype(np.int64).tobytes(), b"")], _ANSWER_TYPES, ANSWER)

    return run


def _pairs(spec: Spec, uni: Unigrams):
    """One bucket of the pair table: totals, sums of the contexts, and a row of statistics."""
    k = spec.k

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        contexts, runs = _blobs(rows.column("a"), np.uint64), _counts(rows.column("b"))
        follow, own, c = [from_six(x.as_py()) for x in rows.column("c")], _counts(rows.column("d")), _counts(rows.column("e"))
        ctx, back = np.unique(np.concatenate(contexts), return_inverse=True)
        place = np.repeat(back, np.concatenate(runs))
        w, c = np.concatenate(follow), np.concatenate(c)
        pair, which, n = _total(wh.mix(wh.mix(ctx[place]) ^ w), np.concatenate(own))
        of, count = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        of[which], count[which] = place, c
        stats = np.zeros((k + 2, len(ctx)))
        for r in range(1, k + 1):
            stats[r - 1] = np.bincount(of[n == r], minlength=len(ctx))
        stats[k] = np.bincount(of, np.where(n > k, n, 0), len(ctx))
        stats[k + 1] = np.bincount(of, np.where(n > 0, uni.p(count), 0.0), len(ctx))
        b, out = key[0].as_py(), []
        flags = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(y)).astype(bool) for x, y in zip(rows.column("f"), contexts)]
        hot = np.zeros(len(ctx), bool)
        hot[back] = np.concatenate(flags)
        pairs_cut = np.split(which, np.cumsum([len(x) for x in follow])[:-1])
        ctx_cut = np.split(back, np.cumsum([len(x) for x in contexts])[:-1])
        for mp, x, y in zip(rows.column("mp").to_pylist(), pairs_cut, ctx_cut):
            y = y[~hot[y]]
            out.append((mp, 2, b, squeeze(n[x]), stats[k + 1, y].tobytes() + squeeze(stats[: k + 1, y].ravel())))
        if hot.any():
            out.append((-1, 3, b, ctx[hot].tobytes(), stats[:, hot].tobytes()))
        return _table([*out, (-1, 2, b, _by_count(n, k).tobytes(), b"")], _ANSWER_TYPES, ANSWER)

    return run


def _hot_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ctx = np.frombuffer(a, np.int64)
                stats = np.frombuffer(b, np.float64).reshape(k + 2, len(ctx))
                yield pa.RecordBatch.from_arrays([pa.array(ctx), *(pa.array(row) for row in stats)], ["ctx", *(f"s{i}" for i in range(k + 2))])

    return run


def _hot_contexts(pairs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the hot contexts over all buckets: at most a row for each bucket."""
    names = [f"s{i}" for i in range(k + 2)]
    parts = pairs.where("kind = 3").select("a", "b").mapInArrow(_hot_rows(k), "ctx long, " + ", ".join(f"{x} double" for x in names))
    found = parts.groupBy("ctx").agg(*(F.sum(x).alias(x) for x in names)).toPandas()
    ctx = found["ctx"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(ctx)
    return ctx[order], found[names].to_numpy(np.float64).T.reshape(k + 2, len(ctx))[:, order]


def _statistics(answers: DataFrame, kind: int) -> np.ndarray:
    """Sums of the buckets' statistics, a few numbers each, made where they are; a row for each place comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(a, np.int64) for a in batch.column(0).to_pylist()]
            if rows:
                total = sum(rows, np.zeros_like(rows[0]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    rows = answers.where((F.col("mp") == -1) & (F.col("kind") == kind)).select("a").mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum("v")).collect()
    return np.array([v for _, v in sorted(map(tuple, rows))] or [0], np.int64)


def score_texts(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document."""
    spark = docs.sparkSession
    ws = Workspace(spark, "katz")
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(part == 2, F.lit(False)).alias("held_out"), F.coalesce(part != 2, F.lit(False)).alias("learned"), F.coalesce("text", F.lit("")).alias("text"))
    n = groups_for(text_bytes(docs), spec.group_bytes)
    docs = docs.withColumn("mp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    dealt = docs.repartition(n, "mp")
    starts = docs.where("learned").count()

    def first(key: tuple, rows: pa.Table) -> pa.Table:
        return _table(list(Group(rows, None, n, None, spec).asked_words(key[0].as_py())), _ASKED_TYPES, ASKED)

    words = ws.save(dealt.groupBy("mp").applyInArrow(first, ASKED).repartition(n, "bucket").groupBy("bucket").applyInArrow(_words(spec), ANSWER))
    s = _statistics(words, 1)
    s = s if len(s) > 1 else np.zeros(spec.k + 4, np.int64)
    by_count = s[2:].copy()
    by_count[0] = starts  # of the context at the beginning of texts
    uni = Unigrams(int(s[0]), int(s[1]), by_count).finish(spec.k)

    def second(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        asked = list(Group(rows, known, n, uni, spec).asked_pairs(key[0].as_py())) if len(rows) else []
        return _table(asked, _ASKED_TYPES, ASKED)

    told = lambda answers: answers.where("mp >= 0").repartition(n, "mp").groupBy("mp")
    asked = dealt.groupBy("mp").cogroup(told(words)).applyInArrow(second, ASKED)
    pairs = ws.save(asked.repartition(n, "bucket").groupBy("bucket").applyInArrow(_pairs(spec, uni), ANSWER))
    s = _statistics(pairs, 2)
    hot = spark.sparkContext.broadcast(_hot_contexts(pairs, spec.k))
    d2 = discounts(s if len(s) > 1 else np.zeros(spec.k + 2, np.int64), spec.k)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}})

    def last(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        return Group(rows, known, n, uni, spec).result(d2, hot.value) if len(rows) else empty

    return ws.finish(dealt.groupBy("mp").cogroup(told(words.union(pairs))).applyInArrow(last, schema))

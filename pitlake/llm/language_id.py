"""Language identification by segmentation-marginalised unigrams (operator 8).

Pieces are those of a fixed public vocabulary (a path, never copied) that lower-case letters can spell,
of any length, and all single bytes; pieces with capitals, digits or signs fit no word and so have no
part in any segmentation. Each language has a probability for every piece; the probability of a word is
the sum over all of its segmentations, by the forward algorithm, and a text's is the product over its words.
Piece probabilities come from forward-backward expectations on labelled documents, one language a task,
on a bounded sample: all words of about ``per_language`` documents, drawn by a hash of doc_id. Scoring covers every
word of every text, whole. Words over ``SHORT`` bytes, as whole clauses are in scripts without spaces, take the same
recursions in logarithms: scoring keeps only as many columns as the longest piece has bytes, learning one number
a byte, so a word of megabytes costs time in proportion to its length.

A word is a run of letters of any script with their marks, lower-cased, with the space before it.
Words repeat, so a task keeps what it has computed in a table of fixed size. The model is a number for
each piece and language on driver and tasks (0.25 MB a language).

Defined results: ``und`` with score 0 for null text and texts without a letter (a Unicode letter: signs,
digits and pictures of any script are none), or where nothing was learned; a null doc_id stays null, counts as not held out and is never learned from; repeated rows each
get a row; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .workspace import fresh_name, prepare

UND = "und"
#: Bytes up to which words are scored by whole lattices, in plain probabilities: 32 pieces of 1e-8 are still above the least double.
SHORT = 32
#: Bytes of a task's table of words that it has scored.
KNOWN_BYTES = 32 << 20
#: Hashes of languages in the table that thins documents before the sample is drawn.
SLOTS = 4096
LETTER = wh.ALNUM.copy()
LETTER[0x30:0x3A] = False


@dataclass(frozen=True)
class Spec:
    """per_language: documents to learn from; rounds: of expectation-maximisation."""

    per_language: int = 1500
    rounds: int = 3
    smoothing: float = 0.1


class Pieces:
    """The vocabulary as a hash table: two places for each key, so a lookup is two gathers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = [base64.b64decode(x.split()[0]) for x in f if x.strip()]
        fits = lambda p: all(LETTER[b] and not 0x41 <= b < 0x5B for b in p[p[:1] == b" " :])
        kept = sorted({p for p in raw if fits(p)} | {bytes([b]) for b in range(256) if not 0x41 <= b < 0x5B})
        self.n = len(kept)
        lens = np.array([len(p) for p in kept])
        self.sizes = np.unique(lens)
        ends = np.cumsum(lens)
        buf = np.frombuffer(b"".join(kept), np.uint8)
        self.keys = np.append(wh.word_hashes(buf, ends - lens, ends), np.uint64(0))
        space = np.frombuffer(b" ", np.uint8)
        self.space = self.find(wh.word_hashes(space, np.array([0]), np.array([1])), build=True)[0]

    def find(self, key: np.ndarray, build: bool = False) -> np.ndarray:
        """Index of each key's piece, or n."""
        if build:
            self.tables = np.full((2, 1 << 20), self.n, np.int32)
            a, b = self.places(self.keys[:-1])
            self.tables[0, a] = np.arange(self.n)
            second = np.flatnonzero(self.tables[0, a] != np.arange(self.n))
            self.tables[1, b[second]] = second
            assert (self.tables[1, b[second]] == second).all(), "two pieces share both places"
        a, b = self.places(key)
        i = self.tables[0, a]
        miss = np.flatnonzero(self.keys[i] != key)
        j = self.tables[1, b[miss]]
        i[miss] = np.where(self.keys[j] == key[miss], j, self.n)
        return i

    @staticmethod
    def places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (key >> np.uint64(44)).astype(np.int64), (key & np.uint64((1 << 20) - 1)).astype(np.int64)


def letter_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of letters."""
    start, end, first = wh.words(buf, offs, LETTER)
    return start, end, np.repeat(np.arange(len(offs) - 1), np.diff(first))


class Lattice:
    """The pieces that fit in each of some words: for every end t and size k, the piece's index."""

    def __init__(self, pieces: Pieces, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.order = np.argsort(start - end, kind="stable")
        start, end = start[self.order], end[self.order]
        self.size = end - start
        power, inverse = wh._power_tables(len(buf) + 2)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(wh._byte_values()[buf] * power[: len(buf)], out=sums[1:])
        blank, step = wh._byte_values()[0x20], power[1]
        self.fits: list[list[tuple[int, np.ndarray]]] = []  # by t: (k, pieces); k = t + 1 takes the space in
        self.longest = int(self.size.max()) if len(self.size) else 0
        for t in range(1, self.longest + 1):
            n = int((self.size >= t).sum())
            s = start[:n]
            at = []
            for k in pieces.sizes[pieces.sizes <= t].tolist():
                h = (sums[s + t] - sums[s + t - k]) * inverse[s + t - k]
                at.append((k, pieces.find(wh.mix(h + np.uint64(k)))))
            if t + 1 in pieces.sizes:
                h = (sums[s + t] - sums[s]) * inverse[s] * step + blank
                at.append((t + 1, pieces.find(wh.mix(h + np.uint64(t + 1)))))
            self.fits.append(at)

    def forward(self, p: np.ndarray, space: int) -> list[np.ndarray]:
        """alpha[t][word, language]: probability of the space and the first t bytes; p has a zero row at its end."""
        alpha = [np.broadcast_to(p[space], (len(self.size), p.shape[1]))]
        for t, fits in enumerate(self.fits, 1):
            n = len(fits[0][1])
            a = np.zeros((n, p.shape[1]))
            for k, piece in fits:
                a += p[piece] if k > t else alpha[t - k][:n] * p[piece]
            alpha.append(a)
        return alpha

    def total(self, alpha: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(self.size), alpha[0].shape[1]))
        for t in range(1, self.longest + 1):
            at = np.flatnonzero(self.size == t)
            out[at] = alpha[t][at]
        return out

    def expected(self, p: np.ndarray, space: int, count: np.ndarray) -> np.ndarray:
        """How often each piece is used, over words with these counts, for one language."""
        alpha = self.forward(p, space)
        z = np.maximum(self.total(alpha)[:, 0], 1e-300)
        w = count[self.order] / z
        beta = [np.zeros(len(self.size)) for _ in range(self.longest + 1)]
        for t in range(1, self.longest + 1):
            beta[t][self.size == t] = 1
        used = np.zeros(len(p))
        for t in range(self.longest, 0, -1):
            for k, piece in self.fits[t - 1]:
                n = len(piece)
                out = p[piece, 0] * beta[t][:n]
                before = 1.0 if k > t else alpha[t - k][:n, 0]
                used += np.bincount(piece, before * out * w[:n], len(p))
                if k <= t:
                    beta[t - k][:n] += out
        used[space] += (p[space, 0] * beta[0] * w).sum()
        used[-1] = 0
        return used


def word_log_probabilities(pieces: Pieces, p: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    out = np.empty((len(start), p.shape[1]))
    by_size = np.argsort(start - end, kind="stable")
    long = int((end - start > SHORT).sum())
    for lo in range(0, long, 256):
        at = by_size[lo : min(lo + 256, long)]
        out[at] = long_word_log_probabilities(pieces, p, buf, start[at], end[at])
    for lo in range(long, len(start), block):
        at = by_size[lo : lo + block]
        lattice = Lattice(pieces, buf, start[at], end[at])
        out[at[lattice.order]] = np.log(np.maximum(lattice.total(lattice.forward(p, pieces.space)), 1e-300))
    return out


class _Reach:
    """Pieces that end at given places of words, by size."""

    def __init__(self, pieces: Pieces, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.pieces, self.start, self.end = pieces, start, end
        self.power, self.inverse = wh._power_tables(len(buf) + 2)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(wh._byte_values()[buf] * self.power[: len(buf)], out=self.sums[1:])

    def found(self, t: int, many: int, n: int) -> np.ndarray:
        """[i, size, word]: the piece of that size that ends with the first t + 1 + i bytes of one of the first n words, or none; one longer than these bytes takes the space in."""
        pieces, sums, inverse = self.pieces, self.sums, self.inverse
        ts = np.arange(t + 1, t + 1 + many)
        start, end = self.start[:n, None], self.end[:n, None]
        z = np.minimum(start + ts, end)  # past a word's end nothing is read off
        out = np.empty((many, len(pieces.sizes), n), np.int64)
        for i, k in enumerate(pieces.sizes.tolist()):
            a = np.maximum(z - k, start)
            h = (sums[z] - sums[a]) * inverse[a]
            spaced = ts + 1 == k
            if spaced.any():
                h[:, spaced] = (sums[z[:, spaced]] - sums[a[:, spaced]]) * inverse[a[:, spaced]] * self.power[1] + wh._byte_values()[0x20]
            piece = pieces.find(wh.mix(h + np.uint64(k)).ravel()).reshape(h.shape)
            piece[:, ts + 1 < k] = pieces.n
            piece[(ts > end - start)] = pieces.n
            out[:, i] = piece.T
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the first axis; nothing adds up to -inf."""
    top = x.max(0)
    flat = np.where(np.isfinite(top), top, 0.0)
    return flat + np.log(np.exp(x - flat).sum(0))


def long_word_log_probabilities(pieces: Pieces, p: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, cells: int = 1 << 19) -> np.ndarray:
    """The same sum for words of any length, longest first: only the last columns that a piece can reach back to are kept, as logarithms."""
    reached = _Reach(pieces, buf, start, end)
    with np.errstate(divide="ignore"):
        logp = np.log(p)
    sizes, reach = pieces.sizes, int(pieces.sizes[-1])
    size, n, langs = end - start, len(start), p.shape[1]
    # Column reach - 1 + t of the window holds the first t bytes (from t = -1, before the space, on).
    window = np.full((reach + 1, n, langs), -np.inf)
    window[-2], window[-1] = 0.0, logp[pieces.space]
    out = np.empty((n, langs))
    t = 0
    while n:
        many = max(1, min(256, cells // (len(sizes) * n * langs)))
        weight = logp[reached.found(t, many, n)]
        window = np.concatenate([window[-(reach + 1) :, :n], np.empty((many, n, langs))])
        base = window.shape[0] - many
        with np.errstate(divide="ignore"):
            for j in range(many):
                window[base + j] = _log_sum(window[base + j - sizes] + weight[j])
        for i in np.flatnonzero((size[:n] > t) & (size[:n] <= t + many)):
            out[i] = window[base + size[i] - t - 1, i]
        t += many
        n = int((size > t).sum())
    return out


def long_expected(pieces: Pieces, p: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """How often each piece is used over words of any length with these counts, for one language: forward and backward in logarithms.

    Words go in groups of about one length whose bytes are ``cells`` at most, or alone.
    """
    used = np.zeros(pieces.n + 1)
    order = np.argsort(start - end, kind="stable")
    with np.errstate(divide="ignore"):
        logp = np.log(p)
    sizes, reach = pieces.sizes, int(pieces.sizes[-1])
    at = 0
    while at < len(order):
        longest = int((end - start)[order[at]])
        group = order[at : at + max(1, cells // (longest + 1))]
        at += len(group)
        s, size, n = start[group], (end - start)[group], len(group)
        reached = _Reach(pieces, buf, s, end[group])
        # Row reach + 1 + t: the space and the first t bytes; row reach: nothing yet.
        ahead = np.full((reach + longest + 2, n), -np.inf)
        ahead[reach], ahead[reach + 1] = 0.0, logp[pieces.space]
        step = max(1, min(256, cells // (len(sizes) * n)))
        with np.errstate(divide="ignore"):
            for t in range(0, longest, step):
                many = min(step, longest - t)
                weight = logp[reached.found(t, many, n)]
                for j in range(many):
                    row = reach + 2 + t + j
                    ahead[row] = _log_sum(ahead[row - sizes] + weight[j])
        back = np.full_like(ahead, -np.inf)
        back[reach + 1 + size, np.arange(n)] = 0.0
        whole = ahead[reach + 1 + size, np.arange(n)]
        share = np.where(np.isfinite(whole), count[group], 0.0)
        whole = np.where(np.isfinite(whole), whole, 0.0)
        for t in reversed(range(0, longest, step)):
            many = min(step, longest - t)
            piece = reached.found(t, many, n)
            weight = logp[piece]
            for j in reversed(range(many)):
                row = reach + 2 + t + j
                onward = weight[j] + back[row]
                often = np.exp(ahead[row - sizes] + onward - whole) * share
                used += np.bincount(piece[j].ravel(), often.ravel(), pieces.n + 1)
                back[row - sizes] = np.logaddexp(back[row - sizes], onward)
        used[pieces.space] += (np.exp(logp[pieces.space] + back[reach + 1] - whole) * share).sum()
    used[-1] = 0
    return used


def _learn(path: str, spec: Spec):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pieces = Pieces(path)
        col, count = rows.column("word"), rows.column("n").to_numpy().astype(float)
        p = np.full((pieces.n + 1, 1), 1.0 / pieces.n)
        p[-1] = 0
        for _ in range(spec.rounds):
            used = np.zeros(pieces.n + 1)
            for lo, hi, buf, offs in wh.slices(col, 1 << 17):
                start, end, n = offs[:-1], offs[1:], count[lo:hi]
                short = end - start <= SHORT
                used += Lattice(pieces, buf, start[short], end[short]).expected(p, pieces.space, n[short])
                used += long_expected(pieces, p[:, 0], buf, start[~short], end[~short], n[~short])
            used[:-1] += spec.smoothing
            p = (used / used.sum())[:, None]
        return pa.table({"lang": [key[0].as_py()], "p": [p[:-1, 0].tobytes()]})

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a batch; the words' bytes as text."""
    for batch in batches:
        for lo, hi, buf, offs in wh.slices(batch.column(1)):
            start, end, doc = letter_words(buf, offs)
            h = wh.word_hashes(buf, start, end)
            langs, code = np.unique(np.array(batch.column(0).slice(lo, hi - lo).to_pylist(), object).astype(str), return_inverse=True)
            key = wh.mix(h ^ wh.mix(code[doc].astype(np.uint64)))
            _, one, n = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs[code[doc[one]]].tolist(), pa.string()), pa.array([bytes(buf[a:b]) for a, b in zip(start[one], end[one])], pa.binary()), pa.array(n)], ["lang", "word", "n"]
            )


def held_out(docs: DataFrame):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, path: str, spec: Spec = Spec()) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces x languages), learned from labelled documents that are not held out."""
    prepare(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(docs))
    part, salt, salts = fresh_name("share"), fresh_name("salt"), 64
    share = usable.groupBy("lang").agg((F.lit(spec.per_language) / F.count("*")).alias(part))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    # A table of fixed size thins the documents first: for each hash of a language the largest share of those that have it, so none is lost.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    most = dict(map(tuple, share.groupBy(slot("lang")).agg(F.max(part)).collect()))
    shares = F.split(F.lit(",".join(repr(min(1.0, most.get(i, 0.0))) for i in range(SLOTS))), ",").cast("array<double>")
    thin = usable.select("doc_id", "lang", "text").where(rank < F.ceil(F.get(shares, slot("lang")) * (1 << 20)))
    # Then each language's own share decides; a language's rows are spread over ``salts`` keys.
    spread = share.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sample = thin.withColumn(salt, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(salts)).cast("int")).join(spread.hint("merge"), ["lang", salt]).where(rank < F.ceil(F.col(part) * (1 << 20)))
    counts = sample.select("lang", wh.lettered(F.col("text"), digits=False).alias("text")).mapInArrow(_words_of, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    learned = sorted(tuple(r) for r in counts.groupBy("lang").applyInArrow(_learn(path, spec), "lang string, p binary").collect())  # a row a language
    langs = [lang for lang, _ in learned]
    return langs, np.column_stack([np.append(np.frombuffer(p), 0.0) for _, p in learned]) if langs else np.zeros((1, 0))


def scorer(langs: list[str], p: np.ndarray, path: str):
    """A function from a string array to (predicted language, its probability)."""
    pieces = Pieces(path)
    cache = 1 << max(10, (KNOWN_BYTES // (8 * (len(langs) + 1))).bit_length() - 1)
    slots = np.zeros(cache, np.uint64)
    known = np.zeros((cache, len(langs)))

    def words_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = wh.word_hashes(buf, start, end) | np.uint64(1)
        at = (h >> np.uint64(20)).astype(np.int64) & (cache - 1)
        out = known[at]
        miss = np.flatnonzero(slots[at] != h)
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            fresh = word_log_probabilities(pieces, p, buf, start[one], end[one])
            slots[at[one]], known[at[one]] = 0, fresh
            slots[at[one]] = h[one]
            # Two fresh words may share a slot: the last stays, for both arrays alike.
            out[miss] = fresh[back]
        return out

    def run(text: pa.Array) -> tuple[list[str], np.ndarray]:
        names, score = [], []
        for lo, hi, buf, offs in wh.slices(text):
            m = hi - lo
            start, end, doc = letter_words(buf, offs)
            total = np.zeros((m, len(langs)))
            if len(start) and langs:
                w = words_of(buf, start, end)
                for k in range(len(langs)):
                    total[:, k] = np.bincount(doc, w[:, k], m)
            have = np.bincount(doc, minlength=m) > 0 if langs else np.zeros(m, bool)
            if langs:
                e = np.exp(total - total.max(1, keepdims=True))
                best = e.argmax(1)
                names += [langs[b] if h else UND for b, h in zip(best, have)]
                score.append(np.where(have, 1 / e.sum(1), 0.0))
            else:
                names += [UND] * m
                score.append(np.zeros(m))
        return names, np.concatenate(score) if score else np.zeros(0)

    return run


def default_path() -> str:
    import public_tokenizers as t

    return t.path("byte_bpe_50k.tiktoken")


def identify(docs: DataFrame, path: str | None = None, spec: Spec = Spec()) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""
    path = path or default_path()
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, path, spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*model.value, path)
        for batch in batches:
            names, s = score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(s)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out(docs).alias("held_out"), wh.lettered(F.col("text"), digits=False).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, path: str | None = None, spec: Spec = Spec()) -> DataFrame:
    """The documents that have a language, with all their columns: those without a letter are rejected."""
    path = path or default_path()
    names, schema = docs.columns, docs.schema
    lower = fresh_name("lower")
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, path, spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*model.value, path)
        for batch in batches:
            langs, _ = score(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array([x != UND for x in langs], pa.bool_()))

    return docs.select("*", wh.lettered(F.col("text"), digits=False).alias(lower)).mapInArrow(run, schema)

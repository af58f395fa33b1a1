"""Vectorised words, word hashes and shingles straight from Arrow string buffers.

A word is a maximal run of bytes that ``word_bytes`` allows; A-Z count as a-z. Hashes are 64-bit: a
polynomial over random byte values, finished with a bijective mixer, so equal words have equal hashes
and different ones collide with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_FOLD = np.uint64(0xD6E8FEB86659FD93)

#: Bytes of words that white space (0x20, 0x09-0x0D) parts.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of letters and digits; every byte of a character beyond ASCII counts as a letter, so texts go through ``lettered`` first.
ALNUM = np.zeros(256, bool)
ALNUM[0x80:] = True
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


#: Scripts written without spaces between words: each of their characters, with its marks, is a word.
_UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))


def lettered(text: Column, digits: bool) -> Column:
    """Lower-cased text in which characters beyond ASCII are letters (digits too, if wanted) and their marks alone; others are spaces.

    With digits, as for shingles, characters of scripts written without spaces stand alone.
    """
    kept = r"\p{L}\p{N}\p{M}" if digits else r"\p{L}\p{M}"
    sign = rf"[^\x00-\x7F{kept}]\p{{M}}*|(?<![{kept}])\p{{M}}+"
    lower = F.lower(text)
    out = F.regexp_replace(lower, sign, " ")
    if digits:
        out = F.regexp_replace(out, rf"([{_UNSPACED}]\p{{M}}*)", " $1 ")
    # Texts of ASCII, and by one scan those with Latin letters besides, are changed by nothing else.
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(r"[^\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]")
    return F.when(plain, lower).otherwise(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _byte_values() -> np.ndarray:
    t = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t[0x41:0x5B] = t[0x61:0x7B]
    return t


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i mod 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        inv = np.uint64(pow(int(_R), -1, 1 << 64))
        for k, base in enumerate((_R, inv)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``limit`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(buf: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and where each document's words begin (one more entry at the end)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = word_bytes[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    begins = offsets[:-1]
    before[begins[begins < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_byte_values()[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(h: np.ndarray, first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each document, and where each document's begin.

    ``short``: a document of fewer words has the whole sequence as its one shingle; else it has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, ((n > 0) & short).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    full = np.where(n >= k, count, 0)
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first[:-1], full)
    s = h[at] + np.uint64(k)
    for j in range(1, k):
        s = s * _FOLD + h[at + j]
    out = np.empty(begin[-1], np.uint64)
    is_full = np.repeat(n >= k, count)
    out[is_full] = s
    if short:
        for d in np.flatnonzero((n > 0) & (n < k)):
            x = np.uint64(0x5851F42D4C957F2D)
            with np.errstate(over="ignore"):
                for w in h[first[d] : first[d + 1]]:
                    x = x * _FOLD + w
            out[begin[d]] = x
    return mix(out), begin

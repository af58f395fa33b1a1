"""Small documents with the awkward cases: nulls, empty and long texts, repeats and clashing columns."""

import random
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, mp long, name string, key string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['a', 'b', 'ing', 'tion'])}" for _ in range(n))


def texts():
    rng = random.Random(4)
    base = prose(rng, 80)
    near = base.split()
    near[40] = "changed"
    passage = prose(rng, 70)
    out = [base, base, " ".join(near), base.upper(), passage + " " + prose(rng, 50), prose(rng, 60) + " " + passage, prose(rng, 90), "", None, "   \n\t ", "one two", "one two", "a", prose(rng, 4000), "é è ü " + prose(rng, 40), "123 456"]
    return out


def documents(spark, more=()):
    rows = [(i, t, ["en", "de"][i % 2], "src0", len(t or ""), 1, 2, "x", None) for i, t in enumerate([*texts(), *more])]
    rows += [(3, texts()[3], "en", None, None, None, None, None, None), (None, "a row without an id and some words", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m

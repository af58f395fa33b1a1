import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from pitlake.llm import packing

from .helpers import WORDS, documents, lower, nothing, prose
from .test_near_dedup import brute
from .test_scans import base

LETTERS = re.compile(r"[^\W_]+")
SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


def corpus(spark, items):
    """The awkward rows, a copied secret, benchmark passages, and copies that repeat or lack an id."""
    import random

    rng = random.Random(21)
    one = prose(rng, 60, 5000)
    more = [f"{prose(rng, 20, 5000)} {SECRET} {prose(rng, 20, 5000)}", f"{prose(rng, 30, 5000)} {items[0]} {prose(rng, 30, 5000)}", items[1].upper(), "— 12 %", one, one + " x"]
    docs = documents(spark, more)
    twice = spark.createDataFrame([(None, one, *[None] * 7), (3, prose(rng, 50, 5000), *[None] * 7), (3, SECRET, *[None] * 7)], docs.schema)
    return docs.union(twice)


def contained(text, items, k=5):
    def grams(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    words = LETTERS.findall((text or "").lower())
    for item in items:
        own = LETTERS.findall(item.lower())
        n = min(k, len(own))
        want = grams(own, n) if n else set()
        if want and len(want & grams(words, n)) >= 0.8 * len(want) - 1e-9:
            return True
    return False


def masked(text):
    out, at = [], 0
    for a, _, b in base(text):
        if b > at:
            out += [text[at:a], "[SECRET]"] if a >= at else []
            at = max(at, b)
    return "".join(out) + text[at:]


def test_stages_equal_plain_python(spark, sf, tmp_path):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    docs = corpus(spark, items)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda df: Counter(r.text for r in df.collect())

    after = stage["language_id"](spark, now, str(tmp_path))
    kept = [r.text for r in now.collect() if any(c.isalpha() for c in r.text or "")]
    assert texts(after) == Counter(kept) and after.columns == docs.columns

    after2 = stage["near_dedup"](spark, after, str(tmp_path))
    rows = after2.collect()
    groups, _ = brute(list(enumerate(kept)), k=5)
    mine = Counter(groups[min(i for i, t in enumerate(kept) if t == r.text)] for r in rows)
    assert set(mine) == set(groups.values()) and max(mine.values()) == 1 and after2.columns == docs.columns

    after3 = stage["decontamination"](spark, after2, str(tmp_path))
    clean = [r.text for r in rows if not contained(r.text, items)]
    assert texts(after3) == Counter(clean) and len(clean) < len(rows)

    after4 = stage["secret_scan"](spark, after3, str(tmp_path))
    assert texts(after4) == Counter(masked(t) for t in clean) and any("[SECRET]" in r.text for r in after4.collect())

    out = corpus_pipeline.run(spark, str(tmp_path))
    slow, _ = packing._encoders(*packing.vocabulary())
    want = Counter()
    for t in map(masked, clean):
        ids = [*slow.encode(t, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        cuts = sorted({0, *range(first, len(ids) + 1, 2048)})
        want.update((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()) == want


def test_run_without_rows(spark, sf, tmp_path):
    nothing(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0


def test_words_are_those_of_the_brute_force():
    assert WORDS.findall(lower("A b\tC")) == ["a", "b", "c"]

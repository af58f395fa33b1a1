import math
import random
import re
from collections import Counter

import pytest

from pitlake.llm import lexical

from .helpers import documents, lower, nothing

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, rank int, score int, term string"


def terms(text):
    return [lower(t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    tf = [Counter(terms(t)) for _, t in docs]
    held = [sum(c.values()) for c in tf]
    big_n, big_l = sum(n > 0 for n in held), sum(held)
    df = Counter(t for c in tf for t in c)
    w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked, ranked = terms(text), []
        for (doc_id, _), c, n in zip(docs, tf, held):
            if n:
                m = 25 + 75 * n * big_n // big_l
                score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
                if score > 0:
                    ranked.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, conf=lexical.LexicalSearch()):
    rows = lexical.search(docs, items, conf).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=str)


def pairs(df, ids):
    return [(r[ids], r.text) for r in df.collect()]


def items_of(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], ITEMS)


def test_awkward_documents_and_items(spark):
    docs = documents(spark, ["Ärger über 42 Äpfel", "übér ärger", "北京 ist 北京, 42"])
    items = items_of(spark, [None, "", "?!", "w1a w2b w3ing one two", "one two one", "É è", "zzzz", "42 北京 ÄPFEL über", "word " * 3000 + "w5a"])
    assert found(spark, docs, items) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
    twice = items.union(items.where("item_id = 4"))
    assert len(found(spark, docs, twice)) == len(found(spark, docs, items)) + sum(1 for x in brute(pairs(docs, "doc_id"), pairs(items, "item_id")) if x[0] == 4)


@pytest.mark.parametrize("k", [1, 10])
def test_random_corpora_in_many_shards(spark, k):
    rng = random.Random(k)
    vocabulary = [f"t{i}" for i in range(120)]
    odds = [1 / (i + 1) for i in range(120)]
    texts = [" ".join(rng.choices(vocabulary, odds, k=rng.randrange(0, 60))) for _ in range(700)] + ["t3 t4"] * 30  # ties
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    items = items_of(spark, [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 25))) for _ in range(25)] + ["t3 t4"])
    want = brute(pairs(docs, "doc_id"), pairs(items, "item_id"), k)
    assert found(spark, docs, items, lexical.LexicalSearch(k=k)) == want
    # Chunks of few terms and a bitmap that lets most terms through change nothing.
    assert found(spark, docs, items, lexical.LexicalSearch(k=k, chunk_terms=40, bitmap_bits=8)) == want


def test_pivots_skip_documents_that_cannot_win():
    """The cursors of a block give the same heap as scores of all its documents, and few of these are scored."""
    rng = random.Random(3)
    scored = postings = 0
    for _ in range(60):
        lists = []
        for _ in range(rng.randrange(1, 9)):
            docs = sorted(rng.sample(range(400), rng.randrange(1, 300)))
            lists.append((docs, [rng.randrange(0, 1000) // rng.choice([1, 1, 1 + len(docs) // 10]) for _ in docs] if rng.random() < 0.3 else [rng.randrange(500, 1000) * 10 // len(docs) for _ in docs]))
            postings += len(docs)
        total = Counter()
        for docs, impacts in lists:
            for d, x in zip(docs, impacts):
                total[d] += x
        keys = rng.sample(range(1000), 400)
        heap: list = []

        class Counted(list):
            def __getitem__(self, i):
                nonlocal scored
                scored += 1
                return list.__getitem__(self, i)

        lexical._wand([[d[0], 0, max(x), d, Counted(x)] for d, x in lists], heap, 5, keys)
        want = sorted(((s, -keys[d]) for d, s in total.items() if s > 0), reverse=True)[:5]
        assert sorted(heap, reverse=True) == want
    assert scored < 0.9 * postings


def test_empty_tables(spark):
    items = items_of(spark, ["one two"])
    assert lexical.search(nothing(spark), items).count() == 0
    assert lexical.search(documents(spark), items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert lexical.search(blank, items).count() == 0
    assert lexical.search(documents(spark), items_of(spark, [None, "..."])).columns == ["item_id", "rank", "doc_id", "score"]

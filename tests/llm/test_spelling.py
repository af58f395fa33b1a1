import random
import re
import zlib
from collections import Counter

import pytest

from pitlake.llm import spelling
from pitlake.llm.workspace import Workspace

from .helpers import documents, lower, nothing

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = brute_words(rows)
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


def found(df, conf=spelling.Spelling()):
    rows = spelling.spelling_groups(df, conf).collect()
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def misspelt(seed, n=220):
    rng = random.Random(seed)
    letters = "abcdeéèÉÀ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(30)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "x" * 3000, "x" * 3001]
    texts = []
    for _ in range(n):
        out = []
        for w in rng.choices(base, k=25):
            if rng.random() < 0.35:
                i = rng.randrange(len(w) + 1)
                w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
            out.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice([" ", ", ", "1", "ā"]).join(out))
    return texts


def test_groups_equal_those_of_all_pairs(spark):
    docs = documents(spark, misspelt(1))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert found(docs) == want and sum(f is not None for _, f, *_ in want) > 20 and any(f and r != f for _, f, r, *_ in want)


@pytest.mark.parametrize("block", [1, 3, 17])
def test_meeting_places_cut_into_blocks_give_the_same(spark, block):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(misspelt(2, 120))], "doc_id long, text string")
    assert found(docs, spelling.Spelling(block=block)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_near_pairs_come_once(spark):
    words = spark.createDataFrame([(w, 3) for w in ("aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "banana", "bananas", "bandana", "hxllo", "hello", "hellow")], "word string, n long")
    rows = spelling.near_pairs(words, spelling.Spelling(), Workspace(spark, "t")).collect()
    got = [frozenset((r.word, r.near)) for r in rows]
    every = [r.word for r in words.collect()]
    assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for a in every for b in every if near(a, b)}


def test_one_edit():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = sorted(("".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))) for _ in range(2)), key=len)
        if len(b) - len(a) <= 1:
            assert spelling.one_edit(a, b) == near(a, b)


def test_roots_of_long_chains(spark):
    """A chain of words, each one edit from the next and half as frequent."""
    chain = ["abcde"]
    for i in range(11):
        w = chain[-1]
        chain.append(w + "fghijklmnopq"[i] if i % 2 else w[:i] + "z" + w[i + 1 :] if i < len(w) else w + "y")
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))
    rows = [(1, text)]
    conf = spelling.Spelling(typo=0)
    got = {r.word: r.root for r in spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"), conf).collect()}
    assert set(got) == set(chain) and got[chain[0]] == chain[-1]


def test_no_words(spark):
    assert spelling.spelling_groups(nothing(spark)).count() == 0
    few = spark.createDataFrame([(1, None), (2, ""), (3, "abcde abcde"), (4, "123 ??")], "doc_id long, text string")
    assert spelling.spelling_groups(few).count() == 0
    alone = spark.createDataFrame([(1, "Zebra zebra ZEBRA", 9, 9)], "doc_id long, text string, word int, n int")
    assert found(alone, spelling.Spelling(typo=0)) == {("zebra", None, "zebra", 3, 0, None)}


def test_order_of_rows_does_not_turn_pairs_around(spark):
    """Executors fetch shuffled rows in any order; a pair that meets at two places must come out the same way at both."""
    rows = [(0, False, w, 3) for w in ("aaaab", "aaaac", "aaaad")] + [(0, True, "aaaa", 3)]
    near_in = lambda rows: sorted(spelling.near_in_cell(rows, False, spelling.Keys()))
    assert near_in(rows) == near_in(rows[::-1]) and len(near_in(rows)) == 6


def test_places_beyond_65535_are_told_apart():
    n = 65_600
    pairs = spelling.near_in_cell([(0, False, "a" * n, 3), (0, False, "a" * (n - 1) + "b", 3), (0, True, "a" * (n - 1), 3)], False, spelling.Keys())
    assert len(list(pairs)) == 3

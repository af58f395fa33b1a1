import random
from collections import defaultdict

from pitlake.llm.components import connected_components
from pitlake.llm.near_dedup import NearDedup, near_duplicates
from pitlake.llm.workspace import Workspace

from .helpers import WORDS, documents, lower, nothing, prose


def brute(rows, k=4, percent=80):
    sets = defaultdict(list)
    for i, t in rows:
        w = WORDS.findall(lower(t or ""))
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets[i].append(s)
    flat = [(i, s) for i, v in sets.items() if i is not None for s in v if s]
    parent = {i: i for i in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(flat)):
        for y in range(x):
            (i, a), (j, b) = flat[x], flat[y]
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}, {i: {len(s) for s in v} for i, v in sets.items()}


def test_matches_brute_force_with_awkward_rows(spark):
    rng = random.Random(9)
    original = prose(rng, 150).split()
    copies = []
    for k in range(60):  # a chain and a cloud of edits, many under the limit against the original
        w = original[:]
        for _ in range(1 + k % 8):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        copies.append(" ".join(w))
    docs = documents(spark, copies)
    rows = docs.select("doc_id", "text").collect()
    expected, sizes = brute([tuple(r) for r in rows])
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.component_id == expected[r.doc_id]
        assert r.n_shingles in sizes[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_rows_that_share_an_id_keep_their_own_links(spark):
    rng = random.Random(5)
    a, b = prose(rng, 60, 5000), prose(rng, 60, 5000)
    edit = lambda t: " ".join([*t.split()[:-2], "other", "end"])
    rows = [(3, a), (3, b), (5, edit(a)), (6, edit(b)), (7, prose(rng, 60, 5000)), (7, a.upper())]
    expected, _ = brute(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.component_id == expected[r.doc_id] for r in got if r.doc_id in (3, 5, 6))
    assert sorted(r.component_id for r in got if r.doc_id == 7) == [3, 7]


def test_a_family_that_shares_buckets_but_never_links(spark):
    rng = random.Random(6)
    shared = prose(rng, 80, 5000)
    rows = [(i, shared + " " + prose(rng, 40, 5000)) for i in range(40)]
    expected, _ = brute(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == expected


def test_empty_table(spark):
    assert near_duplicates(nothing(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges, Workspace(spark, "test")).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and got[101] == 100


def test_sketch_bound_is_under_the_expected_agreement():
    s = NearDedup()
    assert s.minima * 0.75 < s.least_bits < s.minima * 0.9

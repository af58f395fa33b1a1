import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pitlake.llm import decontaminate, neighbours, packing, repeats

from .helpers import documents, nothing, prose


def test_contamination_by_exact_shingles(spark):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (8, 30, 60)] + ["", None, "two words"]
    partly = items[1].split()
    partly = " ".join(partly[:27]) + " else"  # 23 of 26 shingles
    less = " ".join(items[2].split()[:40])
    docs = documents(spark, [f"intro {items[0]} outro", items[1].upper(), partly, less, "some two words here", prose(rng, 3000) + " " + items[2]])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    n = docs.count() - 2 - 6
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(n, 0), (n + 1, 1), (n + 2, 1), (n + 4, 5), (n + 5, 2)}
    assert got[(n + 2, 1)].n_shared == 23 and got[(n + 2, 1)].n_item == 26
    in_blocks = decontaminate.Containment(block_bytes=100)  # many blocks, the same result
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench, in_blocks).collect())) == sorted(map(tuple, got.values()))
    assert sorted(map(str, decontaminate.clean(docs, bench, in_blocks).collect())) == sorted(map(str, decontaminate.clean(docs, bench).collect()))
    twice = bench.union(bench.where("item_id in (1, 2)").selectExpr("item_id + 50", "text")).union(bench.where("item_id = 2"))
    for spec in (decontaminate.Containment(), in_blocks):
        rows = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, twice, spec).collect())
        assert rows == sorted([*got, (n + 1, 51), (n + 2, 51), (n + 5, 52), (n + 5, 2)])
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 5
    none = bench.limit(0)
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.contaminated(nothing(spark), bench).count() == 0


def test_every_large_enough_sketch_meets_its_document():
    for size in range(1, 400):
        m = decontaminate.lacking(decontaminate.partition_top(size), 0.8) + 1
        assert min(size, m) > decontaminate.lacking(size, 0.8) or m >= size


def test_neighbours_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 32)).astype(np.float32)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows[7] = (7, rows[100][1])  # a tie at distance 0
    rows[9] = (9, rows[100][1])
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] + [1.0] * 31), (2003, [1.0]), (None, rows[3][1]), (2004, [None] + [1.0] * 31)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df.vec_id % 100 == 0, neighbours.Spec(block=300)).collect()
    hit = 0
    full = np.array([r[1] for r in rows], float)
    for q in range(0, 1200, 100):
        d = np.sqrt(((full - full[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(1200), d)) if i != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(best))
    assert hit >= 0.9 * 120
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r.rank)][:2] == [7, 9]
    assert neighbours.nearest(df.limit(0), df.vec_id % 100 == 0).count() == 0
    few = neighbours.nearest(df.where("vec_id < 5"), df.vec_id % 100 == 0).collect()
    assert len(few) == 4


def test_pigeonhole_retrieves_every_code_in_the_radius():
    bits = np.random.default_rng(1).random((3000, 40)) < 0.5
    index = neighbours.MultiIndex(bits, 8)
    for radius in (5, 12, 17, 40):
        for q in range(20):
            want = np.flatnonzero((bits != bits[q]).sum(1) <= radius)
            assert (index.within(bits[q], radius) == want).all()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = documents(spark, ["tab\there \x85 nbsp\xa0", "<|endoftext|> inside", "日本語 text", "x" * 30000])
    out = packing.pack(docs).toPandas()
    tk = Tokenizer.from_file(packing.vocabulary()[0])
    want = Counter()
    for r in docs.collect():
        ids = [*tk.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        cuts = sorted({0, *range(first, len(ids) + 1, 2048)})
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(str(r.doc_id), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    have = Counter((str(None if r.doc_id != r.doc_id else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert have == want
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.append(0, g.length.cumsum()[:-1])).all()
    assert packing.pack(nothing(spark)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_minimum_bin_slack_uses_every_piece_once_and_fills(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randrange(1, 120) for _ in range(2000))
    plan = packing.minimum_bin_slack(dict(counts), 128)
    used = Counter()
    for times, combination in plan:
        assert sum(n * c for n, c in combination) <= 128
        for n, c in combination:
            used[n] += n and c * times
    assert used == counts
    bins = sum(t for t, _ in plan)
    assert bins <= 1.02 * -(-sum(n * c for n, c in counts.items()) // 128) + 1


def test_fullest_is_a_fullest_combination():
    rng = random.Random(3)
    for _ in range(60):
        counts = dict(Counter(rng.randrange(1, 20) for _ in range(rng.randrange(1, 9))))
        items = [n for n, c in counts.items() for _ in range(c)]
        top = max(items)
        rest = sorted(items)
        rest.remove(top)
        sums = {0}
        for n in rest:
            sums |= {s + n for s in sums if s + n <= 24 - top}
        assert sum(n * c for n, c in packing.fullest(counts, 24)) == top + max(sums)


def brute_repeats(rows, length=200):
    seen = Counter()
    for _, b in rows:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        g = np.cumsum(gone[:-1]) > 0
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if len(g) else 0
        out.append((str(i), len(b), int(g.sum()), spans, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force(spark):
    rng = random.Random(8)
    shared = prose(rng, 60)
    more = [
        prose(rng, 20) + shared + prose(rng, 20), shared[:199], shared[:200] + "é", "x" + shared[50:250] + "y", "ab" * 300, "ü" * 150, "z" * 400,
        shared + shared, prose(rng, 30) + shared[3:280], "q" * 199, shared[:240] + "1" + shared[241:],
    ]
    docs = documents(spark, more)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    for size in (3000, 1 << 20):
        got = repeats.remove_repeats(docs, repeats.Spec(group_bytes=size)).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)
    assert repeats.remove_repeats(nothing(spark)).count() == 0


def test_difference_cover_meets_every_distance():
    d = set(repeats.COVER.tolist())
    for distance in range(repeats.PERIOD):
        assert any((x + distance) % repeats.PERIOD in d for x in d)

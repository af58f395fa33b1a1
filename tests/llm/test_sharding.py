import hashlib
import random
import zlib
from collections import Counter

import pytest

from pitlake.llm import sharding
from pitlake.llm.sharding import Sharding

from .helpers import documents, nothing


def brute(rows, shards=8, whole=20):
    """(doc_id, size, crc, shard, slot) by running sums over records in order of content, doc_id and row."""
    key = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    made = sorted(((key(t), d is not None, d or 0, i, d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, (d, t) in enumerate(rows)), key=lambda r: r[:4])
    total = sum(r[5] for r in made)
    group = Counter()
    for r in made:
        group[r[0]] += r[5]
    out, start, begin, slots = [], 0, {}, Counter()
    for r in made:
        begin.setdefault(r[0], start)
        together = group[r[0]] * shards * whole <= total
        twice = 2 * begin[r[0]] + group[r[0]] if together else 2 * start + r[5]
        s = twice * shards // (2 * total)
        out.append((r[4], r[5], r[6], s, slots[s]))
        slots[s] += 1
        start += r[5]
    return sorted(out, key=str)


def found(df, conf=Sharding()):
    rows = sharding.shard(df, conf).collect()
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows), key=str)


def test_places_equal_those_of_running_sums(spark):
    docs = documents(spark)
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def hot(n=900):
    """A third of the rows are one text, a third are empty, some are long, some repeat with their id."""
    rng = random.Random(6)
    texts = ["the same words again and again"] * (n // 3) + [None, ""] * (n // 6) + ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(0, 80))) for _ in range(n // 3)] + ["z" * 20_000]
    rng.shuffle(texts)
    rows = [(None if rng.random() < 0.05 else i, t) for i, t in enumerate(texts)]
    return rows + rows[:20]


@pytest.mark.parametrize("conf", [Sharding(), Sharding(shards=3, ranges=2, per_range=2), Sharding(ranges=200, per_range=4), Sharding(range_rows=30), Sharding(shards=1)])
def test_splitters_never_decide_the_result(spark, conf):
    docs = spark.createDataFrame(hot(), "doc_id long, text string")
    got = found(docs, conf)
    # Rows that are alike in id and text may change places among each other.
    assert got == brute(hot(), conf.shards, conf.whole)
    bytes_of = Counter()
    for _, size, _, s, _ in got:
        bytes_of[s] += size
    fair = sum(bytes_of.values()) / conf.shards
    assert max(bytes_of.values()) <= max(20_001, fair * 1.05) + 20_001 and set(bytes_of) <= set(range(conf.shards))
    for s in bytes_of:
        slots = [slot for *_, own, slot in got if own == s]
        assert sorted(slots) == list(range(len(slots)))


def test_ranges_stay_bounded_and_hot_keys_are_cut(spark):
    docs = spark.createDataFrame(hot(3000), "doc_id long, text string")
    rows = sharding.records(docs)
    total, count = rows.agg({"size": "sum", "*": "count"}).select("sum(size)", "count(1)").first()
    conf = Sharding(ranges=8)
    bounds, table = sharding.splitters(rows, conf, total, count)
    assert len(bounds) + 1 >= 64 and max(n for _, _, n, _, _ in table) < 4 * count / 64 and sum(n for _, _, n, _, _ in table) == count
    assert len({low for _, _, _, low, high in table if low == high}) < len(table)  # one key fills several ranges


def test_equal_texts_stay_together_where_they_are_few(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdef ") for _ in range(60)) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:200])]
    got = {r.doc_id: r.shard for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == got[400 + i] for i in range(200)) and set(got.values()) == set(range(8))


def test_written_shards_hold_the_documents(spark, tmp_path):
    docs = documents(spark).drop("rank")
    path = str(tmp_path / "shards")
    told = {r.shard: (r.records, r.bytes) for r in sharding.write_shards(docs, path, Sharding(shards=3)).collect()}
    back = spark.read.parquet(path).collect()
    assert sorted((str(r.doc_id), str(r.text), str(r.key)) for r in back) == sorted((str(r.doc_id), str(r.text), str(r.key)) for r in docs.collect())
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()], 3), key=str)
    assert sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in back), key=str) == want
    assert {s: (sum(1 for x in want if x[3] == s), sum(x[1] for x in want if x[3] == s)) for s in told} == told


def test_nothing_and_one(spark):
    assert sharding.shard(nothing(spark)).count() == 0
    one = spark.createDataFrame([(7, None, 1, 2)], "doc_id long, text string, shard int, slot int")
    assert found(one) == [(7, 1, 0, 4, 0)]  # the middle of its byte

import math
import random
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pyarrow as pa

from pitlake.llm import katz, language_id, quality
from pitlake.llm import wordhash as wh

from .helpers import WORDS, crc, documents, lower, nothing


def test_katz_matches_a_direct_model_and_sums_to_one(spark):
    docs = documents(spark)
    got = katz.score_texts(docs, katz.Spec(group_bytes=800)).collect()  # enough buckets for hot contexts
    rows = [(r.doc_id, [*WORDS.findall(lower(r.text or "")), "</s>"]) for r in docs.collect()]
    train = [t for i, t in rows if i is not None and crc(i, 7) != 2]
    c = Counter(w for t in train for w in t)
    n, k = sum(c.values()), 5
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    follow = defaultdict(dict)
    for (h, w), r in pairs.items():
        follow[h][w] = r

    def by_count(x):
        return np.array([0] + [sum(v == r for v in x.values()) for r in range(1, k + 2)])

    d1, d2 = katz.discounts(by_count(c), k), katz.discounts(by_count(pairs), k)
    f = lambda d, r: (d[r] if r <= k else 1.0) * r
    unknown = 1 - sum(f(d1, v) for v in c.values()) / n
    p1 = lambda w: f(d1, c[w]) / n if w in c else unknown

    def p(h, w):
        own = follow.get(h)
        if not own:
            return p1(w)
        total = sum(own.values())
        kept = sum(f(d2, r) for r in own.values())
        total = total if total - kept > 1e-9 * total else total + 1
        return f(d2, own[w]) / total if w in own else (1 - kept / total) / (1 - sum(p1(x) for x in own)) * p1(w)

    for h in ["<s>", *list(follow)[:20]]:
        assert abs(sum(p(h, w) for w in c) + p(h, "\0") - 1) < 1e-9
    want = sorted((str(i), len(t), sum(w in c for w in t), round(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t), 6), round(sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t], t)), 6)) for i, t in rows)
    have = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert have == want and {r.train_tokens for r in got} == {n}


def test_katz_without_rows_or_training(spark):
    assert katz.score_texts(nothing(spark)).count() == 0
    one = spark.createDataFrame([(None, "some words")], "doc_id long, text string")
    r = katz.score_texts(one).first()
    assert r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and r.score == 0.0


def brute_word(pieces, p, w):
    """The logarithm of the sum over all segmentations of a blank and the word, with numbers of any size."""
    w = b" " + w
    x = np.frombuffer(w, np.uint8)
    names = {k: pieces.find(wh.word_hashes(x, np.arange(len(w) - k + 1), np.arange(len(w) - k + 1) + k)) for k in range(1, min(len(w), 129) + 1)}
    a = [Decimal(1)]
    for t in range(1, len(w) + 1):
        a.append(sum((a[t - k] * Decimal(p[names[k][t - k], 0]) for k in range(1, min(t, 129) + 1)), Decimal(0)))
    return float(a[-1].ln())


def test_forward_sums_all_segmentations_of_words_of_any_length():
    pieces = language_id.Pieces(language_id.default_path())
    p = np.append(np.random.default_rng(0).random(pieces.n) / pieces.n, 0)[:, None]
    rng = np.random.default_rng(3)
    words = [b"the", b"a", "été".encode(), b"internationalisation", b"x" * language_id.SHORT, b"y" * (language_id.SHORT + 1), b"telecommunications" * 17, bytes(rng.integers(97, 123, 300).astype(np.uint8)), "北京是中华人民共和国的首都".encode() * 8]
    buf = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    got = language_id.word_log_probabilities(pieces, p, buf, end - [len(w) for w in words], end)[:, 0]
    assert np.allclose(got, [brute_word(pieces, p, w) for w in words], rtol=1e-9)


def test_expected_counts_of_long_words_equal_those_of_whole_lattices():
    pieces = language_id.Pieces(language_id.default_path())
    rng = np.random.default_rng(3)
    p = np.append(rng.dirichlet(np.ones(pieces.n)), 0.0)[:, None]
    words = ["北京是中华人民共和国的首都".encode(), b"internationalisation" * 2, "กรุงเทพมหานคร".encode(), b"a", b"the", bytes(rng.integers(97, 123, 45).astype(np.uint8))]
    buf = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start, count = end - [len(w) for w in words], np.array([2.0, 1.0, 5.0, 7.0, 1.0, 3.0])
    want = language_id.Lattice(pieces, buf, start, end).expected(p, pieces.space, count)
    for cells in (1 << 20, 64):
        assert np.allclose(language_id.long_expected(pieces, p[:, 0], buf, start, end, count, cells), want, rtol=1e-9)
    one = np.frombuffer(b"ab" * 20_000, np.uint8)  # far below the least double
    used = language_id.long_expected(pieces, p[:, 0], one, np.array([0]), np.array([len(one)]), np.array([1.0]))
    assert np.isfinite(used).all() and used.sum() > 5_000
    assert not language_id.long_expected(pieces, p[:, 0], buf, start[:0], end[:0], count[:0]).any()


def test_languages_without_spaces_are_learned(spark):
    """Documents that are one clause of fifty characters each, in three scripts without spaces, and English."""
    rng = random.Random(2)
    letters = {"zh": [chr(c) for c in range(0x4E00, 0x4E60)], "ja": [chr(c) for c in range(0x3042, 0x3092)], "th": [chr(c) for c in range(0x0E01, 0x0E2E)]}
    rows = []
    for i in range(240):
        lang = ["zh", "ja", "th", "en"][i % 4]
        text = " ".join(rng.choice(["the", "house", "of", "cats", "is", "there"]) for _ in range(20)) if lang == "en" else "".join(rng.choice(letters[lang]) for _ in range(50))
        rows.append((i, text, lang))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 50 and all(r.lang_pred == r.lang for r in out)


def test_expected_counts_are_those_of_all_segmentations():
    pieces = language_id.Pieces(language_id.default_path())
    p = np.append(np.random.default_rng(0).random(pieces.n), 0)[:, None]
    buf = np.frombuffer(b"these", np.uint8)
    used = language_id.Lattice(pieces, buf, np.array([0]), np.array([5])).expected(p, pieces.space, np.array([3.0]))
    want, z = Counter(), 0.0
    for cuts in range(1 << 5):  # every way to cut " these"
        at = [0, *(i + 1 for i in range(5) if cuts >> i & 1), 6]
        x = np.frombuffer(b" these", np.uint8)
        ids = [pieces.find(wh.word_hashes(x, np.array([i]), np.array([j])))[0] for i, j in zip(at, at[1:])]
        q = math.prod(p[i, 0] for i in ids)
        z += q
        for i in ids:
            want[i] += 3 * q
    assert all(abs(used[i] - v / z) < 1e-9 for i, v in want.items() if i < pieces.n) and abs(used.sum() - sum(v for i, v in want.items() if i < pieces.n) / z) < 1e-9


def test_a_word_of_a_hundred_thousand_letters_is_scored_whole(spark):
    rows = [(i, t, l) for i in range(0, 40, 2) for t, l in [("the house and the garden", "en")]] + [(i, "das Haus und der Garten", "de") for i in range(1, 40, 2)]
    rows += [(100, "thehouseandthegarden" * 5_000, None), (101, "dashausundderGarten" * 2_000, None)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id >= 100").collect()}
    assert got == {100: "en", 101: "de"}


def test_language_of_held_out_documents_and_awkward_rows(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    docs = documents(spark)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert got[7].lang_pred == got[8].lang_pred == got[9].lang_pred == got[15].lang_pred == "und" and got[8].score == 0
    assert got[0].lang_pred in ("en", "de") and 0 <= got[0].score <= 1 and got[None].held_out is False
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert language_id.identify(nothing(spark)).count() == 0


def test_quality_on_held_out_labels_and_awkward_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    docs = documents(spark)
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, one).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.score_quality(nothing(spark), one).count() == 0


def test_labels_without_documents_do_not_thin_the_sample(spark):
    good, bad = "A good sentence, it is long enough and it ends.", "zz qq zz 99 !! zz"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + f" {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.range(2_000_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = quality.score_quality(docs, labels, quality.Spec(sample=1000)).collect()
    assert len(got) == 40 and all(r.predicted == r.doc_id % 2 for r in got)


def test_features_are_the_distinct_trigrams_and_shapes():
    texts = ["abc abd", "", "Ab", "x" * 5000 + " y"]
    got = list(quality.features(pa.array(texts)))
    for text, f in zip(texts, got):
        b = text.encode()
        tri = {b[i : i + 3] for i in range(len(b) - 2)}
        assert len(set(f.tolist())) == len(f) and sum(x < quality.SIZE // 2 for x in f.tolist()) == len(tri)
        assert (sum(x >= quality.SIZE // 2 for x in f.tolist()) > 0) == bool(text.split())


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    x = [np.unique(rng.integers(0, 40, 6)).astype(np.uint16) for _ in range(200)]
    y = np.where(rng.random(200) < 0.5, 1.0, -1.0)
    ratio = np.zeros(quality.SIZE)
    ratio[:40] = rng.normal(size=40)
    spec = quality.Spec(epochs=400)
    w, b = quality.dual_coordinate_descent(x, y, ratio, spec)
    dense = np.zeros((200, 41))
    for k, i in enumerate(x):
        dense[k, i] = ratio[i]
    dense[:, 40] = 1
    primal = lambda v: 0.5 * v @ v + spec.c * np.maximum(0, 1 - y * (dense @ v)).sum()
    v = np.append(w[:40], b)
    best = primal(v)
    assert all(primal(v + 1e-3 * rng.normal(size=41)) >= best - 1e-9 for _ in range(300))  # convex: no better point nearby


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(300) < 0.5, 1.0, -1.0)
    x = [np.unique(np.append(rng.integers(100, 200, 5), 10 if v > 0 else 20)).astype(np.uint16) for v in y]
    ratio = np.ones(quality.SIZE)
    w, b = quality.dual_coordinate_descent(x, y, ratio, quality.Spec())
    assert np.mean([np.sign(w[i].sum() + b) == v for i, v in zip(x, y)]) == 1.0


def test_squeezed_counts_round_trip():
    v = np.array([0, 1, 254, 255, 256, 65534, 65535, 65536, 10**12, 3])
    assert (katz.unsqueeze(katz.squeeze(v)) == v).all() and len(katz.unsqueeze(katz.squeeze(v[:0]))) == 0
    w = np.array([1, 2**48 - 1, 2**63], np.uint64)
    assert katz.from_six(katz.six_bytes(w)).tolist() == [1, 2**48 - 1, 0]


def brute_quality(rows, labels, spec):
    """Scores of (doc_id, text), learned by loops over sets of features from the labels (doc_id, quality) that count."""
    of = {i: x.tolist() for (i, _), x in zip(rows, quality.features(pa.array([t for _, t in rows], pa.string())))}
    train = [(of[i], k) for i, k in labels if i in of and k in (0, 1) and crc(i, 4) != 2]
    count = {k: Counter(f for x, y in train if y == k for f in x) for k in (0, 1)}
    total = {k: sum(count[k].values()) + quality.SIZE * spec.alpha for k in (0, 1)}
    ratio = lambda f: math.log((count[1][f] + spec.alpha) / total[1]) - math.log((count[0][f] + spec.alpha) / total[0])
    train.sort(key=lambda r: np.array(r[0], np.uint16).tobytes()[:64])
    seen = [r for k, r in enumerate(train) if k % 5]
    kept = [r for k, r in enumerate(train) if k % 5 == 0]
    w, bias, a = defaultdict(float), 0.0, [0.0] * len(seen)
    rng = np.random.default_rng(5)
    for _ in range(spec.epochs):
        for k in rng.permutation(len(seen)):
            x, y = seen[k][0], 1 if seen[k][1] else -1
            norm = sum(ratio(f) ** 2 for f in x) + 1
            g = y * (sum(w[f] * ratio(f) for f in x) + bias) - 1
            new = min(max(a[k] - g / norm, 0.0), spec.c)
            for f in x:
                w[f] += (new - a[k]) * y * ratio(f)
            bias += (new - a[k]) * y
            a[k] = new
    mean = sum(abs(v) for v in w.values()) / quality.SIZE
    margin = lambda x: sum(ratio(f) * ((1 - spec.beta) * mean + spec.beta * w[f]) for f in x) + bias
    slope, offset = quality.logistic(np.array([margin(x) for x, _ in kept]), np.array([1.0 if y else -1.0 for _, y in kept]))
    return {i: 1 / (1 + math.exp(-(slope * margin(x) + offset))) for i, x in of.items()}


def test_quality_equals_a_plain_model(spark):
    rng = random.Random(9)
    word = lambda good: "".join(rng.choice("abcde" if good else "defgh") for _ in range(rng.randrange(2, 6)))
    rows = [(i, " ".join(word(i % 2 == 0 if rng.random() < 0.8 else i % 2) for _ in range(rng.randrange(3, 12)))) for i in range(90)] + [(90, ""), (91, None), (92, "ZZ 99")]
    labels = [(i, 1 - i % 2 if rng.random() < 0.9 else i % 2) for i in range(70)] + [(5, 1), (5, 0), (7, None), (8, 3), (500, 1)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, label string, picked int")
    marked = spark.createDataFrame([(i, k, "b", 2) for i, k in labels], "doc_id long, quality int, text string, n int")
    spec = quality.Spec()
    got = {r.doc_id: r for r in quality.score_quality(docs, marked, spec).collect()}
    want = brute_quality(rows, labels, spec)
    assert got.keys() == want.keys() and len({round(v, 3) for v in want.values()}) > 50
    for i, v in want.items():
        assert abs(got[i].score - v) < 1e-9 and got[i].predicted == (v >= 0.7) and got[i].held_out == (crc(i, 4) == 2)
    few = quality.score_quality(docs, marked, quality.Spec(features=600)).collect()  # a part of the documents
    assert len(few) == 93 and all(0 <= r.score <= 1 for r in few)

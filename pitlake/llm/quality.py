"""Quality classifier (operator 5): naive Bayes support vectors.

Features are n-gram indicators: byte trigrams and bigrams of word shapes, hashed to ``SIZE`` buckets.
Each is scaled by the log ratio of its smoothed counts in the two classes, taken over all labelled
training documents; a linear hinge-loss model is then fitted by dual coordinate descent on at most
about ``sample`` of them, drawn by a hash of doc_id, and at most about ``features`` of their features, drawn by a hash of a
document's features, in one task of bounded size. The margin becomes a
probability by a logistic curve fitted on a fifth of the sample that the weights have not seen.

Byte trigrams beat word 1- and 2-grams here (README), so words take part by their shapes alone. A very
long text has at most ``SIZE`` features; its bytes are read in one array.

Only text is an input. Defined results: null and empty texts have no feature and score by the bias
alone; a null doc_id is not held out and never learned from; null labels are ignored; a document with
several labels counts once for each; labels without a document are ignored; without labels of both classes every score is the share of label
1 (0.5 without any label); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .workspace import Workspace

SIZE = 1 << 16


@dataclass(frozen=True)
class Spec:
    """sample: labelled documents of the fit; features: of all these documents together; c: cost of a violation; beta: weight of the fit against its mean; threshold: of label 1."""

    sample: int = 16000
    features: int = 100_000_000
    epochs: int = 10
    c: float = 0.1
    alpha: float = 1.0
    beta: float = 0.5
    threshold: float = 0.7


_KIND = np.arange(256, dtype=np.uint64)
_KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x61:0x7B], _KIND[0x80:] = 0x41, 0x30, 0x61, 0x61
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: pa.Array) -> Iterator[np.ndarray]:
    """The distinct feature buckets of each text."""
    for lo, hi, buf, offs in wh.slices(text):
        b = buf.astype(np.uint64)
        tri = ((b[:-2] * _A + b[1:-1] * _B + b[2:] * _C) >> np.uint64(49)).astype(np.uint16) if len(b) > 2 else np.zeros(0, np.uint16)
        start, end, first = wh.words(buf, offs)
        kind = _KIND[buf]
        if len(start):
            size = np.minimum(end - start, 15).astype(np.uint64) // np.uint64(3)
            shape = wh.mix(((kind[start] * _A + kind[np.minimum(start + 1, end - 1)]) * _B + kind[end - 1]) * _C + kind[np.maximum(end - 2, start)] * np.uint64(31) + size)
            two = wh.mix(shape[:-1] * _A + shape[1:])
        for d in range(hi - lo):
            a, z = offs[d], offs[d + 1]
            f, g = first[d], first[d + 1]
            own = [tri[a : max(a, z - 2)]]
            if g > f:
                own += [(shape[f:g] >> np.uint64(49)).astype(np.uint16) | np.uint16(1 << 15), (two[f : g - 1] >> np.uint64(49)).astype(np.uint16) | np.uint16(1 << 15)]
            x = np.concatenate(own)
            if len(x) > 4096:
                mark = np.zeros(SIZE, bool)
                mark[x] = True
                yield np.flatnonzero(mark).astype(np.uint16)
            else:
                yield np.unique(x)


def _labelled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part the class counts of every feature; and the features of each document of the sample."""
    counts, n = np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64)
    for batch in rows:
        label, picked = batch.column(1).to_numpy(), batch.column(2).to_pylist()
        out = []
        for k, x in enumerate(features(batch.column(0))):
            counts[label[k], x] += 1
            n[label[k]] += 1
            if picked[k]:
                out.append((int(label[k]), x.tobytes()))
        if out:
            y, x = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.binary())], ["label", "x"])
    if n.sum():
        for k in (0, 1):
            yield _counted(-1 - k, np.append(counts[k], n[k]))


def _counted(label: int, c: np.ndarray) -> pa.RecordBatch:
    """Counts as places and values of what is not 0: small parts have few."""
    at = np.flatnonzero(c)
    return pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([at.astype(np.int32).tobytes() + c[at].tobytes()], pa.binary())], ["label", "x"])


def _spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for label, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            n = len(x.as_py()) // 12
            at, count = np.frombuffer(x.as_py()[: 4 * n], np.int32), np.frombuffer(x.as_py()[4 * n :], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, label, np.int32)), pa.array(at), pa.array(count)], ["label", "feature", "n"])


def dual_coordinate_descent(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, spec: Spec) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear hinge-loss fit of scaled indicators (the bias is a feature of value 1)."""
    w, bias = np.zeros(SIZE), 0.0
    a = np.zeros(len(x))
    norm = np.array([(ratio[i] ** 2).sum() + 1 for i in x])
    rng = np.random.default_rng(5)
    for _ in range(spec.epochs):
        for k in rng.permutation(len(x)):
            i = x[k]
            v = ratio[i]
            g = y[k] * (w[i] @ v + bias) - 1
            new = min(max(a[k] - g / norm[k], 0.0), spec.c)
            if new != a[k]:
                step = (new - a[k]) * y[k]
                w[i] += step * v
                bias += step
                a[k] = new
    return w, bias


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([m, np.ones_like(m)], 1)
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, z.T @ (p - t))
        c -= np.clip(d, -2, 2)
        if np.abs(d).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


def _fit(counts: dict[int, np.ndarray], spec: Spec):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort([x.as_buffer().to_pybytes()[:64] for x in rows.column("x")], kind="stable")  # any fixed order
        x = [np.frombuffer(rows.column("x")[int(i)].as_buffer(), np.uint16) for i in order]
        y = np.where(rows.column("label").to_numpy()[order] > 0, 1.0, -1.0)
        p, q = (spec.alpha + counts[k][:-1] for k in (-2, -1))
        ratio = np.log((p / p.sum()) / (q / q.sum()))
        seen = np.arange(len(x)) % 5 > 0
        w, b = dual_coordinate_descent([x[i] for i in np.flatnonzero(seen)], y[seen], ratio, spec)
        w = ratio * ((1 - spec.beta) * np.abs(w).mean() + spec.beta * w)
        margin = np.array([w[i].sum() + b for i in x])
        slope, offset = logistic(margin[~seen], y[~seen])
        return pa.table({"w": pa.array([(np.append(w, [b]) * slope + np.append(np.zeros(SIZE), [offset])).tobytes()], pa.binary())})

    return run


def held_out(docs: DataFrame):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, spec: Spec = Spec()) -> np.ndarray:
    """Weights of the features and, last, the bias, on the scale of log odds."""
    ws = Workspace(docs.sparkSession, "quality")
    marked = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    marked = marked.where(~held_out(marked))
    # Labels that have a document: ids alone are joined to count them.
    n = docs.select("doc_id").join(marked.select("doc_id").hint("merge"), "doc_id").count()
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, spec.sample / max(n, 1)) * (1 << 20))
    # The hint keeps the same plan at every size.
    text = docs.where("doc_id is not null").where(~held_out(docs)).select("doc_id", "text").join(marked.hint("merge"), "doc_id").select("text", "label", picked.alias("picked"))
    found = ws.save(text.mapInArrow(_labelled, "label int, x binary"))
    # Sums over parts by feature: a number for each class and bucket comes back, whatever the number of parts.
    sums = found.where("label < 0").mapInArrow(_spread, "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts = {-1: np.zeros(SIZE + 1, np.int64), -2: np.zeros(SIZE + 1, np.int64)}
    for label, own in sums.groupby("label"):
        counts[int(label)][own["feature"].to_numpy()] = own["n"].to_numpy()
    none, one = counts[-1][-1], counts[-2][-1]
    if not none or not one:
        return np.append(np.zeros(SIZE), [np.log((one + 1e-3) / (none + 1e-3))])
    fit = found.where("label >= 0")
    # Two bytes a feature.
    total = (fit.agg(F.sum(F.octet_length("x"))).first()[0] or 0) / 2
    fit = fit.where(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < int(min(1.0, spec.features / max(total, 1)) * (1 << 20)))
    fitted = fit.groupBy(F.lit(0).alias("k")).applyInArrow(_fit(counts, spec), "w binary")
    w = np.frombuffer(bytes(fitted.first()["w"]), np.float64)
    ws.drop(found)
    return w


def score_quality(docs: DataFrame, labels: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            z = np.array([w[x].sum() for x in features(batch.column(2))]) + w[-1]
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= spec.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(docs).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

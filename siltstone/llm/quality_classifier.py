"""Quality classifier: a support vector machine over naive Bayes features.

Features are indicators of hashed n-grams: byte trigrams of the text and runs of one to three word
shapes (case, edge characters, whether the word repeats its predecessor). Each indicator is scaled
by its class log-count ratio and each document to unit length; a linear hinge-loss model is fitted
by dual coordinate descent and pulled towards its mean weight as in the published method. A
logistic curve turns margins into scores, fitted on sample rows that the machine did not see.

Definitions: labels are read from training rows only; a document labelled twice counts with each
label; null labels count as absent. Null and empty texts have no n-gram and get the score of a
zero vector. Without any label of one class every score is the share of label 1 (0.5 without
labels). Labels of documents that aren't there have no effect; ids and labels may be of any number
type. Rows are independent.

Scale: class counts cover all labelled training rows and are sums over DIM buckets. The machine is
fitted on at most ``SAMPLE`` documents of each class and ``SAMPLE_FEATURES`` features, the first by a hash of their id. Scoring is one
narrow pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W
from siltstone.llm.arrow import map_slices
from siltstone.llm.language_id import fold
from siltstone.runtime import materialise, table

GRAM_BITS = 16
DIM = 2 << GRAM_BITS
#: Labelled rows of each class that the machine is fitted on, at most.
SAMPLE = 3000
#: Features of each class's sample at most, which bounds what the driver holds (4 bytes each, 12 while it fits).
SAMPLE_FEATURES = 1 << 23
COST, ROUNDS, BETA, SMOOTH = 1.0, 30, 0.5, 1.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CLASS = np.full(256, 3, np.uint32)
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 0
_CLASS[128:] = 0
for _c in b".,;:'\"()-":
    _CLASS[_c] = 4


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, ascending, and offsets of the texts."""
    w = W.split(texts, False)
    data, at = w.data, w.text_at
    keys = []
    if len(data) > 2:
        d = data.astype(np.uint32)
        code = d[:-2] | (d[1:-1] << np.uint32(8)) | (d[2:] << np.uint32(16))
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:-2]
        ok = np.arange(len(code)) + 3 <= at[doc + 1]
        f = (code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
        keys.append((doc[ok].astype(np.int64) << 20) | f[ok])
    if len(w.start):
        h, doc = w.hashes(), w.doc()
        up = np.concatenate(([0], np.cumsum(_UPPER[data])))
        size = w.end - w.start
        loud = (up[w.end] - up[w.start]) * 2 > size
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        shape = _CLASS[data[w.start]] | (_CLASS[data[w.end - 1]] << np.uint32(3)) | (loud.astype(np.uint32) << np.uint32(6)) | (again.astype(np.uint32) << np.uint32(7)) | (np.minimum(size, 15).astype(np.uint32) // 4 << np.uint32(8))
        for k in (1, 2, 3):
            n = len(shape) - k + 1
            if n <= 0:
                break
            code = np.full(n, k, np.uint32)
            for j in range(k):
                code = code * np.uint32(1 << 10) + shape[j : j + n] + np.uint32(1)
                code ^= code >> np.uint32(7)
            ok = doc[:n] == doc[k - 1 :]
            f = ((code * np.uint32(2246822519)) >> np.uint32(32 - GRAM_BITS)) + np.uint32(1 << GRAM_BITS)
            keys.append((doc[:n][ok] << 20) | f[ok])
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return (key & ((1 << 20) - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(at)) << 20)


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of class 0 and 1 that show each feature, and the number of documents of each class."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        f, ptr = features(b["text"])
        y = b["y"].to_numpy(zero_copy_only=False)
        of = np.repeat(y, np.diff(ptr)).astype(np.int64)
        key, n = np.unique(np.concatenate((of * (DIM + 1) + f, y * (DIM + 1) + DIM)), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["k", "n"])

    rows = map_slices(labelled.select("text", F.col("y").cast("long").alias("y")), "text", "k long, n long", kernel).groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * (DIM + 1))
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    out = out.reshape(2, DIM + 1)
    return out[:, :DIM], out[:, DIM]


def dual_descent(idx: list[np.ndarray], val: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dim: int, rounds: int = ROUNDS) -> np.ndarray:
    """Linear hinge-loss machine: coordinate steps on the dual, in a fixed random order. Last weight: bias."""
    w, alpha = np.zeros(dim + 1), np.zeros(len(y))
    q = np.array([float(v @ v) + 1.0 for v in val])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (w[idx[i]] @ val[i] + w[dim]) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[idx[i]] += step * val[i]
                w[dim] += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def _curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton steps with soft targets."""
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([np.sum((p - t) * m) + 1e-3 * a, np.sum(p - t)])
        s = p * (1 - p) + 1e-9
        h = np.array([[np.sum(s * m * m) + 1e-3, np.sum(s * m)], [np.sum(s * m), np.sum(s) + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return max(float(a), 1e-3), float(b)


def within(sample: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of each class in the order of their ids' hashes, as long as their features stay within ``most`` a class.

    The driver sees the sizes (one number a row) before it asks for any features.
    """
    most, cut = SAMPLE_FEATURES if most is None else most, F.lit(False)
    sizes = sample.select(F.xxhash64("doc_id").alias("h"), "y", F.size("f").cast("long").alias("n")).toArrow().sort_by([("h", "ascending"), ("n", "ascending")])
    for y in (0, 1):
        own = sizes.filter(pc.equal(sizes["y"], y))
        if own.num_rows:
            k = max(1, int(np.searchsorted(np.cumsum(own["n"].to_numpy()), most, "right")))
            cut = cut | ((F.col("y") == y) & (F.xxhash64("doc_id") <= own["h"][min(k, own.num_rows) - 1].as_py()))
    return sample.filter(cut)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> dict:
    """The model: ``weight`` (scaled by the ratios), ``bias``, ``slope`` and ``offset`` of the curve."""
    kind = dict(docs.dtypes)[doc_id]
    known = labels.filter(F.col(label).cast("double").isin(0.0, 1.0)).select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(label).cast("int").alias("y")).hint("merge")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Always merged: the labels grow with the documents, so neither side may be broadcast.
    seen, total = class_counts(texts.join(known, "doc_id"))
    if not total.all():
        share = float(total[1] / total.sum()) if total.sum() else 0.5
        return {"weight": np.zeros(DIM, np.float32), "bias": 0.0, "slope": 0.0, "offset": float(np.log(share + 1e-6) - np.log(1 - share + 1e-6)) if total.sum() else 0.0}
    p, q = SMOOTH + seen[1], SMOOTH + seen[0]
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    # Chosen among the rows that are there: labels may be of documents that aren't.
    there = texts.select("doc_id").join(known, "doc_id").distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = there.filter("y = 0").orderBy(*order).limit(SAMPLE).unionByName(there.filter("y = 1").orderBy(*order).limit(SAMPLE))

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        f, ptr = features(b["text"])
        return pa.RecordBatch.from_arrays([b["doc_id"], b["y"], pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(f))], names=["doc_id", "y", "f"])

    # At most 2 * SAMPLE ids, hence the hint; of rows with one id the sample takes the smallest text.
    chosen = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = materialise(map_slices(chosen, "text", f"doc_id {kind}, y int, f array<int>", make), "sample")
    sample = within(sample).orderBy("doc_id", "y").toArrow()
    y = np.where(sample["y"].to_numpy() > 0, 1.0, -1.0)
    f = sample["f"].combine_chunks()
    flat, ptr = f.values.to_numpy(), f.offsets.to_numpy()
    idx = [flat[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    val = [(lambda v: v / max(np.sqrt(v @ v), 1e-9))(ratio[i]) for i in idx]
    probe = np.arange(len(y)) % 4 == 3

    def fit(rows: np.ndarray) -> np.ndarray:
        rows = np.flatnonzero(rows)
        each = np.array([np.sum(y[rows] == s) for s in (-1.0, 1.0)])
        cost = COST * len(rows) / (2 * np.maximum(each, 1))[((y[rows] + 1) / 2).astype(int)]
        w = dual_descent([idx[i] for i in rows], [val[i] for i in rows], y[rows], cost, DIM)
        mean = np.abs(w[:DIM]).mean()
        w[:DIM] = (1 - BETA) * mean + BETA * w[:DIM]
        return w

    w = fit(~probe) if (y[~probe] > 0).any() and (y[~probe] < 0).any() else fit(np.ones(len(y), bool))
    margin = np.array([w[i] @ v + w[DIM] for i, v in zip(idx, val, strict=True)])
    use = probe if (y[probe] > 0).any() and (y[probe] < 0).any() else np.ones(len(y), bool)
    slope, offset = _curve(margin[use], y[use])
    return {"weight": (w[:DIM] * ratio).astype(np.float32), "square": (ratio * ratio).astype(np.float32), "bias": float(w[DIM]), "slope": slope, "offset": offset}


def score(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), threshold: float = THRESHOLD, with_text: bool = False) -> DataFrame:
    """(doc_id, score, predicted) of every document, the columns in ``keep``, and on request the text as ``_text``."""
    gone = () if with_text else ("_text",)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        f, ptr = features(b["_text"])
        total, norm = np.zeros(b.num_rows), np.ones(b.num_rows)
        some = np.flatnonzero(np.diff(ptr) > 0)
        if len(some) and m["slope"]:
            total[some] = np.add.reduceat(m["weight"][f].astype(np.float64), ptr[:-1][some])
            norm[some] = np.sqrt(np.add.reduceat(m["square"][f].astype(np.float64), ptr[:-1][some]))
        z = m["slope"] * (total / np.maximum(norm, 1e-9) + m["bias"]) + m["offset"]
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c not in gone), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*(c for c in b.schema.names if c not in gone), "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c not in gone)
    return map_slices(rows, "_text", f"{fields}, score double, predicted int", kernel)


def _train_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.coalesce(fold("doc_id", FOLDS), F.lit(0)) != HELD_OUT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(_train_rows(docs), table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("held_out", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = train(_train_rows(docs), table(spark, sf_dir, "labels"))
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*rest).alias("_doc"))
    out = score(rows, model, keep=("_doc",), with_text=True).filter("predicted = 1")
    return out.select(*((F.col("_text") if c == "text" else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))

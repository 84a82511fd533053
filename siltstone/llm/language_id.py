"""Language identification by multilingual mixture inference.

Each language is a multinomial over hashed byte trigrams of its words (with their edges). A
document is a mixture of languages with its words as draws: expectation-maximisation estimates the
proportions from the words' n-gram likelihoods, first over all languages, then over the nested
sets of the k likeliest for k = 1, 2, ... as long as the penalised likelihood grows (the penalty is
``PENALTY`` times k - 1 times half the log of the number of words + 1). The predicted language has the largest
proportion in it, and that proportion is the score.

Definitions: words are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A text
that is null or has no letter is ``und`` with score 0, so is every text if there is nothing to
learn from. Equal proportions: the first language in code point order. Rows are independent
whatever shares their partition, repeated rows get equal results.

Scale: training sums counts over a fixed number of buckets per language (every training row
counts), the model has BUCKETS numbers per learned language (26 MB for a hundred), which the driver
holds; ``lang`` is taken to name languages, of which there are hundreds at most. Prediction is one narrow pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W
from siltstone.llm.arrow import map_slices
from siltstone.runtime import table

BUCKETS = 1 << 16
SMOOTH = 0.5
ROUNDS = 12
PENALTY = 3.0
FOLDS, HELD_OUT = 3, 1

LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True


def trigrams(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram of every word (each with a blank before and after), and word offsets."""
    size = w.end - w.start
    ptr = np.concatenate(([0], np.cumsum(size)))
    mid = np.arange(ptr[-1]) - np.repeat(ptr[:-1] - w.start, size)
    d = w.data
    here = d[mid].astype(np.uint32)
    before = np.empty_like(here)
    after = np.empty_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[ptr[:-1]], after[ptr[1:] - 1] = 32, 32
    code = before | (here << np.uint32(8)) | (after << np.uint32(16))
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1), ptr


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in code point order and log probabilities, one row per bucket."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch | None:
        w = W.split(b["text"], True, LETTERS)
        code, ptr = trigrams(w)
        if not len(code):
            return None
        labels = b["lang"].dictionary_encode()
        of = np.repeat(labels.indices.to_numpy()[w.doc()], np.diff(ptr)).astype(np.int64)
        key, count = np.unique(of * BUCKETS + code, return_counts=True)
        return pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(key // BUCKETS)), pa.array((key % BUCKETS).astype(np.int32)), pa.array(count.astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = map_slices(rows, "text", "lang string, bucket int, n long", kernel).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()), key=lambda x: x.encode())
    out = np.full((BUCKETS, len(langs)), 0.0)
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        out[counts["bucket"].to_numpy(), [place[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
        seen = max(1, int((out.sum(1) > 0).sum()))
        total = out.sum(0)
        out = np.log((out + SMOOTH) / (total + SMOOTH * (seen + 1)))
    return langs, out.astype(np.float32)


def mixture(ll: np.ndarray, ptr: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of every document (zero outside the chosen set), and the size of the set.

    ``ll`` is the log-likelihood of each word under each language; every document has a word.
    """
    near = np.maximum(ll - ll.max(1, keepdims=True), -60.0)
    lik = np.exp(near)
    # One language alone needs no EM: its likelihood is a sum.
    alone = np.add.reduceat(near.astype(np.float64), ptr[:-1], axis=0)
    first = np.argmax(alone, axis=1)
    k, every = ll.shape[1], np.arange(len(first))
    best = np.zeros((len(first), k), np.float32)
    best[every, first] = 1
    best_ll, size = alone[every, first].copy(), np.ones(len(first), int)
    pi = np.full((len(first), k), 1.0 / k, np.float32)
    pi, full_ll, gain = _fit(lik, ptr, pi, rounds)
    # No set does better than all languages together at their best: where even that bound doesn't make
    # up for the smallest penalty, one language it is. Each document has its own bound.
    n = np.diff(ptr)
    open_ = np.flatnonzero(full_ll + gain - penalty * np.log(n + 1) / 2 > best_ll)
    rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1)
    # Sets grow as long as their document's penalised likelihood does.
    for s in range(2, k + 1):
        if not len(open_):
            break
        words = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in open_.tolist()])
        own = np.concatenate(([0], np.cumsum(n[open_])))
        pi, value, _ = _fit(lik[words], own, np.where(rank[open_] < s, 1.0 / s, 0.0).astype(np.float32), rounds)
        value = value - penalty * (s - 1) * np.log(n[open_] + 1) / 2
        better = value > best_ll[open_]
        open_ = open_[better]
        best[open_], best_ll[open_], size[open_] = pi[better], value[better], s
    return best, size


def _fit(lik: np.ndarray, ptr: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation of the proportions of all documents at once: proportions, log-likelihoods, and
    how much more any proportions can reach.

    With g_j the mean over the words of l_j / sum(pi l), other proportions p gain
    sum(log(sum(p l) / sum(pi l))) <= n log(sum(p g)) <= n log(max g).
    """
    n = np.diff(ptr)
    doc = np.repeat(np.arange(len(n)), n)
    for _ in range(rounds):
        r = lik * pi[doc]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        pi = np.add.reduceat(r, ptr[:-1], axis=0) / n[:, None]
    total = np.maximum((lik * pi[doc]).sum(1), 1e-30)
    g = np.add.reduceat((lik / total[:, None]).astype(np.float64), ptr[:-1], axis=0) / n[:, None]
    return pi.astype(np.float32), np.add.reduceat(np.log(total.astype(np.float64)), ptr[:-1]), n * np.log(np.maximum(1.0, g.max(1)))


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, n_langs, mixture) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        names, table_ = shared.value
        w = W.split(b["text"], True, LETTERS)
        pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
        size, mix = np.zeros(b.num_rows, np.int32), [""] * b.num_rows
        if len(w.start) and names:
            code, ptr = trigrams(w)
            ll = np.add.reduceat(table_[code], ptr[:-1], axis=0)
            some = np.flatnonzero(w.n > 0)
            pi, k = mixture(ll, np.append(w.ptr[:-1][some], w.ptr[-1]))
            at = np.argmax(pi, axis=1)
            score[some], size[some] = np.minimum(1.0, pi[np.arange(len(some)), at]), k
            for i, j, row in zip(some.tolist(), at.tolist(), pi, strict=True):
                pred[i] = names[j]
                mix[i] = ",".join(f"{names[x]}:{row[x]:.3f}" for x in np.argsort(-row, kind="stable") if row[x] > 0.0005)
            ascii_letter = np.zeros(256, bool)
            ascii_letter[0x61:0x7B] = True
            seen = np.concatenate(([0], np.cumsum(ascii_letter[w.data])))
            for i in some[seen[w.text_at[some + 1]] == seen[w.text_at[some]]].tolist():
                if not any(map(str.isalpha, b["text"][i].as_py())):
                    pred[i], score[i], size[i], mix[i] = "und", 0.0, 0, ""
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(pred, pa.string()), pa.array(score), pa.array(size), pa.array(mix, pa.string())], names=["doc_id", "lang_pred", "score", "n_langs", "mixture"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_slices(rows, "text", f"doc_id {kind}, lang_pred string, score double, n_langs int, mixture string", kernel)


def fold(doc_id: str, folds: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = train(docs.filter(F.coalesce(fold("doc_id", FOLDS), F.lit(0)) != HELD_OUT))
    out = predict(docs.select("doc_id", "text"), langs, model)
    return out.withColumn("held_out", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)))

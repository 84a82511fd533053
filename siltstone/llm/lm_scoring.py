"""Language-model scoring with a gated recurrent network in numpy.

The output softmax is factored into classes. The ``HEAD`` most frequent training words are binned
by frequency into classes and have a softmax within their class; all other words fall into classes
by their last two bytes, and within such a class a word has its add-one share of the class's
training counts, with one more share for every unseen word. So each word of any text has a
probability, and all counts cover all training documents.

The network is trained by truncated backpropagation (windows of ``STEPS`` words, state carried on
to the end of the document, whatever its length) on every training document once, in ``ROUNDS``.
A round takes a fixed share of the rows by their hash: every task trains a copy of the network on
its rows, and the copies are averaged by their words into the next round's network. In rounds of few
rows a task takes several partitions.
There is no sample: what is trained on grows with the input, repeated rows included.
Scoring carries the state across windows in the same way.

Definitions: words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; one end token
follows; null texts are empty. Training rows of the query are those whose crc32(doc_id as text)
mod 7 is not 2 (null ids train). Rows are scored independently, repeated rows equally (told by two 64-bit hashes of their symbols). With no
training rows every word is unseen.

Scale: counts are summed by word after map-side counting. At most ``TOP`` of the most frequent
words travel as a dictionary; each other word of a document is sent once, with its number, to meet
its count in a merge join. No such word is frequent in training; one that is frequent only in rows
that are scored makes a skewed partition, which adaptive execution splits. Texts are read twice, to count and to encode; training and scoring
read symbols of two bytes. A copy of the network leaves its task as numbers that are summed by
their place, exactly, so the driver gets one network however many partitions there are.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrow import map_slices, slices
from siltstone.llm.language_id import fold
from siltstone.runtime import materialise, release, table

FOLDS, HELD_OUT = 7, 2
TOP, HEAD = 1 << 17, 1500
HEAD_CLASSES, TAIL_CLASSES = 24, 40
HIDDEN, EMBED, STEPS = 16, 12, 16
#: Documents are dealt over so many lines, which advance together; fewer where that leaves under ``LEAST`` windows.
LINES, LEAST = 512, 48
#: Symbols that a task trains on or scores at once.
CHUNK = 1 << 23
#: Each round's share of the rows, in parts of ``SHARES``, and its rate.
SHARES, ROUNDS = 32, ((1, 0.02), (1, 0.02), (2, 0.015), (4, 0.01), (8, 0.01), (16, 0.005))
#: Rounds of fewer shares than this go to fewer tasks, so that a copy's lines don't run out but for its longest document.
FULL = 8
SLICE = 8 << 20
DISTINCT = 1 << 19
PAD = (1 << 16) - 1
#: Places whose class shares are made at once, so that they stay in a core's cache.
ROWS = 2048
#: Logits beyond this are shifted before they are exponentiated.
SAFE = 60.0
#: Weights are averaged as multiples of this.
GRAIN = 2.0**-30


def texts_of(b: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [(x or b"").lower() for x in b[column].cast(pa.binary()).to_pylist()]


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over the texts; the end token is the empty word. A task counts until it holds ``DISTINCT`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def take() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])
            c.clear()
            return out

        for b in batches:
            for part in slices(b, "text"):
                for t in texts_of(part):
                    c.update(t.split())
                c[b""] += part.num_rows
                if len(c) > DISTINCT:
                    yield take()
        if c:
            yield take()

    return train.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the most frequent words.

    The cut comes from a histogram over steps of a sixteenth of a doubling, and inside the step that
    it falls into from one over hash ranges: tables of fixed size. So no task sends more than
    its share of the result, as it would for an ordered limit.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 16))
    whole, cut, kept = 1 << 30, None, 0
    for s, n in sorted(((r.s, r.n) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if kept + n > most:
            cut = s
            break
        kept, whole = kept + n, s
    chosen = step >= whole
    if cut is not None:
        first = 0
        for k, n in sorted((r.k, r.n) for r in counts.filter(step == cut).groupBy(part.alias("k")).agg(F.count("*").alias("n")).collect()):
            if kept + n > most:
                break
            kept, first = kept + n, k + 1
        chosen = chosen | ((step == cut) & (part < first))
    return counts.filter(chosen)


def suffix(words: list[bytes]) -> np.ndarray:
    """The last two bytes of each word as a number."""
    return np.fromiter((x[-1] | (x[-2] << 8 if len(x) > 1 else 0) for x in words), np.int64, len(words))


class Vocabulary:
    """The dictionary, the classes, and the counts that probabilities need."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tail: dict[int, tuple[int, int]], total: int, distinct: int):
        """``words`` by falling count; ``tail``: suffix -> (tokens, distinct words) of all words."""
        if b"" not in words[:HEAD]:
            keep = [i for i, x in enumerate(words) if x != b""]
            place = next((i for i, x in enumerate(words) if x == b""), None)
            order = [*keep[: HEAD - 1], *([place] if place is not None else []), *keep[HEAD - 1 :]]
            words, counts = [words[i] for i in order], counts[order]
            if place is None:
                words, counts = [b"", *words], np.concatenate(([0], counts))
        self.total, self.distinct = total, distinct
        self.counts = counts.astype(np.float64)
        self.index = {x: i for i, x in enumerate(words)}
        self.head = h = min(HEAD, len(words))
        mass = np.sqrt(self.counts[:h] + 1)
        word_class = np.minimum((np.cumsum(mass) - mass) / mass.sum() * HEAD_CLASSES, HEAD_CLASSES - 1).astype(np.int32)
        # Counts of the words beyond the head, by suffix.
        left = {k: list(v) for k, v in tail.items()}
        for x, c in zip(words[:h], counts[:h].tolist(), strict=True):
            if x:
                left[int(suffix([x])[0])][0] -= c
                left[int(suffix([x])[0])][1] -= 1
        most = sorted((k for k in left if left[k][0] > 0), key=lambda k: (-left[k][0], k))[: TAIL_CLASSES - 1]
        self.suffix_class = np.full(1 << 16, TAIL_CLASSES - 1, np.int32)
        self.suffix_class[most] = np.arange(len(most))
        tail_mass, size = np.zeros(TAIL_CLASSES), np.ones(TAIL_CLASSES)
        for k, (n, v) in left.items():
            tail_mass[self.suffix_class[k]] += n
            size[self.suffix_class[k]] += n + v
        self.tail_size = np.log(size)
        tail_index = suffix(words[h:]) if len(words) > h else np.zeros(0, np.int64)
        #: Symbol of each dictionary word: head words are their own symbol.
        self.symbol = np.concatenate((np.arange(h), h + self.suffix_class[tail_index])).astype(np.int32)
        self.symbols = h + TAIL_CLASSES
        #: Class of each symbol, first head word of each class, and the classes' shares of the training words.
        self.class_of = np.concatenate((word_class, HEAD_CLASSES + np.arange(TAIL_CLASSES))).astype(np.uint8)
        self.first = np.searchsorted(word_class, np.arange(HEAD_CLASSES + 1))
        share = np.concatenate((np.bincount(word_class, self.counts[:h] + 1, HEAD_CLASSES), tail_mass + 1))
        # A class that no word is in has no share; its logit must stay finite.
        self.class_log = np.log(np.maximum(share / share.sum(), 1e-12))
        self.log_count = np.log(self.counts + 1)
        self.end = self.index[b""]

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Symbols of the words and the end, dictionary places (-1: none), and the words without one."""
        words = text.split()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        at = np.append(at, np.int32(self.end))
        symbols = self.symbol[at]
        miss = np.flatnonzero(at < 0)
        rest = [words[i] for i in miss.tolist()]
        if rest:
            symbols[miss] = self.head + self.suffix_class[suffix(rest)]
        return symbols.astype(np.uint16), at, rest


class Network:
    """Embedding, gated recurrent cell and the factored softmax."""

    def __init__(self, v: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        h, e = HIDDEN, EMBED
        bias = v.log_count[: v.head].astype(np.float32)
        for lo, hi in zip(v.first[:-1], v.first[1:], strict=True):
            if hi > lo:
                bias[lo:hi] -= bias[lo:hi].max()
        self.p = {
            "e": normal(v.symbols, e, scale=0.3), "w": normal(e, 3 * h, scale=0.3), "u": normal(h, 3 * h, scale=h**-0.5),
            "b": np.repeat(np.array([1, 0, 0], np.float32), h),
            "wc": normal(h, HEAD_CLASSES + TAIL_CLASSES, scale=0.05), "bc": v.class_log.astype(np.float32),
            "wo": normal(v.head, h, scale=0.05), "bo": bias,
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def copy(self, flat: np.ndarray | None = None) -> Network:
        """A network of the same shape with its own weights, or those of ``flat``."""
        out, flat = object.__new__(Network), self.flat() if flat is None else flat
        cuts = np.cumsum([x.size for x in self.p.values()])[:-1]
        out.p = {k: w.reshape(x.shape).astype(np.float32) for (k, x), w in zip(self.p.items(), np.split(flat, cuts), strict=True)}
        return out

    def run(self, symbols: np.ndarray, h: np.ndarray, end: int, keep: bool = False):
        """States after each step of (steps, lines) symbols, and what backpropagation needs. An end symbol starts a document.

        Inside, a step's lines come last, so that every gate is one block of memory.
        """
        p, n = self.p, HIDDEN
        steps, lines = symbols.shape
        # The two gates of the logistic curve get their logits negated.
        sign = np.repeat(np.array([-1, -1, 1], np.float32), n)
        embedded = np.take(p["e"], symbols, 0)
        x = np.matmul((p["w"] * sign).T, embedded.transpose(0, 2, 1))
        x += (p["b"] * sign)[:, None]
        u = np.ascontiguousarray((p["u"] * sign).T)
        live = (symbols != end).astype(np.float32)
        kept = steps if keep else 1
        out, before = np.empty((steps, n, lines), np.float32), np.empty((kept, n, lines), np.float32)
        made, d = np.empty((kept, 3 * n, lines), np.float32), np.empty((kept, n, lines), np.float32)
        h, c = h.T, np.empty((n, lines), np.float32)
        for t in range(steps):
            i = t if keep else 0
            b, g, gates, state = before[i], made[i], x[t], out[t]
            np.multiply(h, live[t], out=b)
            np.matmul(u, b, out=g)
            zr, new = gates[: 2 * n], gates[2 * n :]
            zr += g[: 2 * n]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[n:], g[2 * n :], out=c)
            new += c
            np.tanh(new, out=new)
            np.subtract(b, new, out=d[i])
            np.multiply(d[i], zr[:n], out=state)
            state += new
            h = state
        return out.transpose(0, 2, 1), (symbols, embedded, live, before, x, made[:, 2 * n :], d)

    def output(self, s: np.ndarray, target: np.ndarray, v: Vocabulary, grad: dict | None = None):
        """Log-probabilities of target symbols given states; head words within their class, tail symbols by class.

        Places are sorted by target, hence by class. A logit's derivative is its share less one at the
        target: shares pass through products, and the ones through sums of states by target.
        """
        p, n = self.p, HIDDEN
        order = np.argsort(target.astype(np.uint16), kind="stable")
        target = target[order].astype(np.intp)
        own = np.empty((len(s), n + 1), np.float32)
        own[:, :n], own[:, n] = np.take(s, order, 0), 1
        # Biases are weights of a last input that is 1.
        wc, wo = np.concatenate((p["wc"].T, p["bc"][:, None]), 1), np.concatenate((p["wo"], p["bo"][:, None]), 1)
        size = np.diff(v.first)
        # A word that is alone in its class has all of its share.
        several = np.repeat(size > 1, size)
        logit = wc[v.class_of]
        logit[: v.head][several] += wo[several]
        at = np.take(logit, target, 0)
        logp, ds = np.einsum("ij,ij->i", own, at), None if grad is None else -at[:, :n]

        def shares(i: int, j: int, w: np.ndarray, shift: bool) -> np.ndarray | None:
            part = own[i:j]
            a = part @ w.T
            if shift:
                most = a.max(1)
                a -= most[:, None]
                logp[i:j] -= most
            np.exp(a, out=a)
            total = a @ np.ones(len(w), np.float32)
            logp[i:j] -= np.log(total)
            if grad is None:
                return None
            np.reciprocal(total, out=total)
            down = a @ w[:, :n]
            down *= total[:, None]
            ds[i:j] += down
            return a.T @ (part * total[:, None])

        # States lie between -1 and 1, so weights bound the logits.
        shift = np.abs(wc).sum(1).max() > SAFE
        by_class = [shares(i, min(i + ROWS, len(s)), wc, shift) for i in range(0, len(s), ROWS)]
        shift, words = np.abs(wo).sum(1).max() > SAFE, np.zeros_like(wo)
        cut = np.searchsorted(target, v.first).tolist()
        for i, j, lo, hi in zip(cut[:-1], cut[1:], v.first[:-1].tolist(), v.first[1:].tolist(), strict=True):
            if i < j and hi - lo > 1:
                expected = shares(i, j, wo[lo:hi], shift)
                if grad is not None:
                    words[lo:hi] = expected
        out = np.empty_like(logp)
        out[order] = logp
        if grad is None:
            return out, None
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        seen, one = np.add.reduceat(own, first, axis=0), target[first]
        head = one < v.head
        words[one[head]] -= seen[head]
        words[: v.head][~several] = 0
        cls = v.class_of[one]
        first = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
        classes = sum(by_class[1:], by_class[0])
        classes[cls[first]] -= np.add.reduceat(seen, first, axis=0)
        grad["wc"], grad["bc"], grad["wo"], grad["bo"] = classes[:, :n].T, classes[:, n], words[:, :n], words[:, n]
        full = np.empty_like(ds)
        full[order] = ds
        return out, full

    def backward(self, made: tuple, ds: np.ndarray, grad: dict) -> None:
        """Gradients of the cell and the embedding, given those of the states.

        All of a step's gradients are multiples of its state's: their factors are made for the whole window.
        """
        p, n = self.p, HIDDEN
        symbols, embedded, live, before, x, gc, d = made
        z, r, c = x[:, :n], x[:, n : 2 * n], x[:, 2 * n :]
        steps, lines = symbols.shape
        # Candidate, both gates, and the candidate's share of the state before.
        f = np.empty((steps, 4, n, lines), np.float32)
        np.multiply(c, c, out=f[:, 0])
        np.subtract(1, f[:, 0], out=f[:, 0])
        rest = 1 - z
        f[:, 0] *= rest
        np.multiply(rest, z, out=f[:, 1])
        f[:, 1] *= d
        np.multiply(f[:, 0], r, out=f[:, 3])
        np.subtract(1, r, out=rest)
        rest *= gc
        np.multiply(f[:, 3], rest, out=f[:, 2])
        flat = f.reshape(steps, 4 * n, lines)
        ds = np.ascontiguousarray(ds.transpose(0, 2, 1))
        dh, back, u = np.zeros((n, lines), np.float32), np.empty((n, lines), np.float32), p["u"]
        for t in range(steps - 1, -1, -1):
            dh += ds[t]
            f[t] *= dh
            np.matmul(u, flat[t, n:], out=back)
            dh *= z[t]
            dh += back
            dh *= live[t]
        dx, own = flat[:, : 3 * n].transpose(0, 2, 1), np.r_[n : 3 * n, :n]
        grad["u"] = np.matmul(before, flat[:, n:].transpose(0, 2, 1)).sum(0)
        grad["w"] = np.matmul(embedded.transpose(0, 2, 1), dx).sum(0)[:, own]
        grad["b"] = flat[:, : 3 * n].sum(2).sum(0)[own]
        de, one = np.matmul(dx, np.roll(p["w"], n, 1).T).reshape(-1, EMBED), symbols.ravel().astype(np.uint16)
        order = np.argsort(one, kind="stable")
        one = one[order]
        first = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1])))
        grad["e"] = (one[first], np.add.reduceat(np.take(de, order, 0), first, axis=0))


class Adam:
    """Steps along the mean gradient of so many words."""

    def __init__(self, net: Network):
        self.net = net
        self.m = {k: np.zeros_like(x) for k, x in net.p.items()}
        self.s2 = {k: np.zeros_like(x) for k, x in net.p.items()}

    def step(self, grad: dict, words: int, rate: float) -> None:
        for k, g in grad.items():
            rows, g = g if isinstance(g, tuple) else (None, g)
            w, m, s = (x[k] if rows is None else x[k][rows] for x in (self.net.p, self.m, self.s2))
            g = g * np.float32(8 / words)
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.01)
            s *= np.float32(0.99)
            s += g
            np.sqrt(s, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= np.float32(rate)
            w -= g
            if rows is not None:
                self.net.p[k][rows], self.m[k][rows], self.s2[k][rows] = w, m, s


def pack(docs: list[np.ndarray], end: int, lines: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Documents dealt over lines: a (steps + 1, lines) grid that starts with end symbols, the lines' lengths, and which documents follow each other in a line.

    Longest documents go first, each into the shortest line; lines are in order of falling length.
    """
    n = min(lines, len(docs))
    heap, own = [(0, j) for j in range(n)], [[] for _ in range(n)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        length, j = heapq.heappop(heap)
        own[j].append(i)
        heapq.heappush(heap, (length + len(docs[i]), j))
    own.sort(key=lambda x: -sum(len(docs[i]) for i in x))
    size = np.array([sum(len(docs[i]) for i in x) for x in own])
    grid = np.full((size[0] + 1, n), PAD, np.uint16)
    grid[0] = end
    for j, x in enumerate(own):
        grid[1 : size[j] + 1, j] = np.concatenate([docs[i] for i in x])
    return grid, size, own


def windows(grid: np.ndarray, size: np.ndarray, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(first step, lines that still run, inputs, targets, places with a target or None for all) of window after window.

    Where few lines are left, windows are longer.
    """
    a = 0
    while a < size[0]:
        live = int(np.searchsorted(-size, -a, "left"))
        z = min(a + STEPS * min(16, max(1, grid.shape[1] // (2 * live))), int(size[0]))
        inputs, target = grid[a:z, :live].astype(np.int32), grid[a + 1 : z + 1, :live].ravel()
        some = None
        if size[live - 1] < z:
            inputs[inputs == PAD] = end
            some = np.flatnonzero(target != PAD)
        yield a, live, inputs, target, some
        a = z


def chunks(docs: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Documents in lists of about ``CHUNK`` symbols."""
    out, n = [], 0
    for d in docs:
        out.append(d)
        n += len(d)
        if n >= CHUNK:
            yield out
            out, n = [], 0
    if out:
        yield out


def train_on(docs: Iterator[np.ndarray], net: Network, v: Vocabulary, rate: float) -> int:
    """Train ``net`` once on every symbol sequence; the number of symbols. Windows with few words take shorter steps."""
    adam, words, step = Adam(net), 0, 0
    for part in chunks(docs):
        lines = max(8, min(LINES, sum(map(len, part)) // (STEPS * LEAST)))
        grid, size, _ = pack(part, v.end, lines)
        h = np.zeros((grid.shape[1], HIDDEN), np.float32)
        for _, live, inputs, target, some in windows(grid, size, v.end):
            states, made = net.run(inputs, h[:live], v.end, True)
            h = states[-1].copy()
            flat, grad = states.reshape(-1, HIDDEN), {}
            if some is None:
                n, ds = len(target), net.output(flat, target, v, grad)[1]
            else:
                n, ds = len(some), np.zeros_like(flat)
                ds[some] = net.output(flat[some], target[some], v, grad)[1]
            net.backward(made, ds.reshape(states.shape), grad)
            words, step = words + n, step + 1
            adam.step(grad, n, rate * min(1.0, step / 20) * min(1.0, n / (grid.shape[1] * STEPS)))
    return words


def score_documents(docs: list[np.ndarray], net: Network, v: Vocabulary) -> np.ndarray:
    """Natural log-probability of each symbol sequence (the end included), tail symbols by class only."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    grid, size, own = pack(docs, v.end, LINES)
    logp = np.zeros(grid.shape, np.float32)
    h = np.zeros((grid.shape[1], HIDDEN), np.float32)
    for a, live, inputs, target, some in windows(grid, size, v.end):
        states, _ = net.run(inputs, h[:live], v.end)
        h = states[-1].copy()
        flat, x = states.reshape(-1, HIDDEN), np.zeros(target.size, np.float32)
        at = slice(None) if some is None else some
        x[at] = net.output(flat[at], target[at], v)[0]
        logp[a : a + len(inputs), :live] = x.reshape(inputs.shape)
    for j, line in enumerate(own):
        start = np.concatenate(([0], np.cumsum([len(docs[i]) for i in line])))[:-1]
        out[line] = np.add.reduceat(logp[: size[j], j].astype(np.float64), start)
    return out


def _symbols(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in b["symbols"].to_pylist()]


def train_all(encoded: DataFrame, v: Vocabulary, vocabulary) -> tuple[Network, int]:
    """The network after all rounds over the rows of (symbols), and the number of words it was trained on."""
    spark, net, words = encoded.sparkSession, Network(v), 0
    share, lo = F.pmod(F.xxhash64(F.lit(3), "symbols"), F.lit(SHARES)), 0
    partitions = encoded.rdd.getNumPartitions()
    for parts, rate in ROUNDS:
        start = spark.sparkContext.broadcast(net)

        def train(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            net = start.value.copy()
            n = train_on((d for b in batches for d in _symbols(b)), net, vocabulary.value, rate)
            if n:
                w = np.rint(net.flat().astype(np.float64) / GRAIN).astype(np.int64)
                # w * n in two halves whose sums stay within 64 bits; place -1 carries n.
                hi, lo = (w >> 32) * n, (w & 0xFFFFFFFF) * n
                hi, lo = hi + (lo >> 32), lo & 0xFFFFFFFF
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(w), dtype=np.int32)), pa.array(np.append(0, hi)), pa.array(np.append(n, lo))], names=["i", "hi", "lo"])

        rows = encoded.filter((share >= lo) & (share < lo + parts)).select("symbols")
        if parts < FULL:
            rows = rows.coalesce(max(1, -(-partitions * parts // FULL)))
        # Sums of whole numbers: the order in which copies arrive doesn't show.
        made = rows.mapInArrow(train, "i int, hi long, lo long").groupBy("i").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).toArrow().sort_by("i")
        if made.num_rows:
            n = made["lo"][0].as_py()
            net, words = net.copy((made["hi"].to_numpy()[1:] * 2.0**32 + made["lo"].to_numpy()[1:]) / n * GRAIN), words + n
        start.unpersist()
        lo += parts
    return net, words


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """From (word, c); the driver gets the dictionary, of at most ``TOP`` words, and one row per suffix."""
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = frequent(counts, TOP).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    last = F.conv(F.hex(F.substring(F.encode("word", "UTF-8"), -2, 2)), 16, 10).cast("int")
    tail = counts.filter("word <> ''").groupBy(last.alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    by = {s: (n, d) for s, n, d in zip(*(tail[c].to_pylist() for c in ("s", "n", "v")), strict=True)}
    return Vocabulary([x.encode() for x in top["word"].to_pylist()], top["c"].to_numpy(), by, int(sums["n"] or 0), int(sums["v"]))


def encode(rows: DataFrame, vocabulary) -> DataFrame:
    """The columns of ``rows`` but ``_text``, with symbols, number of words, what the dictionary adds to
    the two scores, and the words beyond the dictionary, each once with its number."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary.value
        symbols, base, fixed, rest, times, n, missed = [], [], [], [], [], [], []
        for t in texts_of(b, "_text"):
            s, at, words = v.encode(t)
            own = Counter(words)
            symbols.append(s.tobytes())
            rest.append(list(own))
            times.append(list(own.values()))
            n.append(len(s))
            missed.append(len(words))
            base.append(v.log_count[at[at >= 0]].sum())
            tail = s >= v.head
            fixed.append(v.log_count[at[tail & (at >= 0)]].sum() - v.tail_size[s[tail].astype(np.int64) - v.head].sum())
        names = [c for c in b.schema.names if c != "_text"]
        cols = [pa.array(symbols, pa.binary()), pa.array(n, pa.int64()), pa.array(missed, pa.int64()), pa.array(base, pa.float64()), pa.array(fixed, pa.float64())]
        lists = [pa.array(rest, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*(b[c] for c in names), *cols, *lists], names=[*names, "symbols", "n_tokens", "missed", "base", "fixed", "rest", "times"])

    fields = "".join(f"`{c}` {x}, " for c, x in rows.dtypes if c != "_text")
    return map_slices(rows, "_text", f"{fields}symbols binary, n_tokens long, missed long, base double, fixed double, rest array<string>, times array<int>", kernel, SLICE)


def lm_score(docs: DataFrame, learn: Column | DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document, and the columns in ``keep``.

    ``learn`` tells which rows of ``docs`` train the model (null: not), or is a table of its own; by default all train.
    """
    spark = docs.sparkSession
    other = isinstance(learn, DataFrame)
    flag = F.lit(False) if other else F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    train = learn.select(F.col(text).alias("text")) if other else docs.filter(flag).select(F.col(text).alias("text"))
    counts = materialise(count_words(train), "counts")
    v = vocabulary_of(counts)
    vocabulary = spark.sparkContext.broadcast(v)
    key = ["_k", "_l"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, flag.alias("_learn"), F.col(text).alias("_text"))
    encoded = materialise(encode(rows, vocabulary).withColumn("_row", F.monotonically_increasing_id()).withColumns({"_k": F.xxhash64("symbols"), "_l": F.xxhash64(F.lit(3), "symbols")}), "encoded")
    taught = materialise(encode(train.withColumnRenamed("text", "_text"), vocabulary).select("symbols"), "taught") if other else encoded.filter("_learn")
    net, _ = train_all(taught.select("symbols"), v, vocabulary)
    release(taught)
    network = spark.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = vocabulary.value, network.value
        for part in _gather(batches):
            own = score_documents([d for b in part for d in _symbols(b)], net, v)
            yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([b[c] for b in part]) for c in key), pa.array(own)], names=[*key, "own"])

    # Products round by where a line stands, so equal rows take one of their scores.
    scored = encoded.select(*key, "symbols").mapInArrow(score, "_k long, _l long, own double").groupBy(*key).agg(F.min("own").alias("own"))
    own = encoded.select("_row", *key).join(scored.hint("merge"), key).select("_row", "own")
    words = encoded.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("_row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    rare = words.join(counts.hint("merge"), "word").groupBy("_row").agg(F.sum(F.col("times") * F.log(F.col("c") + 1.0)).alias("rare"), F.sum("times").alias("known"))
    out = encoded.drop("symbols", "rest", "times", *key).join(own, "_row", "left").join(rare, "_row", "left")
    ten = float(np.log(10.0))
    extra = F.coalesce("rare", F.lit(0.0))
    # c > 0 for every word of the dictionary, except an end token that was never seen.
    known = F.col("n_tokens") - F.col("missed") + F.coalesce("known", F.lit(0)) - F.lit(0 if v.counts[v.end] > 0 else 1)
    return out.select(
        "doc_id", *keep, "n_tokens", known.cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        ((F.col("base") + extra) / ten - F.col("n_tokens") * float(np.log10(v.total + v.distinct + 1))).alias("base_score"),
        ((F.col("own") + F.col("fixed") + extra) / ten).alias("score"),
    )


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about ``CHUNK`` symbols."""
    out, n = [], 0
    for b in batches:
        out.append(b)
        n += b["symbols"].nbytes // 2
        if n >= CHUNK:
            yield out
            out, n = [], 0
    if out:
        yield out


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return lm_score(docs, ~held).withColumn("held_out", held)

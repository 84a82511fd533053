"""Exact substring deduplication over word windows.

Every run of ``k`` consecutive words of a text is a window with a Rabin-Karp hash. A window whose
word sequence also starts in a document with a smaller id is repeated; overlapping repeated windows
of a document merge into maximal removal intervals, and the words inside them go.

Which windows can repeat is found first: two equal windows have the same smallest hash among their
runs of ``k // 2`` words, so only the windows whose smallest hash occurs in two documents are
grouped by their own hash. Nothing is lost, and most windows are never shuffled.

Definitions: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null texts and texts under ``k`` words keep
everything. Ids are integers; a null id counts as larger than every other. Rows with equal id and
text are each treated alike, and one's windows don't remove the other's. Two windows are equal if
both their own hash and their smallest inner one are, each of 64 bits; a text is told from another
of the same id by 64 bits.

Scale: a slice of a partition keeps one row per hash and thus per group of copies, so a hash has at
most as many rows as there are slices, however hot it is; which hashes repeat is a streaming
aggregate. A line that many texts embed in their own words is the smallest hash of many different windows: beyond
``CROWD`` texts, windows are grouped by their own hash. The rows of a repeated hash are reduced in ``SALTS`` groups of slices first, then those groups'
rows: no group holds more than a sixty-fourth of the slices, or one row per group. The texts are shuffled once, by id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W
from siltstone.llm.arrow import map_slices, slices
from siltstone.runtime import table

K = 50
LAST = (1 << 63) - 1
#: Bytes of text that are grouped before anything is sent.
SLICE = 8 << 20
_SALT = np.uint64(0xA0761D6478BD642F)
#: Groups of slices that are reduced on their own before all of them meet.
SALTS = 64
#: Texts that may show a smallest hash before its windows are told apart by their own.
CROWD = 200
#: Neighbouring windows of one smallest hash (``hs``: their own hashes), one window and its other places in the
#: text (``more``), or an interval of ``gone`` words.
RUN = "m long, id long, th long, pos int, gone int, hs array<long>, more array<int>"


def _run_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each ``n`` neighbours."""
    out, span = x, 1
    while span * 2 <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < n:
        out = np.minimum(out[: len(x) - n + 1], out[n - span : n - span + len(x) - n + 1])
    return out


def _pieces(batch: pa.RecordBatch):
    """Word hashes of a slice, made in pieces that fit the caches."""
    hs, ptrs, base = [], [np.zeros(1, np.int64)], 0
    for part in slices(batch, "text"):
        w = W.split(part["text"], False)
        hs.append(w.hashes())
        ptrs.append(w.ptr[1:] + base)
        base += w.ptr[-1]
    return (np.concatenate(hs) if hs else np.zeros(0, W.U64)), np.concatenate(ptrs)


def _keys(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest inner hash of each window, the window's first word, and its text."""
    half = max(1, k // 2)
    small, at = W.windows(h, ptr, half)
    n = np.maximum(np.diff(ptr) - half + 1, 0)
    inner = np.concatenate(([0], np.cumsum(n)))
    wide = k - half + 1
    if len(small) < wide:
        return np.zeros(0, W.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _run_min(small, wide)
    doc = np.repeat(np.arange(len(n)), n)
    ok = doc[: len(low)] == doc[wide - 1 :]
    i = np.flatnonzero(ok)
    return low[i], at[i], doc[i]


def _first_keys(k: int):
    """One row per smallest hash of a slice: the ids of the texts that show it."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch | None:
        h, ptr = _pieces(b)
        low, _, doc = _keys(h, ptr, k)
        if not len(low):
            return None
        ids = b["id"].to_numpy()[doc]
        change = np.ones(len(low), bool)
        change[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        low, ids = low[change], ids[change]
        order = np.lexsort((ids, low))
        low, ids = low[order], ids[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (ids[1:] != ids[:-1])
        low, ids = low[new], ids[new]
        head = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(W.signed(low[head])), pa.ListArray.from_arrays(pa.array(np.append(head, len(low)).astype(np.int32)), pa.array(ids))], names=["m", "ids"])

    return kernel


def _candidates(k: int):
    """Of the texts whose smallest hashes repeat: runs of windows to compare, and intervals already known to go."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch | None:
        h, ptr = _pieces(b)
        low, at, doc = _keys(h, ptr, k)
        lists = b["ms"]
        sizes = np.diff(lists.offsets.to_numpy())
        ms, of = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), sizes)
        # Look each window's (text, smallest hash) up among the repeated ones of its text.
        _, code = np.unique(np.concatenate((ms, W.signed(low))), return_inverse=True)
        wanted = np.unique(of * (len(code) + 1) + code[: len(ms)])
        mine = doc * (len(code) + 1) + code[len(ms) :]
        place = np.minimum(np.searchsorted(wanted, mine), max(0, len(wanted) - 1))
        ok = wanted[place] == mine if len(wanted) else np.zeros(len(mine), bool)
        low, at, doc = low[ok], at[ok], doc[ok]
        if not len(at):
            return None
        full, every = W.windows(h, ptr, k)
        h1 = full[np.searchsorted(every, at)]
        # Windows of a crowded smallest hash go under a key of their own, equal ones under the same.
        crowd = np.isin(W.signed(low), b["crowded"].flatten().to_numpy())
        low = np.where(crowd, W.mix(low ^ (h1 * _SALT)), low)
        # A crowded window goes on once a document, at its first place; the other places ride along.
        again = np.zeros(len(low), bool)
        places: dict[int, list[int]] = {}
        c = np.flatnonzero(crowd)
        if len(c):
            order = c[np.lexsort((at[c], low[c], doc[c]))]
            same = np.concatenate(([False], (low[order][1:] == low[order][:-1]) & (doc[order][1:] == doc[order][:-1])))
            again[order] = same
            first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            for i, p in zip(first[same].tolist(), (at - ptr[doc])[order][same].tolist(), strict=True):
                places.setdefault(i, []).append(p)
        more = [places.get(i) for i in np.flatnonzero(~again).tolist()] if places else None
        low, h1, at, doc, crowd = low[~again], h1[~again], at[~again], doc[~again], crowd[~again]
        ids, pos = b["id"].to_numpy()[doc], at - ptr[doc]
        order = np.lexsort((ids, h1, low))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (low[order][1:] != low[order][:-1])
        lowest = np.empty(len(h1), np.int64)
        lowest[order] = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))]
        later = ids > lowest
        # Windows are still in the order of texts and positions. Those of the smallest id go on as
        # runs with one smallest hash; those of later ids are gone already and merge to intervals.
        rows = []
        c = np.flatnonzero(~later)
        if len(c):
            head = np.ones(len(c), bool)
            head[1:] = (doc[c][1:] != doc[c][:-1]) | (pos[c][1:] != pos[c][:-1] + 1) | (low[c][1:] != low[c][:-1]) | crowd[c][1:] | crowd[c][:-1]
            s = np.flatnonzero(head)
            rest = pa.array([more[i] or [] for i in c[s].tolist()] if more else [[]] * len(s), pa.list_(pa.int32()))
            rows.append((W.signed(low[c][s]), doc[c][s], pos[c][s], np.zeros(len(s), np.int64), pa.ListArray.from_arrays(pa.array(np.append(s, len(c)).astype(np.int32)), pa.array(W.signed(h1[c]))), rest))
        g = np.flatnonzero(later)
        if len(g):
            d, p = doc[g], pos[g]
            if more:
                extra = [(d[i], x) for i, j in enumerate(g.tolist()) for x in more[j] or ()]
                if extra:
                    d, p = (np.concatenate((a, np.array(z, np.int64))) for a, z in zip((d, p), zip(*extra, strict=True), strict=True))
                    order = np.lexsort((p, d))
                    d, p = d[order], p[order]
            head = np.ones(len(d), bool)
            head[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + k)
            s = np.flatnonzero(head)
            e = np.append(s[1:], len(d)) - 1
            size, d, p = p[e] - p[s] + k, d[s], p[s]
            key = W.mix(b["id"].to_numpy()[d].view(W.U64) * _SALT + p.astype(W.U64))
            rows.append((W.signed(key), d, p, size, pa.array([[]] * len(s), pa.list_(pa.int64())), pa.array([[]] * len(s), pa.list_(pa.int32()))))
        m, doc, pos, gone = (np.concatenate([r[i] for r in rows]) for i in range(4))
        take = pa.array(doc)
        s = int(W.mix(b["id"].to_numpy()[:1].view(W.U64) ^ _SALT)[0] % np.uint64(SALTS))
        return pa.RecordBatch.from_arrays([pa.array(m), b["id"].take(take), b["th"].take(take), pa.array(pos.astype(np.int32)), pa.array(gone.astype(np.int32)), pa.concat_arrays([r[4] for r in rows]), pa.concat_arrays([r[5] for r in rows]), pa.array(np.full(len(m), s, np.int32))], names=["m", "id", "th", "pos", "gone", "hs", "more", "s"])

    return kernel


def _repeated(k: int, last: bool):
    """Runs arrive sorted by their key. Windows that start in a smaller id of the group too become intervals.

    At last all intervals come out. Before, what is left of the runs goes on with them in the same form.
    """

    def decide(t: pa.Table) -> pa.RecordBatch | None:
        known = t["gone"].to_numpy() > 0
        lists = t["hs"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        run = np.repeat(np.arange(t.num_rows), size)
        h, m, ids = lists.flatten().to_numpy(), t["m"].to_numpy()[run], t["id"].to_numpy()[run]
        first = np.concatenate(([0], np.cumsum(size)))[:-1]
        order = np.lexsort((ids, h, m))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (m[order][1:] != m[order][:-1])
        off = np.zeros(len(h), bool)
        off[order] = ids[order] > ids[order][np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else False
        pos, j = t["pos"].to_numpy(), np.flatnonzero(known)

        def stretches(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            # Run, first place and number of neighbouring windows.
            w = np.flatnonzero(which)
            head = np.ones(len(w), bool)
            head[1:] = (run[w][1:] != run[w][:-1]) | (w[1:] != w[:-1] + 1)
            s = np.flatnonzero(head)
            return run[w[s]], w[s], np.diff(np.append(s, len(w)))

        i, at, n = stretches(off)
        lost, begin, long = i, pos[i] + at - first[i], n + k - 1
        others = t["more"].combine_chunks()
        count = np.diff(others.offsets.to_numpy())
        if count.any():
            # A row with other places is one window: they share its verdict.
            x = i[count[i] > 0]
            which = np.repeat(x, count[x])
            start = others.offsets.to_numpy()[x]
            within = np.arange(len(which)) - np.repeat(np.concatenate(([0], np.cumsum(count[x])[:-1])), count[x]) if len(x) else np.zeros(0, int)
            lost, begin, long = np.concatenate((lost, which)), np.concatenate((begin, others.values.to_numpy()[np.repeat(start, count[x]) + within])), np.concatenate((long, np.full(len(which), k)))
        rows, starts, sizes = np.concatenate((lost, j)), np.concatenate((begin, pos[j])), np.concatenate((long, t["gone"].to_numpy()[j]))
        if last:
            if not len(rows):
                return None
            take = pa.array(rows)
            return pa.RecordBatch.from_arrays([*(t[c].take(take).combine_chunks() for c in ("id", "th")), pa.array(starts.astype(np.int32)), pa.array(sizes.astype(np.int32))], names=["id", "th", "pos", "size"])
        # Intervals go on under keys of their own, so that none of them is hot.
        own = W.signed(W.mix(t["id"].to_numpy()[lost].view(W.U64) * _SALT + begin.astype(W.U64)))
        stay, at, n = stretches(~off)
        keys = np.concatenate((own, t["m"].to_numpy()[j], t["m"].to_numpy()[stay]))
        rows = np.concatenate((rows, stay))
        if not len(rows):
            return None
        take = pa.array(rows)
        ends = np.concatenate((np.zeros(len(rows) - len(stay), np.int64), np.cumsum(n)))
        hs = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(h[~off]))
        starts = np.concatenate((starts, pos[stay] + at - first[stay])).astype(np.int32)
        sizes = np.concatenate((sizes, np.zeros(len(stay), np.int64))).astype(np.int32)
        none = pa.array([[]] * (len(rows) - len(stay)), pa.list_(pa.int32()))
        rest = pa.concat_arrays([none, others.take(pa.array(stay))])
        return pa.RecordBatch.from_arrays([pa.array(keys), *(t[c].take(take).combine_chunks() for c in ("id", "th")), pa.array(starts), pa.array(sizes), hs, rest], names=["m", "id", "th", "pos", "gone", "hs", "more"])

    def run(batches):
        wait: list[pa.RecordBatch] = []
        for b in batches:
            wait.append(b)
            m = b["m"].to_numpy()
            if len(m) and m[0] != m[-1]:
                cut = int(np.searchsorted(m, m[-1]))
                done = pa.Table.from_batches([*wait[:-1], b.slice(0, cut)])
                wait = [b.slice(cut)]
                out = decide(done)
                if out is not None:
                    yield out
        if wait:
            out = decide(pa.Table.from_batches(wait))
            if out is not None:
                yield out

    return run


def _covered(n: int, spans) -> np.ndarray:
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, [s["pos"] for s in spans], 1)
    np.add.at(mark, [s["pos"] + s["size"] for s in spans], -1)
    return np.cumsum(mark[:-1]) > 0


def _apply(digest: bool):
    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        w = W.split(b["text"], False)
        raw = w.data.tobytes()
        spans, keys = b["spans"].to_pylist(), b["th"].to_pylist()
        n = w.n
        gone, kept, cuts = np.zeros(b.num_rows, np.int64), [], []
        for i in range(b.num_rows):
            lo, hi = w.ptr[i], w.ptr[i + 1]
            starts, ends = w.start[lo:hi], w.end[lo:hi]
            own = [x for x in spans[i] or () if x["th"] == keys[i]]
            off = _covered(hi - lo, own) if own else None
            if off is not None:
                gone[i] = off.sum()
            if digest:
                on = range(hi - lo) if off is None else np.flatnonzero(~off).tolist()
                s, e = starts.tolist(), ends.tolist()
                kept.append(hashlib.sha256(b" ".join([raw[s[j] : e[j]] for j in on])).hexdigest())
                cuts.append([])
                continue
            a, z = w.text_at[i], w.text_at[i + 1]
            if off is None:
                kept.append(raw[a:z].decode())
                cuts.append([])
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], off.astype(np.int8), [0]))))
            cut = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
            parts, at = [], a
            for x, y in cut:  # the gap after a removed interval goes with it
                parts.append(raw[at : starts[x]])
                at = starts[y] if y < hi - lo else z
            parts.append(raw[at:z])
            kept.append(b"".join(parts).decode())
            cuts.append([{"first": x, "n": y - x} for x, y in cut])
        cols = [b[c] for c in b.schema.names if c not in ("text", "spans", "th")]
        names = [c for c in b.schema.names if c not in ("text", "spans", "th")]
        if digest:
            return pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(gone), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_sha256"])
        cut_type = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
        return pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(gone), pa.array(kept, pa.string()), pa.array(cuts, cut_type)], names=[*names, "n_words", "n_removed", "kept", "removed"])

    return kernel


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K, digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with n_words and n_removed, and

    * ``kept`` (the text without the removed words and the gaps after them) and ``removed`` (the
      maximal intervals: first word and number of words), or
    * with ``digest`` only ``kept_sha256``, over the kept words joined by single blanks.
    """
    kind = dict(docs.dtypes)[doc_id]
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(t).alias("th"), t.alias("text"), *keep)
    keys = map_slices(texts.select("id", "text"), "text", "m long, ids array<long>", _first_keys(k), SLICE)
    # A smallest hash matters if two documents show it; equal ids don't compare. One exchange serves both
    # reads: with the filters that a join and an explode bring along, they are the same plan.
    keys = keys.filter("m IS NOT NULL AND ids IS NOT NULL AND size(ids) > 0").repartition("m")
    shown = keys.groupBy("m").agg(F.min(F.array_min("ids")).alias("a"), F.max(F.array_max("ids")).alias("b"), F.sum(F.size("ids")).alias("n")).filter("a < b")
    shown = shown.select("m", (F.col("n") > CROWD).alias("crowded"))
    lists = keys.join(shown.hint("merge"), "m").select("m", "crowded", F.explode("ids").alias("id"))
    lists = lists.groupBy("id").agg(F.collect_set("m").alias("ms"), F.collect_set(F.when(F.col("crowded"), F.col("m"))).alias("crowded"))
    # The kept columns ride along here, so that both joins read one and the same exchange.
    runs = map_slices(texts.join(lists.hint("merge"), "id").select("id", "th", "text", *keep, "ms", "crowded"), "text", f"{RUN}, s int", _candidates(k), SLICE)
    # In two rounds, so that a hot hash never has the rows of all slices in one group.
    some = runs.repartition("m", "s").sortWithinPartitions("m").drop("s").mapInArrow(_repeated(k, False), RUN)
    spans = some.repartition("m").sortWithinPartitions("m").mapInArrow(_repeated(k, True), "id long, th long, pos int, size int")
    found = spans.groupBy("id").agg(F.collect_set(F.struct("th", "pos", "size")).alias("spans"))
    joined = texts.join(found.hint("merge"), "id", "left").select(F.when(F.col("id") < LAST, F.col("id")).cast(kind).alias("doc_id"), *keep, "th", "text", "spans")
    fields = ", ".join(f"`{c}` {x}" for c, x in joined.dtypes if c not in ("th", "text", "spans"))
    tail = "kept_sha256 string" if digest else "kept string, removed array<struct<first:int,n:int>>"
    return map_slices(joined, "text", f"{fields}, n_words long, n_removed long, {tail}", _apply(digest))


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated windows; a document of which nothing is left goes."""
    rest = [c for c in docs.columns if c != "text"]
    out = substring_dedup(docs.select("doc_id", "text", F.col("text").isNull().alias("_none"), F.struct(*rest).alias("_doc")), keep=("_none", "_doc"))
    out = out.filter(F.col("kept").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_words") == 0))
    cols = {c: F.col(f"_doc.`{c}`") for c in rest} | {"text": F.when(~F.col("_none"), F.col("kept"))}
    if "n_chars" in rest:
        cols["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(cols["n_chars"]).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*(cols[c].alias(c) for c in docs.columns))


SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {K - 1}], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - {K - 2}, 1))) AS t(i)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM windows JOIN firsts USING (s), unnest(range(0, {K})) AS t(j) WHERE first < doc_id
), kept AS (
  SELECT d.doc_id, string_agg(w[i], ' ' ORDER BY i) AS s, count(*) AS n FROM d, unnest(range(1, len(w) + 1)) AS t(i)
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = d.doc_id AND gone.i = t.i) GROUP BY d.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

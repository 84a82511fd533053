"""Similarity join on shingle sets with adaptive multi-match prefixes.

Documents link when the Jaccard similarity of their sets of five-word shingles is at least 0.8.
With the shingles of all sets in one global order (rare ones first), two linked sets share at
least l of their first n - ceil(0.8 n) + l shingles, for every l they can have. Each set picks its
own l by estimated candidate cost: a longer prefix meets more sets, but a pair then needs more
shared prefix shingles before it is verified. A pair uses the smaller l of its two sets.

Steps, none of which collects documents, links or components to the driver:

1. Equal sets are one entity from the start, whatever their number of copies.
2. Document frequencies of all shingles: slices send packed hash arrays by hash range, and the
   ranges send back the shingles that two entities share, with their frequencies. A shingle of one
   entity alone can't match; it counts in the prefix and is never sent again.
3. Postings of the prefixes. Shingles with the same entities are one posting list.
4. Every list links its members to its most typical one (by mean log frequency of its shingles:
   among edited copies, their common origin), if they pass the l-match and the exact test. Lists
   whose members are all in one component are done.
5. The lists that are left are cut into blocks of ``BLOCK`` entities. Tasks compare blocks by
   numbers alone. With i shingles in common with the list's typical set, and o more that some other
   set has, two sets share at most min(i, i') + min(o, o') shingles. Only pairs from different
   components that this bound allows are candidates, each from the first list that both are in;
   they take the l-match and the exact test.
6. Components of all links; a component is named by its smallest doc_id.

Definitions: A-Z lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; texts under five words are one
shingle of their whole sequence; null or blank texts have an empty set and link with nothing. A
null id never names a component that has others. Repeated rows are copies of each other, whatever
their ids: equal ids make no difference to links. Shingles
are 64-bit hashes and entities 64-bit hashes of their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W
from siltstone.llm.arrow import map_slices, slices
from siltstone.operators.components import connected_components
from siltstone.runtime import materialise, release, table

SHINGLE = 5
#: Similarity in percent.
PERCENT = 80
#: Largest l, and what verifying a candidate costs in postings.
MOST_MATCHES, VERIFY_COST = 8, 4.0
BLOCK = 1024
SLICE = 8 << 20
#: Bytes of hashes per hash range.
RANGE_BYTES = 16 << 20


def sets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of the batch, ascending, and offsets."""
    out, base = [], [np.zeros(1, np.int64)]
    done = 0
    for part in slices(b, "text"):
        w = W.split(part["text"], True)
        h, n = w.hashes(), w.n
        keys = []
        for k in range(1, SHINGLE + 1):
            x, at = W.windows(h, w.ptr, k)
            doc = np.searchsorted(w.ptr, at, "right") - 1
            ok = np.ones(len(x), bool) if k == SHINGLE else n[doc] == k
            keys.append((x[ok] + W.U64(0 if k == SHINGLE else k), doc[ok]))
        x, doc = (np.concatenate(v) for v in zip(*keys, strict=True))
        order = np.lexsort((x, doc))
        x, doc = x[order], doc[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
        x, doc = x[new], doc[new]
        out.append(x)
        base.append(np.searchsorted(doc, np.arange(1, part.num_rows + 1)) + done)
        done += len(x)
    return (np.concatenate(out) if out else np.zeros(0, W.U64)), np.concatenate(base)


def entity(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate((np.zeros(1, W.U64), np.cumsum(W.mix(x ^ W.U64(0x5851F42D4C957F2D)))))
    return W.mix(total[ptr[1:]] - total[ptr[:-1]] + np.diff(ptr).astype(W.U64) * W.U64(W.WORD_BASE))


def _members(b: pa.RecordBatch) -> pa.RecordBatch:
    x, ptr = sets(b)
    return pa.RecordBatch.from_arrays([b["doc_id"], b["t"], pa.array(np.diff(ptr)), pa.array(W.signed(entity(x, ptr)))], names=["doc_id", "t", "n", "e"])


def _spread(ranges: int):
    def kernel(b: pa.RecordBatch) -> pa.RecordBatch | None:
        x, ptr = sets(b)
        e, n = entity(x, ptr), np.diff(ptr)
        _, first = np.unique(e, return_index=True)
        use = np.zeros(len(e), bool)
        use[first] = True
        doc = np.repeat(np.arange(len(e)), n)
        ok = use[doc]
        x, doc = x[ok], doc[ok]
        if not len(x):
            return None
        part = _range_of(x, ranges)
        order = np.argsort(part, kind="stable")
        x, doc, part = x[order], doc[order], part[order]
        at = np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]))
        rows = []
        for a, z in zip(at[:-1], at[1:], strict=True):
            d = doc[a:z]
            head = np.flatnonzero(np.diff(d, prepend=-1))
            rows.append((int(part[a]), x[a:z].tobytes(), e[d[head]].tobytes(), n[d[head]].astype(np.int32).tobytes(), np.diff(np.append(head, len(d))).astype(np.int32).tobytes()))
        p, *cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["part", "x", "e", "n", "c"])

    return kernel


def _range_of(x: np.ndarray, ranges: int) -> np.ndarray:
    return ((x >> W.U64(32)) % W.U64(ranges)).astype(np.int64)


def _unpack(t: pa.Table, *more: str) -> list[np.ndarray]:
    """Hashes, entities and set sizes of packed rows, and further 32-bit columns, one value per hash."""
    joined = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
    c = joined("c", np.int32)
    return [joined("x", np.uint64), np.repeat(joined("e", np.uint64), c), np.repeat(joined("n", np.int32), c), *(joined(m, np.int32) for m in more)]


def _frequencies(ranges: int):
    def group(t: pa.Table) -> pa.Table:
        x, e, n = _unpack(t)
        order = np.lexsort((e, x))
        x, e, n = x[order], e[order], n[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (e[1:] != e[:-1])
        x, e, n = x[new], e[new], n[new]
        head = np.flatnonzero(np.diff(x, prepend=~x[:1]) != 0)
        size = np.diff(np.append(head, len(x)))
        df = np.repeat(size, size)
        ok = df > 1
        x, e, n, df = x[ok], e[ok], n[ok], df[ok]
        part = _range_of(e, ranges)
        order = np.lexsort((e, part))
        x, e, n, df, part = x[order], e[order], n[order], df[order], part[order]
        at = np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]))
        rows = []
        for a, z in zip(at[:-1], at[1:], strict=True):
            h = np.flatnonzero(np.concatenate(([True], e[a + 1 : z] != e[a : z - 1])))
            rows.append((int(part[a]), x[a:z].tobytes(), e[a:z][h].tobytes(), n[a:z][h].tobytes(), np.diff(np.append(h, z - a)).astype(np.int32).tobytes(), df[a:z].astype(np.int32).tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        return pa.table([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "x", "e", "n", "c", "df"])

    return group


def _prefixes(t: pa.Table) -> pa.Table:
    """Entities whose prefix has a shared shingle: size, l, prefix in order, and all shared shingles."""
    x, e, n, df = _unpack(t, "df")
    order = np.lexsort((x, df, e))
    x, e, n, df = x[order], e[order], n[order].astype(np.int64), df[order].astype(np.float64)
    head = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1]))) if len(e) else np.zeros(0, int)
    ptr = np.append(head, len(e))
    size, shared = n[head], np.diff(ptr)
    need = (PERCENT * size + 99) // 100
    alone = size - shared
    reach = lambda m: np.clip(size - need + m - alone, 0, shared)  # noqa: E731  shared shingles in the m-prefix
    met = np.concatenate(([0.0], np.cumsum(df - 1)))
    best, pick = np.full(len(head), np.inf), np.ones(len(head), int)
    for m in range(1, MOST_MATCHES + 1):
        d = met[head + reach(m)] - met[head]
        cost = np.where(m <= need, d + VERIFY_COST * d / m, np.inf)
        better = cost < best * (1 - 1e-12)
        best[better], pick[better] = cost[better], m
    length = np.choose(pick - 1, [reach(m) for m in range(1, MOST_MATCHES + 1)]) if len(head) else pick
    typical = (np.add.reduceat(np.log2(df), head) if len(head) else np.zeros(0)) / np.maximum(size, 1)
    some = np.flatnonzero(length >= np.minimum(pick, need)) if len(head) else head
    lists = lambda a, z: pa.array([W.signed(x[p:q]) for p, q in zip(a, z, strict=True)], pa.list_(pa.int64()))
    a = head[some]
    return pa.table([pa.array(W.signed(e[a])), pa.array(size[some].astype(np.int32)), pa.array(pick[some].astype(np.int32)), pa.array((size - need - alone)[some].astype(np.int32)), pa.array(typical[some].astype(np.float64)), lists(a, a + length[some]), lists(a, ptr[some + 1])], names=["e", "n", "l", "base", "typical", "prefix", "toks"])


ENTITY = "e long, n int, l int, base int, typical double, prefix array<long>, toks array<long>"


def overlaps(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b, enough, i, n1, n2): whether a pair shares enough prefix shingles, its overlap, and the set sizes."""
    side = lambda c, k: entities.select(F.col("e").alias(c), *(F.col(x).alias(f"{x}{k}") for x in ("n", "l", "base", "prefix", "toks")))
    both = pairs.join(side("b", 2), "b").join(side("a", 1), "a")
    m = F.least("l1", "l2")
    upto = lambda k: F.slice(f"prefix{k}", 1, F.greatest(F.lit(0), F.least(F.size(f"prefix{k}"), m + F.col(f"base{k}"))))
    enough = F.size(F.array_intersect(upto(1), upto(2))) >= m
    return both.select("a", "b", enough.alias("enough"), F.size(F.array_intersect("toks1", "toks2")).alias("i"), "n1", "n2")


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("enough") & (100 * F.col("i") >= PERCENT * (F.col("n1") + F.col("n2") - F.col("i")))).select("a", "b")


FIELDS = ("e", "comp", "side", "n", "r", "i")


def _candidates(x: int, rows: dict[str, list], where: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of a task's group from different components that may be similar enough and meet in list x first."""
    e, comp, side, n, r, i = (np.array(rows[c], np.int64) for c in FIELDS)
    if len(e) < 2 or (comp == comp[0]).all():
        return []
    # Two blocks: only pairs across; one block with itself: all of its pairs.
    ok = comp[:, None] != comp[None, :]
    if (side > 0).any():
        ok &= side[:, None] != side[None, :]
    o = r - i
    most = np.minimum(i[:, None], i[None, :]) + np.minimum(o[:, None], o[None, :])
    ok &= 100 * most >= PERCENT * (n[:, None] + n[None, :] - most)
    p, q = np.nonzero(np.triu(ok, 1))
    sets_of = {j: set(where[j].tolist()) for j in np.unique(np.concatenate((p, q))).tolist()}
    return [(int(min(e[a], e[b])), int(max(e[a], e[b]))) for a, b in zip(p.tolist(), q.tolist(), strict=True) if min(sets_of[a] & sets_of[b]) == x]


def _blocks(batches):
    """Groups arrive sorted by key; the last one of a batch waits for the next batch."""
    key, x, rows, where = None, 0, {c: [] for c in FIELDS}, []

    def pairs(out):
        a, b = zip(*sorted(set(out)), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for t in batches:
        keys, xs = t["key"].to_numpy(), t["x"].to_numpy()
        cols = [t[c].to_numpy().tolist() for c in FIELDS]
        flat, at = t["lists"].flatten().to_numpy(), t["lists"].offsets.to_numpy() - t["lists"].offsets[0].as_py()
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).tolist()
        out = []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            if keys[a] != key:
                out += _candidates(x, rows, where) if key is not None else []
                key, x, rows, where = keys[a], int(xs[a]), {c: [] for c in FIELDS}, []
            for c, v in zip(FIELDS, cols, strict=True):
                rows[c] += v[a:z]
            where += [flat[at[j] : at[j + 1]] for j in range(a, z)]
        if out:
            yield pairs(out)
    out = _candidates(x, rows, where) if key is not None else []
    if out:
        yield pairs(out)


def _n_ranges(members: DataFrame) -> int:
    """So many that the hashes of one fill about ``RANGE_BYTES``, from the number of all shingles."""
    total = members.agg(F.sum("n")).first()[0] or 0
    return int(min(1 << 20, max(8, 8 * total // RANGE_BYTES)))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.lit(4), text)


def shingle_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return placed(docs, text, doc_id).select("doc_id", "n_shingles", "component_id")


def placed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``shingle_components`` with a hash ``t`` of the text, and ``comp``, a name of the component (null for an empty
    set) that doesn't need ids."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("t"), F.col(text).alias("text"))
    members = materialise(map_slices(rows, "text", f"doc_id {kind}, t long, n long, e long", _members, SLICE), "members")
    ranges = _n_ranges(members)
    packed = map_slices(rows.select("text"), "text", "part int, x binary, e binary, n binary, c binary", _spread(ranges), SLICE)
    shared = packed.groupBy("part").applyInArrow(_frequencies(ranges), "part int, x binary, e binary, n binary, c binary, df binary")
    entities = materialise(shared.groupBy("part").applyInArrow(_prefixes, ENTITY), "entities")

    postings = entities.select("e", "n", F.size("toks").alias("r"), "typical", F.explode("prefix").alias("x"))
    mark = F.xxhash64(F.lit(5), "e").cast("decimal(38,0)")
    near = F.min(F.struct((-F.col("typical")).alias("far"), "e", "n", "r")).alias("p")
    lists = postings.groupBy("x").agg(F.count("*").alias("m"), near, F.sum(mark).alias("sig")).filter("m > 1")
    lists = lists.groupBy("sig", "m", "p").agg(F.min("x").alias("x"))
    lists = materialise(postings.join(lists, "x").select("x", "e", "n", "r", "m", F.col("p.e").alias("p")), "lists")
    star = lists.filter("e <> p").select(F.col("p").alias("a"), F.col("e").alias("b")).distinct()
    star = materialise(overlaps(star, entities), "star")
    first = linked(star)
    comps = materialise(connected_components(first).withColumnsRenamed({"node": "e", "component": "comp"}), "components")
    common = star.select(F.col("a").alias("p"), F.col("b").alias("e"), "i")
    placed = lists.join(comps, "e", "left").join(common, ["p", "e"], "left")
    placed = placed.select("x", "e", "n", "r", "m", F.coalesce("comp", "e").alias("comp"), F.coalesce("i", "r").alias("i"))
    still = placed.groupBy("x").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select("x")
    left = materialise(placed.join(still, "x"), "open")
    left = left.join(left.groupBy("e").agg(F.collect_set("x").alias("lists")), "e")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    left = left.withColumn("s", blocks).withColumn("k", F.pmod(F.xxhash64(F.lit(9), "e", "x"), F.col("s")).cast("int"))
    left = left.select("x", "e", "comp", "n", "r", "i", "lists", "k", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("j"))
    lo, hi = F.least("k", "j"), F.greatest("k", "j")
    work = left.select(F.xxhash64("x", lo, hi).alias("key"), "x", "e", "comp", F.when(F.col("k") > F.col("j"), 1).when(F.col("k") < F.col("j"), 2).otherwise(0).alias("side"), "n", "r", "i", "lists")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = work.repartition(parts, "key").sortWithinPartitions("key", "e").mapInArrow(_blocks, "a long, b long").distinct()
    second = linked(overlaps(candidates, entities))
    links = materialise(first.union(second), "links")
    release(entities, lists, star, comps)
    comps = connected_components(links)

    known = members.filter("n > 0").groupBy("e").agg(F.min("doc_id").alias("d")).join(comps.withColumnRenamed("node", "e"), "e", "left").withColumn("component", F.coalesce("component", "e"))
    smallest = known.groupBy("component").agg(F.min("d").alias("component_id"))
    named = known.join(smallest, "component").select("e", "component", "component_id")
    out = members.join(named, "e", "left")
    some = F.col("n") > 0
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), F.when(some, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("component")).alias("comp"))


def query(spark, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, and every row without words.

    It is the row with the smallest id (rows without an id come last), of these the one with the smallest hash
    of its text. Rows equal in both are one row several times: one of them stays.
    """
    rows = placed(docs).filter("comp IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    kinds = materialise(rows.groupBy("comp", "doc_id", "t").agg(F.count("*").alias("times")), "kinds")
    best = kinds.groupBy("comp").agg(F.min(order).alias("best"))
    marks = kinds.join(best, "comp").withColumn("first", order == F.col("best"))
    marks = materialise(marks.filter("NOT first OR times > 1").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), F.col("first").alias("_first")), "marks")
    same = lambda m: docs["doc_id"].eqNullSafe(m["_id"]) & (text_key(docs["text"]) == m["_t"])
    columns = [f"`{c}`" for c in docs.columns]
    out = docs.join(marks, same(marks), "left_anti").select(*columns)
    several = marks.filter("_first")
    if several.isEmpty():
        return out
    whole = docs.join(several, same(several)).select("_id", "_t", F.struct(*columns).alias("_doc"))
    one = whole.groupBy("_id", "_t").agg(F.first("_doc").alias("_doc"))
    return out.unionByName(one.select(*(F.col(f"_doc.{c}") for c in columns)))


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""

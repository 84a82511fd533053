import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import geometry as G
from siltstone.functions import text as T
from siltstone.functions import video
from siltstone.functions.u64 import splitmix
from siltstone.operators import calibrate as cal
from siltstone.operators import dedup, describe, matching
from siltstone.operators.components import connected_components
from siltstone.streaming import incremental
from tests.test_pdf import make
from tests.test_sources import bmp_bytes, wav_bytes

rng = np.random.default_rng(2)


def _texts(n=60):
    base = [f"w{i}" for i in range(80)]
    out = []
    for i in range(n):
        w = list(base) if i % 3 else [f"z{i}x{j}" for j in range(50)]
        for j in rng.choice(len(w), i % 4, replace=False):
            w[j] = f"e{i}_{j}"
        out.append((i, " ".join(w)))
    return [*out, (100, out[1][1].upper()), (101, ""), (102, " "), (103, None)]


def _components(ids, links):
    p = {i: i for i in ids}
    for a, b in links:
        x, y = p[a], p[b]
        p = {k: min(x, y) if v in (x, y) else v for k, v in p.items()}
    return p


def test_text_dedup_equals_all_pairs(spark):
    rows = _texts()
    sig = {i: T.signature_of(t) for i, t in rows if t is not None}
    links = {(a, b) for a, b in itertools.combinations(sig, 2) if (sig[a] == sig[b]).mean() >= 0.8}
    want = _components(sig, links)
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.id: r for r in dedup.text_dedup(df).collect()}
    assert {i: got[i].cluster_id for i in sig} == want
    assert got[103].status == "skipped" and got[101].cluster_id == got[102].cluster_id == 101 and got[101].exact
    _, _, sigs = dedup.text_signatures(df)
    pairs = {(r.a, r.b) for r in matching.text_pairs(sigs).collect()}
    reps = {r.id for r in sigs.collect()}
    assert pairs == {x for x in links if set(x) <= reps}


def test_lsh_has_the_published_recall(spark):
    a = splitmix(1, 128 * 40).reshape(40, 128)
    b = a.copy()
    b[:, :20] ^= np.uint64(1)
    rows = [(i, [int(x) for x in s.view(np.int64)]) for i, s in enumerate(a)]
    q = spark.createDataFrame([(i, [int(x) for x in s.view(np.int64)]) for i, s in enumerate(b)], "id int, sig array<long>")
    got = {(r.query_id, r.id) for r in matching.lsh_candidates(q, spark.createDataFrame(rows, "id int, sig array<long>")).collect()}
    assert got == {(i, i) for i in range(40)}
    with pytest.raises(ValueError):
        T.stripe_keys(a[:, :100])


def test_hamming_search_is_exhaustive(spark):
    h = splitmix(5, 300).view(np.int64)
    h[150:200] = h[:50] ^ (np.int64(0b1011) << np.int64(20))
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(h)], "id int, hash long")
    got = {(r.query_id, r.id, r.distance) for r in matching.hamming_search(df.filter("id < 60"), df, 10).collect()}
    want = {(i, j, d) for i in range(60) for j in range(300) if (d := bin((int(h[i]) ^ int(h[j])) & ((1 << 64) - 1)).count("1")) <= 10}
    assert got == want


def test_binary_pairs(spark):
    rows = [(1, [b"a", b"b"]), (2, [b"a", b"b", b"c"]), (3, [b"c"]), (4, []), (5, [])]
    got = {(r.a, r.b, round(r.jaccard, 6)) for r in matching.binary_pairs(spark.createDataFrame(rows, "id int, digests array<binary>")).collect()}
    assert got == {(1, 2, 0.666667), (4, 5, 1.0)}


def test_calibrate_by_hand(spark):
    pairs = [(1, True)] * 4 + [(9, True)] * 4 + [(9, False)] + [(11, True)] * 2 + [(11, False)] * 1 + [(20, False)] * 5
    df = spark.createDataFrame(pairs, "distance int, same boolean")
    for profile, beta in cal.BETA.items():
        best = (-1, 0, None)
        for th in (None, 1, 9, 11, 20):
            tp = sum(s for d, s in pairs if th is not None and d <= th)
            fp = sum(not s for d, s in pairs if th is not None and d <= th)
            p, r = (tp / (tp + fp), tp / 10) if tp else (0, 0)
            f = (1 + beta**2) * p * r / (beta**2 * p + r) if tp else 0
            best = max(best, (f, -(tp + fp) if profile == "dedup" else tp + fp, th), key=lambda x: x[:2])
        got = cal.calibrate(df, profile).first()
        assert got.threshold == best[2] and abs(got.score - best[0]) < 1e-12
    none = cal.calibrate(df.filter("NOT same"), "search").first()
    assert none.threshold is None and none.true_negatives == 7
    assert cal.calibrate(df.limit(0), "dedup").count() == 0
    lines = spark.createDataFrame([(x,) for x in ("# c", "", "a, b ,YES", "c,d,0,extra")], "value string")
    assert [tuple(r) for r in cal.parse_pairs(lines).collect()] == [("a", "b", True), ("c", "d", False)]
    with pytest.raises(Exception, match="label"):
        cal.parse_pairs(spark.createDataFrame([("a,b,maybe",)], "value string")).collect()


def test_components(spark):
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(i + 500, i + 501) for i in range(40)]
    want = _components({x for e in edges for x in e}, edges)
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_corners_by_definition():
    img = rng.integers(0, 256, (40, 44), np.uint8)
    s = G.corner_scores(img)
    for y, x in ((3, 3), (20, 20), (36, 40), (2, 10)):
        best = 0
        if 3 <= y < 37 and 3 <= x < 41:
            ring = [int(img[y + b, x + a]) - int(img[y, x]) for a, b in G.RING]
            for k in range(16):
                arc = [ring[(k + j) % 16] for j in range(9)]
                if min(arc) > 0 or max(arc) < 0:
                    best = max(best, min(map(abs, arc)))
        assert s[y, x] == best
    assert G.fast9(img[:6]) == []
    assert G.suppress([(1, 1, 5), (2, 1, 5), (9, 9, 1)]) == [(1, 1, 5), (9, 9, 1)]
    feats = G.orb(np.kron(rng.integers(0, 256, (24, 24), np.uint8), np.ones((5, 5), np.uint8)), 20)
    assert feats and all(len(f["desc"]) == 32 for f in feats)


def test_affine_fit_and_warping():
    src = rng.uniform(0, 100, (40, 2))
    m = np.array([[0.9, -0.2, 5.0], [0.3, 1.1, -7.0]])
    dst = src @ m[:, :2].T + m[:, 2]
    dst[:10] += 50
    model, ok, err = G.ransac_affine(src, dst)
    assert np.allclose(model, m) and set(ok) == set(range(10, 40)) and err < 1e-6
    with pytest.raises(ValueError):
        G.ransac_affine(src[:2], dst[:2])
    assert G.solve3(np.ones((3, 3)), np.ones(3)) is None
    assert np.allclose(G.inverse3(np.diag([1.0, 2.0, 4.0])), np.diag([1, 0.5, 0.25]))
    assert G.dtw_series([1, 2, 3], [1, 2, 3]) == 0 and G.dtw_series([], [1]) == 1.0
    assert abs(G.dtw_series([0, 0, 1, 1], [0, 1], -1.0)) < 1e-12


def test_video_lane(spark):
    a = [1, 2, 3, 4, 5]
    df = spark.createDataFrame([(a, [1, 2, 3]), ([], [1]), ([0, 0], [-1, 0])], "x array<long>, y array<long>")
    assert [r.s for r in df.select(matching.video_score(F.col("x"), F.col("y")).alias("s")).collect()] == [1.0, 1.0, 0.5]
    assert (video.chain_signature_of(np.array(a, np.uint64)) == video.chain_signature_of(np.array([*a, 3, 4, 5], np.uint64))).mean() > 0.4
    f = spark.createDataFrame([("v", -5, 1), ("v", 0, 2), ("v", 299, 3), ("v", 300, 4), ("v", 300, 9)], "id string, pts long, frame long")
    assert [(r.slot, r.frame) for r in video.sample(f, "id", "pts", "frame", 600).orderBy("slot").collect()] == [(-1, 1), (0, 2), (1, 4)]


def test_describe(spark):
    img = rng.integers(0, 256, (40, 40, 3), np.uint8)
    rows = [("i", bmp_bytes(img)), ("t", b"alpha beta gamma"), ("b", b"\xff\xfe" * 3000), ("a", wav_bytes(np.zeros((9000, 1)))), ("a48", wav_bytes(np.zeros((9, 1)), 48000)), ("p", b"%PDF-1.4"), ("p2", make(["BT /F1 1 Tf (Alpha Beta GAMMA) Tj ET"])), ("x", b"BMxx")]
    d = describe.describe(spark.createDataFrame(rows, "path string, content binary"))
    got = {r.key: r for r in d.collect()}
    assert len(got) == 8 and got["p2"].minhash == got["t"].minhash and got["p2"].tier1 == got["t"].tier1 and got["t"].facts["words"] == 3 and len(got["t"].minhash) == 128
    assert got["a48"].error.kind == "BadValue" and got["a48"].tier1 and got["p"].error.kind == "BadValue" and got["x"].error.kind == "Truncated"
    assert got["b"].facts["bytes"] == 6000 and got["i"].facts["width"] == 40
    text = {r.key: r.report for r in describe.to_line(d).collect()}
    assert "5409aadb22bb8479" in text["t"] and text["x"].endswith("width") or "refused" in text["x"]
    assert '"5409aadb22bb8479"' in {r.key: r.json for r in describe.to_json(d).collect()}["t"]


def test_stream_of_copies(spark, tmp_path):
    rows = [(1, "Alpha beta", "2024-01-01 00:00:00"), (2, "alpha BETA ", "2024-01-01 00:01:00"), (3, "other", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "id int, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.exact(s).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("firsts").collect()) in ([1, 3], [2, 3])
    index = df.select("id", T.signature("text").alias("sig"))
    q = incremental.near(s.select("id", "text"), index).writeStream.format("memory").queryName("nears").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.match) for r in spark.table("nears").collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}


def test_copies_are_asked_and_found(spark):
    rows = [*_texts(), *((i, _texts()[1][1]) for i in range(200, 400)), (150, _texts()[2][1]), (450, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    sig = {i: T.signature_of(t) for i, t in rows if t is not None}
    stripes = {i: [s.reshape(T.BANDS, T.ROWS)[k].tobytes() for k in range(T.BANDS)] for i, s in sig.items()}
    want = {(q, i) for q in sig if q % 50 == 0 for i in sig if any(x == y for x, y in zip(stripes[q], stripes[i], strict=True))}
    got = [(r.query_id, r.id) for r in dedup.lookup(df, F.col("id") % 50 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (150, 2) in want and (200, 399) in want

    near = dedup.near_duplicates(df).collect()
    group = {i: {i} for i in sig}
    for r in near:
        if r["copy"]:
            group[r.a].add(r.b)
    pairs = {tuple(sorted((a, b))) for r in near for a in group[r.a] for b in group[r.b] if not r["copy"]}
    pairs |= {(a, b) for g in group.values() if len(g) > 1 for a in g for b in g if a < b}
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(sig), 2) if (sig[a] == sig[b]).mean() >= 0.8}

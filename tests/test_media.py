"""Matching and deduplication of generated files, against every pair."""

import itertools
import json

import numpy as np
import pytest

from siltstone.functions import audio, chunking, raster
from siltstone.functions import text as T
from siltstone.operators import describe, media
from siltstone.sources import bmp, fixtures, wav

PICTURES = [fixtures.patterned(64 + 16 * (s % 2), 48, s) for s in range(4)]
SOUNDS = [fixtures.tone(tuple(400.0 + 700 * s + 230 * i for i in range(7)), 2.5) for s in range(3)]
PROSE = [fixtures.prose(3000, s) for s in range(3)]
BLOBS = [b"\xff\xfe" + fixtures.blob(60_000, s) for s in range(2)]
FILES = {
    **{f"p{s}": fixtures.bmp24(x) for s, x in enumerate(PICTURES)},
    **{f"p{s}n": fixtures.bmp24(fixtures.perturbed(x, 3, s)) for s, x in enumerate(PICTURES)},
    "p0copy": fixtures.bmp24(PICTURES[0]),
    **{f"s{s}": fixtures.wav16(x) for s, x in enumerate(SOUNDS)},
    "s0late": fixtures.wav16(np.concatenate((np.zeros(audio.HOP * 3, np.int16), SOUNDS[0]))),
    "still": fixtures.wav16(np.zeros(20_000, np.int16)),
    "stillcopy": fixtures.wav16(np.zeros(20_000, np.int16)),
    **{f"t{s}": x.encode() for s, x in enumerate(PROSE)},
    "t0up": PROSE[0].upper().encode(),
    "t1cut": PROSE[1][60:].encode(),
    **{f"b{s}": x for s, x in enumerate(BLOBS)},
    "b0cut": BLOBS[0][:50_000],
    "mp3": b"ID3" + bytes(20),
    "broken": b"BMxx",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content binary").repartition(3)


def test_fixtures_come_back():
    for x in PICTURES:
        assert (bmp.decode(fixtures.bmp24(x))[:, :, :3] == x).all()
    got = wav.decode(fixtures.wav16(SOUNDS[0]))
    assert got.rate == 44100 and (got.samples[:, 0] == SOUNDS[0]).all()
    assert len(fixtures.prose(262_144)) == 262_144 and fixtures.prose(99, 4) == fixtures.prose(99, 4) and len(fixtures.blob(77)) == 77
    assert np.abs(fixtures.perturbed(PICTURES[0], 3).astype(int) - PICTURES[0]).max() <= 3
    assert len(fixtures.bmp24(fixtures.patterned(512, 384))) == 512 * 384 * 3 + 54


def _signature(data):
    if data[:3] in (b"ID3", b"BMx"):
        return None
    if data[:2] == b"BM":
        return "image", raster.phash(bmp.decode(data))
    if data[:4] == b"RIFF":
        return "audio", [{"t": a, "f": b} for a, b in audio.peaks_of(audio.mono(wav.decode(data).samples))]
    if data[:2] == b"\xff\xfe":
        return "binary", set(chunking.chunk_digests(data))
    return "text", T.signature_of(data.decode())


def _distance(x, y):
    kind = x[0]
    if kind == "image":
        return (x[1] ^ y[1]).bit_count()
    if kind == "audio":
        best = {}
        for p, q in itertools.product(x[1], y[1]):
            if p["f"] == q["f"]:
                best[p["t"] - q["t"]] = best.get(p["t"] - q["t"], 0) + 1
        if not best:
            return (1 << 32) - 1
        d = min(best, key=lambda d: (-best[d], d))
        return (1 << 32) - 1 - sum(best.get(d + i, 0) for i in (-1, 0, 1))
    share = (x[1] == y[1]).mean() if kind == "text" else len(x[1] & y[1]) / len(x[1] | y[1])
    return round((1 - share) * 1e6)


LIMITS = {"image": 10, "audio": (1 << 32) - 1 - 8, "text": 200_000, "binary": 500_000}


@pytest.mark.parametrize("threshold", [None, 0, 12, 150_000])
def test_clusters_against_every_pair(spark, files, threshold):
    sig = {k: s for k, v in FILES.items() if (s := _signature(v))}
    group = {k: k for k in sig}
    for a, b in itertools.combinations(sorted(sig), 2):
        if sig[a][0] == sig[b][0] and _distance(sig[a], sig[b]) <= (LIMITS[sig[a][0]] if threshold is None else threshold):
            x, y = group[a], group[b]
            group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    got = {r.id: r for r in media.media_dedup(files, threshold).collect()}
    assert got.keys() == FILES.keys()
    assert {k: got[k].cluster_id for k in sig} == group
    assert {k for k, r in got.items() if r.status == "skipped" and r.error.kind} == {"mp3", "broken"}
    if threshold is None:
        assert got["p0copy"].cluster_id == "p0" and got["s0late"].cluster_id == "s0" and got["t0up"].exact and not got["p1n"].exact and got["still"].status == "single"


def test_match_says_score_bound_and_verdict(spark, files):
    keys = sorted(FILES)
    pairs = spark.createDataFrame(list(itertools.combinations(keys, 2)), "a string, b string")
    d = describe.describe(files)
    got = {(r.a, r.b): r for r in media.match(pairs, d).collect()}
    sig = {k: _signature(v) for k, v in FILES.items()}
    for (a, b), r in got.items():
        if sig[a] is None or sig[b] is None:
            assert r.error and r.matched is None
        elif sig[a][0] != sig[b][0]:
            assert r.error.kind == "BadValue" and r.distance is None
        else:
            want = _distance(sig[a], sig[b])
            assert r.error is None and r.distance == want and r.matched == (want <= LIMITS[sig[a][0]])
    assert got["p0", "p0copy"].score == "hamming=0" and got["p0", "p0copy"].bound == "hamming <= 10"
    assert got["s0", "s0late"].score.endswith("delta_t=-3") and got["still", "stillcopy"].score == "votes=0"
    assert got["t0", "t0up"].score == "jaccard=1.000000" and got["b0", "b0cut"].bound == "jaccard >= 0.5"
    one = {(r.a, r.b): json.loads(r.json) for r in media.match_json(media.match(pairs.filter("a = 'p0' AND b = 'p0copy'"), d)).collect()}
    assert one["p0", "p0copy"] == {"a": "p0", "b": "p0copy", "modality": "image", "score": "hamming=0", "distance": 0, "bound": "hamming <= 10", "matched": True}
    hashes = {r.key: json.loads(r.json) for r in media.hash_json(d).collect()}
    assert hashes["p0"]["tier1"] == hashes["p0copy"]["tier1"] and "mp3" not in hashes and hashes["t0"]["file"] == "t0"

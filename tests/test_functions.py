import hashlib
import zlib

import numpy as np
import pytest

from siltstone.functions import chunking as C
from siltstone.functions import text as T
from siltstone.functions import u64


def test_fnv_and_splitmix_pins():
    assert u64.fnv1a(b"foobar") == 0x85944171F73967E8
    data = np.frombuffer(b"foobarxfoo", np.uint8)
    got = u64.fnv1a_spans(data, np.array([0, 7, 3, 5]), np.array([6, 10, 3, 6]))
    assert [int(x) for x in got] == [u64.fnv1a(b"foobar"), u64.fnv1a(b"foo"), u64.fnv1a(b""), u64.fnv1a(b"r")]
    assert int(u64.splitmix(0, 1)[0]) == 0xE220A8397B1DCDAF


def test_minhash_pin():
    s = T.signature_of("alpha beta gamma")
    assert [f"{int(x):016x}" for x in s[:2]] == ["5409aadb22bb8479", "b2e6ff4edebf53c6"]
    assert f"{u64.fnv1a(s.astype("<u8").tobytes()):016x}" == "46f8ab1a50c61813"


def test_canonical_is_idempotent_and_composes():
    for x in ("", "  A\u0301b \u3000\t", "ΑΣ", "x\x1c", "é" * 3 + "\n\n"):
        assert T.canonical(T.canonical(x)) == T.canonical(x)
    assert T.canonical("e\u0301") == T.canonical("\u00e9")
    assert T.canonical("x\x1c") == "x\x1c\n"  # U+001C is not White_Space


def test_empty_texts_match():
    assert (T.signature_of("") == np.uint64((1 << 64) - 1)).all()


def _scalar_chunks(data, lo=2048, avg=8192, hi=32768):
    strict, loose = C.select_masks(avg)
    at, out, g = 0, [], [int(x) for x in C.GEAR]
    while at < len(data):
        n = len(data) - at
        if n <= lo:
            out.append((0, at, n))
            break
        end, fp, cut = min(n, hi), 0, None
        for i in range(lo, end):
            fp = ((fp << 1) + g[data[at + i]]) & u64.ALL
            if fp & (strict if i < min(avg, end) else loose) == 0:
                cut = i
                break
        out.append((fp, at, end if cut is None else cut))
        at += out[-1][2]
    return out


@pytest.mark.parametrize("n", [0, 1, 2048, 2049, 9000, 40000, 300000])
def test_chunks_equal_the_scalar_definition(n):
    data = u64.splitmix_bytes(0x5EED5EED5EED5EED, n)
    assert C.chunks(data) == _scalar_chunks(data)
    assert C.chunks(bytes(n)) == _scalar_chunks(bytes(n))


def test_one_megabyte_has_the_known_number_of_cuts():
    assert len(C.chunks(u64.splitmix_bytes(0x5EED5EED5EED5EED, 1 << 20))) == 107


@pytest.mark.parametrize(("lo", "avg", "hi", "level"), [(64, 256, 1024, 3), (64, 400, 2000, 1), (1024, 4096, 9000, 0)])
def test_other_geometries(lo, avg, hi, level):
    data = u64.splitmix_bytes(9, 30000)
    got = C.chunks(data, lo, avg, hi, level)
    assert sum(n for _, _, n in got) == len(data) and all(n <= hi for _, _, n in got) and all(n >= lo for _, _, n in got[:-1])
    strict, loose = C.select_masks(avg, level)
    g, at = [int(x) for x in C.GEAR], 0
    for fp, o, n in got:
        assert o == at
        at += n
        if n > lo:
            x, cut = 0, None
            for i in range(lo, min(len(data) - o, hi)):
                x = ((x << 1) + g[data[o + i]]) & u64.ALL
                if x & (strict if i < min(avg, len(data) - o) else loose) == 0:
                    cut = i
                    break
            assert n == (min(len(data) - o, hi) if cut is None else cut) and fp == x


def test_mask_bits():
    assert all(m.bit_count() == i for i, m in C.MASKS.items())


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        C.validate(32, 8192, 32768)
    with pytest.raises(ValueError):
        C.validate(8192, 4096, 32768)


def test_udfs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("abc",), ("",), (None,)], "t string").select("t", F.encode("t", "UTF-8").alias("b"))
    rows = df.select("t", u64.fnv1a64("b").alias("f"), u64.adler32("b").alias("a"), u64.crc32(F.col("b")).alias("c"), u64.sha256(F.col("b")).alias("s")).collect()
    assert rows[0].f % (1 << 64) == u64.fnv1a(b"abc") and rows[0].a == zlib.adler32(b"abc")
    assert rows[0].c == zlib.crc32(b"abc") and rows[0].s == hashlib.sha256(b"abc").hexdigest()
    assert rows[2].f is None and rows[2].a is None
    a, b = b"\x00" * 31 + b"\xff", b"\xf0" * 32
    d = spark.createDataFrame([(a, b)], "a binary, b binary").select(u64.hamming_bytes(F.col("a"), F.col("b"), 32).alias("h")).first()
    assert d.h == sum((x ^ y).bit_count() for x, y in zip(a, b))

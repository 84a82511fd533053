import struct

import numpy as np
import pytest

from siltstone.functions.raster import basis
from siltstone.sources import jpeg
from siltstone.sources.errors import Refused

#: One complete code: every symbol of eight bits, so any stream can be written without statistics.
SYMBOLS = bytes(range(0, 255))


class Writer:
    def __init__(self):
        self.bits = ""

    def code(self, s):
        self.bits += format(SYMBOLS.index(s), "08b")

    def value(self, v):
        n = abs(v).bit_length()
        self.bits += format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""
        return self

    def done(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return int(b or "0", 2).to_bytes(len(b) // 8, "big").replace(b"\xff", b"\xff\0")


def segment(m, body):
    return bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body


def coefficients(plane):
    h, w = plane.shape
    p = np.pad(plane.astype(float), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    b = p.reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    m = basis(8)
    return np.rint(m @ b @ m.T).astype(int)


def put_ac(w, z, lo, hi, low=0):
    run = 0
    for k in range(lo, hi + 1):
        v = int(np.sign(z[k])) * (abs(int(z[k])) >> low)
        if not v:
            run += 1
            continue
        while run > 15:
            w.code(0xF0)
            run -= 16
        w.code(run << 4 | abs(v).bit_length())
        w.value(v)
        run = 0
    if run:
        w.code(0)


def encode(planes, progressive=False, restart=0, factors=None):
    h, w = planes[0].shape
    factors = factors or [(1, 1)] * len(planes)
    head = b"\xff\xd8" + segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(factors)))
    counts = bytes([0] * 7 + [255] + [0] * 8)
    head += segment(0xC4, b"\x00" + counts + SYMBOLS) + segment(0xC4, b"\x10" + counts + SYMBOLS)
    if restart:
        head += segment(0xDD, struct.pack(">H", restart))
    coef = [coefficients(p) for p in planes]
    sos = lambda ids, lo, hi, s: segment(0xDA, bytes([len(ids)]) + b"".join(bytes([i + 1, 0]) for i in ids) + bytes([lo, hi, s]))
    flat = [c.reshape(-1, 64)[:, jpeg.ZIGZAG] for c in coef]
    if not progressive:
        out, part, k, last = [], Writer(), 0, [0] * len(planes)
        fy, fx = max(b for _, b in factors), max(a for a, _ in factors)
        for my in range(-(-h // (8 * fy))):
            for mx in range(-(-w // (8 * fx))):
                if restart and k and k % restart == 0:
                    out.append(part.done() + bytes([0xFF, 0xD0 + (k // restart - 1) % 8]))
                    part, last = Writer(), [0] * len(planes)
                for i, (a, b) in enumerate(factors):
                    for y in range(b):
                        for x in range(a):
                            cy, cx = min(my * b + y, coef[i].shape[0] - 1), min(mx * a + x, coef[i].shape[1] - 1)
                            z = coef[i][cy, cx].ravel()[jpeg.ZIGZAG]
                            d = int(z[0]) - last[i]
                            last[i] = int(z[0])
                            part.code(abs(d).bit_length())
                            part.value(d)
                            put_ac(part, z, 1, 63)
                k += 1
        return head + sos(range(len(planes)), 0, 63, 0) + b"".join(out) + part.done() + b"\xff\xd9"
    w1, last = Writer(), 0
    z = flat[0]
    for b in z:  # DC without its last bit
        d = (int(b[0]) >> 1) - last
        last = int(b[0]) >> 1
        w1.code(abs(d).bit_length())
        w1.value(d)
    body = sos([0], 0, 0, 0x01) + w1.done()
    w2 = Writer()
    for b in z:
        put_ac(w2, b, 1, 63, 1)
    body += sos([0], 1, 63, 0x01) + w2.done()
    w3 = Writer()
    w3.bits = "".join(str(int(b[0]) & 1) for b in z)
    body += sos([0], 0, 0, 0x10) + w3.done()
    w4 = Writer()  # refinement of all other coefficients
    for b in z:
        pending, run = "", 0
        for k in range(1, 64):
            v = abs(int(b[k]))
            if v > 1:
                pending += str(v & 1)
            elif v == 1:
                w4.code(run << 4 | 1)
                w4.bits += ("1" if b[k] > 0 else "0") + pending
                pending, run = "", 0
            else:
                run += 1
                if run == 16:
                    w4.code(0xF0)
                    w4.bits += pending
                    pending, run = "", 0
        if run or pending:
            w4.code(0)
            w4.bits += pending
    return head + body + sos([0], 1, 63, 0x10) + w4.done() + b"\xff\xd9"


rng = np.random.default_rng(3)
GRAY = np.clip(np.add.outer(np.arange(29) * 5, np.arange(21) * 3) + rng.integers(-20, 20, (29, 21)), 0, 255).astype(np.uint8)


def close(a, b, most=2):
    return a.shape == b.shape and np.abs(a.astype(int) - b.astype(int)).max() <= most


@pytest.mark.parametrize("restart", [0, 2])
def test_baseline_gray(restart):
    assert close(jpeg.decode(encode([GRAY], restart=restart)), GRAY)


def test_progressive_equals_baseline():
    assert (jpeg.decode(encode([GRAY], True)) == jpeg.decode(encode([GRAY]))).all()


def test_colour_and_subsampling():
    cb, cr = np.full(GRAY.shape, 90, np.uint8), np.full(GRAY.shape, 170, np.uint8)
    full = jpeg.decode(encode([GRAY, cb, cr]))
    y = jpeg.decode(encode([GRAY])).astype(int)
    assert full.shape == (29, 21, 3) and (full[:, :, 0] == np.clip(y + ((91881 * 42 + 32768) >> 16), 0, 255)).all()
    for f in ((2, 2), (2, 1), (1, 2)):
        size = (-(-29 // f[1]), -(-21 // f[0]))
        sub = jpeg.decode(encode([GRAY, np.full(size, 90, np.uint8), np.full(size, 170, np.uint8)], factors=[f, (1, 1), (1, 1)]))
        assert close(sub, full, 3)


def test_transform_is_the_cosine_transform():
    c = rng.integers(-60, 60, (50, 8, 8))
    m = basis(8)
    assert np.abs(jpeg.inverse(c).astype(float) - np.clip(np.rint(m.T @ c @ m) + 128, 0, 255)).max() <= 1


def test_refusals():
    good = encode([GRAY])
    for data, kind in ((good[:60], "Truncated"), (b"xx", "InvalidMagic"), (good.replace(b"\xff\xc0", b"\xff\xc9", 1), "Unsupported"), (good[:-30], "Truncated")):
        with pytest.raises(Refused) as e:
            jpeg.decode(data)
        assert e.value.kind == kind

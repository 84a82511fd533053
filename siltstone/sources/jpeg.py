"""JPEG: baseline, extended and progressive Huffman streams of 8 bits, one or three components.

The inverse transform is the usual 13-bit integer one. Its one-dimensional pass is linear before
its rounding, so it is one integer matrix, and all blocks of a component go through two products.
"""

from __future__ import annotations

import numpy as np

from siltstone.sources.errors import Refused, bad, truncated, unsupported

MAX_PIXELS = 1 << 28
# Zigzag order (built by diagonals), constants of the integer transform and of the colour conversion.
ZIGZAG = np.array([y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
C = {"0.298": 2446, "0.390": 3196, "0.541": 4433, "0.765": 6270, "0.899": 7373, "1.175": 9633, "1.501": 12299, "1.847": 15137, "1.961": 16069, "2.053": 16819, "2.562": 20995, "3.072": 25172}
RED, BLUE, GREEN_B, GREEN_R = 91881, 116130, 22554, 46802
ARITHMETIC = {0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


def _pass_matrix() -> np.ndarray:
    """Outputs by inputs, scaled by 2^13."""
    e = np.eye(8, dtype=np.int64)
    even = {0: e[0] << 13, 4: e[4] << 13}
    turn = C["0.541"] * (e[2] + e[6])
    low, high = turn - C["1.847"] * e[6], turn + C["0.765"] * e[2]
    tops = [even[0] + even[4] + high, even[0] - even[4] + low, even[0] - even[4] - low, even[0] + even[4] - high]
    both = C["1.175"] * (e[1] + e[3] + e[5] + e[7])
    a, b = both - C["1.961"] * (e[3] + e[7]), both - C["0.390"] * (e[1] + e[5])
    c, d = -C["0.899"] * (e[1] + e[7]), -C["2.562"] * (e[3] + e[5])
    odds = [C["1.501"] * e[1] + c + b, C["3.072"] * e[3] + d + a, C["2.053"] * e[5] + d + b, C["0.298"] * e[7] + c + a]
    half = [(t + o, t - o) for t, o in zip(tops, odds, strict=True)]
    return np.array([p for p, _ in half] + [m for _, m in reversed(half)])


PASS = _pass_matrix()


def inverse(blocks: np.ndarray) -> np.ndarray:
    """Dequantised (n, 8, 8) coefficients to samples 0 to 255."""
    x = (PASS @ blocks.astype(np.int64) + (1 << 10)) >> 11
    x = (x @ PASS.T + (1 << 17)) >> 18
    return np.clip(x + 128, 0, 255).astype(np.uint8)


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.find: dict[tuple[int, int], int] = {}
        code = at = 0
        for n, c in enumerate(counts, 1):
            for _ in range(c):
                if code >> n:
                    raise bad("Huffman table")
                self.find[n, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        # All codes of up to eight bits at once.
        self.fast = [None] * 256
        for (n, c), s in self.find.items():
            if n <= 8:
                for i in range(1 << (8 - n)):
                    self.fast[c << (8 - n) | i] = (n, s)


class Bits:
    """The entropy-coded bytes of a scan; stuffed zeros are dropped, markers end it."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.word, self.n = data, at, 0, 0

    def _more(self) -> None:
        if self.at >= len(self.data):
            raise truncated("scan")
        b = self.data[self.at]
        if b == 0xFF:
            if self.data[self.at + 1 : self.at + 2] != b"\0":
                self.word, self.n = self.word << 8, self.n + 8  # a marker: zeros from here on
                return
            self.at += 1
        self.at += 1
        self.word, self.n = self.word << 8 | b, self.n + 8

    def get(self, n: int) -> int:
        while self.n < n:
            self._more()
        self.n -= n
        v = self.word >> self.n
        self.word &= (1 << self.n) - 1
        return v

    def value(self, n: int) -> int:
        v = self.get(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, t: Huffman) -> int:
        while self.n < 8:
            self._more()
        hit = t.fast[self.word >> (self.n - 8) & 255]
        if hit:
            self.n -= hit[0]
            self.word &= (1 << self.n) - 1
            return hit[1]
        code = self.get(8)
        for n in range(9, 17):
            code = code << 1 | self.get(1)
            if (n, code) in t.find:
                return t.find[n, code]
        raise bad("Huffman code")

    def restart(self, k: int) -> None:
        self.word = self.n = 0
        while self.data[self.at : self.at + 1] == b"\xff" and self.data[self.at + 1 : self.at + 2] == b"\xff":
            self.at += 1
        if self.data[self.at : self.at + 2] != bytes([0xFF, 0xD0 + k % 8]):
            raise bad("restart marker")
        self.at += 2


class Component:
    def __init__(self, ident: int, h: int, v: int, q: int):
        self.ident, self.h, self.v, self.q = ident, h, v, q


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.quant, self.dc, self.ac = data, {}, {}, {}
        self.parts: list[Component] = []
        self.interval, self.adobe, self.progressive, self.scans = 0, None, False, 0

    def decode(self) -> np.ndarray:
        d = self.data
        if d[:2] != b"\xff\xd8":
            raise Refused("InvalidMagic", "jpeg")
        at = 2
        while True:
            at = d.find(b"\xff", at)
            while at >= 0 and d[at + 1 : at + 2] == b"\xff":
                at += 1
            if at < 0 or at + 2 > len(d):
                raise truncated("marker")
            m, at = d[at + 1], at + 2
            if m == 0xD9:
                break
            if m in (0, 1) or 0xD0 <= m <= 0xD7:
                continue
            n = int.from_bytes(d[at : at + 2], "big")
            body = d[at + 2 : at + n]
            if n < 2 or len(body) < n - 2:
                raise truncated("segment")
            at += n
            if m == 0xDB:
                self._quant(body)
            elif m == 0xC4:
                self._tables(body)
            elif m in (0xC0, 0xC1, 0xC2):
                self.progressive = m == 0xC2
                self._frame(body)
            elif m in ARITHMETIC:
                raise unsupported("arithmetic coding")
            elif 0xC3 <= m <= 0xC7 or m == 0xC8:
                raise unsupported("lossless or differential frames")
            elif m == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif m == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif m == 0xDA:
                at = self._scan(body, at)
        if not self.scans:
            raise bad("no scan")
        return self._image()

    def _quant(self, b: bytes) -> None:
        while b:
            wide, size = b[0] >> 4, 128 if b[0] >> 4 else 64
            if wide > 1 or len(b) <= size:
                raise bad("quantisation table")
            t = np.zeros(64, np.int64)
            t[ZIGZAG] = np.frombuffer(b[1 : 1 + size], ">u2" if wide else np.uint8)
            self.quant[b[0] & 15], b = t, b[1 + size :]

    def _tables(self, b: bytes) -> None:
        while b:
            n = sum(b[1:17])
            if len(b) < 17 + n or b[0] >> 4 > 1:
                raise bad("Huffman table")
            (self.ac if b[0] >> 4 else self.dc)[b[0] & 15] = Huffman(b[1:17], b[17 : 17 + n])
            b = b[17 + n :]

    def _frame(self, b: bytes) -> None:
        if self.parts:
            raise bad("second frame")
        if b[0] != 8:
            raise unsupported("sample precision")
        self.height, self.width = int.from_bytes(b[1:3], "big"), int.from_bytes(b[3:5], "big")
        if b[5] == 4:
            raise unsupported("four components")
        if not self.height or not self.width or b[5] not in (1, 3) or len(b) < 6 + 3 * b[5]:
            raise bad("frame")
        if self.width * self.height > MAX_PIXELS:
            raise Refused("TooLarge", "raster")
        self.parts = [Component(b[i], b[i + 1] >> 4, b[i + 1] & 15, b[i + 2]) for i in range(6, 6 + 3 * b[5], 3)]
        if any(not 1 <= x <= 2 for c in self.parts for x in (c.h, c.v)):
            raise unsupported("sampling factors")
        self.hmax, self.vmax = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.parts:
            c.w, c.height = -(-self.width * c.h // self.hmax), -(-self.height * c.v // self.vmax)
            c.bw, c.bh = -(-c.w // 8), -(-c.height // 8)
            c.line = self.across * c.h
            c.blocks = [[0] * 64 for _ in range(c.line * self.down * c.v)]

    def _scan(self, b: bytes, at: int) -> int:
        if not self.parts:
            raise bad("scan before its frame")
        if self.scans and not self.progressive:
            raise bad("second scan")
        self.scans += 1
        chosen = []
        for i in range(b[0]):
            c = next((c for c in self.parts if c.ident == b[1 + 2 * i]), None)
            if c is None:
                raise bad("scan component")
            c.dt, c.at = self.dc.get(b[2 + 2 * i] >> 4), self.ac.get(b[2 + 2 * i] & 15)
            chosen.append(c)
        lo, hi, shift = b[1 + 2 * b[0] : 4 + 2 * b[0]]
        high, low = shift >> 4, shift & 15
        if not self.progressive:
            lo, hi, high, low = 0, 63, 0, 0
        if hi > 63 or lo > hi or self.progressive and (lo == 0) != (hi == 0) or lo and len(chosen) != 1:
            raise bad("scan parameters")
        bits = Bits(self.data, at)
        self.run = 0
        step = self._step(lo, hi, high, low)
        if len(chosen) == 1:
            c = chosen[0]
            units = [[(c, y * c.line + x)] for y in range(c.bh) for x in range(c.bw)]
        else:
            units = ([(c, (my * c.v + y) * c.line + mx * c.h + x) for c in chosen for y in range(c.v) for x in range(c.h)] for my in range(self.down) for mx in range(self.across))
        for c in chosen:
            c.last = 0
        for k, unit in enumerate(units):
            if self.interval and k and k % self.interval == 0:
                bits.restart(k // self.interval - 1)
                self.run = 0
                for c in chosen:
                    c.last = 0
            for c, i in unit:
                step(bits, c, c.blocks[i])
        return bits.at

    def _step(self, lo: int, hi: int, high: int, low: int):
        need = lambda t: t if t is not None else (_ for _ in ()).throw(bad("missing Huffman table"))

        def first_dc(bits, c, block):
            c.last += bits.value(bits.symbol(need(c.dt)))
            block[0] = c.last << low

        def more_dc(bits, c, block):
            block[0] |= bits.get(1) << low

        def sequential(bits, c, block):
            first_dc(bits, c, block)
            first_ac(bits, c, block)

        def first_ac(bits, c, block):
            if self.run:
                self.run -= 1
                return
            k, table = max(1, lo), need(c.at)
            while k <= hi:
                s = bits.symbol(table)
                zeros, size = s >> 4, s & 15
                if size:
                    k = min(k + zeros, 63)
                    block[ZIGZAG[k]] = bits.value(size) << low
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    if self.progressive:
                        self.run = (1 << zeros) + (bits.get(zeros) if zeros else 0) - 1
                    return

        def refine(bits, block, i):
            if bits.get(1) and not abs(block[i]) & 1 << low:
                block[i] += (1 << low) if block[i] > 0 else -(1 << low)

        def more_ac(bits, c, block):
            k = lo
            if not self.run:
                table = need(c.at)
                while k <= hi:
                    s = bits.symbol(table)
                    zeros, size, new = s >> 4, s & 15, 0
                    if size:
                        new = (1 << low) if bits.get(1) else -(1 << low)
                    elif zeros < 15:
                        self.run = (1 << zeros) + (bits.get(zeros) if zeros else 0)
                        break
                    while k <= hi:
                        i = ZIGZAG[k]
                        if block[i]:
                            refine(bits, block, i)
                        elif not zeros:
                            if new:
                                block[i] = new
                            k += 1
                            break
                        else:
                            zeros -= 1
                        k += 1
            if self.run:
                for j in range(k, hi + 1):
                    if block[ZIGZAG[j]]:
                        refine(bits, block, ZIGZAG[j])
                self.run -= 1

        if not self.progressive:
            return sequential
        if lo == 0:
            return more_dc if high else first_dc
        return more_ac if high else first_ac

    def _plane(self, c: Component) -> np.ndarray:
        if c.q not in self.quant:
            raise bad("missing quantisation table")
        x = inverse((np.array(c.blocks, np.int64) * self.quant[c.q]).reshape(-1, 8, 8))
        rows = len(c.blocks) // c.line
        return x.reshape(rows, c.line, 8, 8).swapaxes(1, 2).reshape(rows * 8, c.line * 8)[: c.height, : c.w]

    def _image(self) -> np.ndarray:
        planes = [self._full(self._plane(c), self.hmax // c.h, self.vmax // c.v) for c in self.parts]
        if len(planes) == 1:
            return planes[0]
        y, b, r = (p.astype(np.int64) for p in planes)
        if self.adobe == 0 or self.adobe is None and bytes(c.ident for c in self.parts) == b"RGB":
            return np.dstack(planes)
        b, r = b - 128, r - 128
        out = (y + ((RED * r + 32768) >> 16), y + ((-GREEN_B * b - GREEN_R * r + 32768) >> 16), y + ((BLUE * b + 32768) >> 16))
        return np.clip(np.dstack(out), 0, 255).astype(np.uint8)

    def _full(self, p: np.ndarray, fx: int, fy: int) -> np.ndarray:
        """Chroma at full size: smooth doubling for more than two columns, else repetition."""
        if fx == 1 and fy == 1:
            return p
        x = p.astype(np.int64)
        if p.shape[1] <= 2 or fx == 1 and fy == 1:
            return np.repeat(np.repeat(p, fy, 0), fx, 1)[: self.height, : self.width]
        if fy == 2:
            up, down = np.vstack((x[:1], x[:-1])), np.vstack((x[1:], x[-1:]))
            rows = np.stack((3 * x + up, 3 * x + down), 1).reshape(-1, x.shape[1])
            if fx == 1:
                bias = np.tile([1, 2], len(x))[:, None]
                return ((rows + bias) >> 2).astype(np.uint8)[: self.height]
            x, scale, biases, edge = rows, 4, (8, 7), 4
        else:
            scale, biases, edge = 2, (1, 2), 4
        left, right = np.hstack((x[:, :1], x[:, :-1])), np.hstack((x[:, 1:], x[:, -1:]))
        out = np.stack(((3 * x + left + biases[0]) >> scale, (3 * x + right + biases[1]) >> scale), 2).reshape(len(x), -1)
        if scale == 2:
            out[:, 0], out[:, -1] = x[:, 0], x[:, -1]
        else:
            out[:, 0], out[:, -1] = (x[:, 0] * edge + 8) >> 4, (x[:, -1] * edge + 7) >> 4
        return out.astype(np.uint8)[: self.height, : self.width]


def decode(data: bytes) -> np.ndarray:
    """(h, w) gray or (h, w, 3)."""
    return Decoder(data).decode()

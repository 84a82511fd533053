"""Landmark votes of many queries against many items at once.

A vote is a pair of landmarks of one band; it falls on the difference of their times. Where bands are few and times
short, all offsets of a block of pairs come from products of Fourier coefficients, which are matrix products; the
rounding error has a proven bound below one half, so counts are exact. Elsewhere landmarks meet one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Queries and items of a block, pairs whose offsets are ranked at once, votes that are held at once.
QUERIES, ITEMS, RANKED, HELD = 128, 512, 2048, 1 << 20
#: Offsets and coefficients of a row up to which products are tried, bytes of what is held of the queries, items or pairs of a block.
OFFSETS, COEFFICIENTS, BLOCK = 1024, 1 << 15, 1 << 26
#: One vote that is looked up and sorted costs as much as this many operations of a product.
LOOKUP = 600


class Side(NamedTuple):
    """Landmarks (row, t, f) of ``n`` rows, ``row`` ascending, and those without a time as (row, f)."""

    n: int
    row: np.ndarray
    t: np.ndarray
    f: np.ndarray
    void_row: np.ndarray
    void_f: np.ndarray

    def part(self, lo: int, hi: int) -> Side:
        a, b = np.searchsorted(self.row, (lo, hi))
        c, d = np.searchsorted(self.void_row, (lo, hi))
        return Side(hi - lo, self.row[a:b] - lo, self.t[a:b], self.f[a:b], self.void_row[c:d] - lo, self.void_f[c:d])

    def within(self, bands: np.ndarray) -> Side:
        """Bands by their number in ``bands``, without all others."""

        def number(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(bands, f), len(bands) - 1)
            return at, bands[at] == f

        (at, own), (void_at, void_own) = number(self.f), number(self.void_f)
        return Side(self.n, self.row[own], self.t[own], at[own], self.void_row[void_own], void_at[void_own])


def side(n: int, row: np.ndarray, t: np.ndarray, f: np.ndarray, void: np.ndarray) -> Side:
    return Side(n, row[~void], t[~void], f[~void], row[void], f[void])


def tile_votes(q: Side, i: Side, at_least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, item row, votes, offset, offset is known) of the pairs with ``at_least`` so many votes."""
    bands = np.intersect1d(np.concatenate((q.f, q.void_f)), np.concatenate((i.f, i.void_f)))
    if not len(bands):
        return
    q, i, at_least = q.within(bands), i.within(bands), max(1, at_least)
    plan = _Products.of(q, i, len(bands))
    some = plan.rows(q.n) if plan else q.n
    for b in range(0, q.n, some):
        part = q.part(b, min(b + some, q.n))
        if plan:
            plan.take(part)
        step = plan.rows(ITEMS) if plan else ITEMS
        for a in range(0, i.n, step):
            items = i.part(a, min(a + step, i.n))
            for rows, v, own, d in plan.votes(items) if plan else _lookups(part, items):
                known = np.ones(v.size, bool)
                if len(part.void_f) or len(items.void_f):
                    lost = _meetings(part.part(rows.start, rows.stop), items, len(bands)).ravel()
                    known = lost <= own
                    v = np.where(known, v, lost)
                hit = np.flatnonzero(v >= at_least)
                yield b + rows.start + hit // items.n, a + hit % items.n, v[hit], d[hit], known[hit]


def _meetings(q: Side, i: Side, bands: int) -> np.ndarray:
    """(queries, items): meetings of landmarks of which one has no time."""
    void = lambda s: np.bincount(s.void_row * bands + s.void_f, minlength=s.n * bands).reshape(s.n, bands)
    qt, it = _counts(q, bands), _counts(i, bands)
    qv, iv = void(q), void(i)
    return (qt + qv) @ iv.T + qv @ it.T


def _counts(s: Side, bands: int) -> np.ndarray:
    return np.bincount(s.row * bands + s.f, minlength=s.n * bands).reshape(s.n, bands)


def _lookups(q: Side, i: Side) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, votes, votes at the offset itself, offset), one query at a time."""
    order = np.argsort(i.f, kind="stable")
    t, f, row = i.t[order], i.f[order], i.row[order]
    ends = np.searchsorted(q.row, np.arange(q.n + 1))
    for k in range(q.n):
        tq, fq = q.t[ends[k] : ends[k + 1]], q.f[ends[k] : ends[k + 1]]
        lo = np.searchsorted(f, fq, "left")
        n = np.searchsorted(f, fq, "right") - lo
        upto = np.concatenate(([0], np.cumsum(n)))
        sums, d, item = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + HELD, "right")) - 1)
            m = n[at:to]
            hit = np.repeat(lo[at:to] - (upto[at:to] - upto[at]), m) + np.arange(m.sum())
            new_d, new_item = np.repeat(tq[at:to], m) - t[hit], row[hit]
            d, item, sums = _merged(np.concatenate((d, new_d)), np.concatenate((item, new_item)), np.concatenate((sums, np.ones(len(hit), np.int64))))
            at = to
        votes, own, offset = (np.zeros(i.n, np.int64) for _ in range(3))
        if len(d):
            near = sums.copy()
            side_by_side = (item[1:] == item[:-1]) & (d[1:] - d[:-1] == 1)
            near[1:] += np.where(side_by_side, sums[:-1], 0)
            near[:-1] += np.where(side_by_side, sums[1:], 0)
            best = np.lexsort((d, -sums, item))
            best = best[np.concatenate(([True], item[best][1:] != item[best][:-1]))]
            votes[item[best]], own[item[best]], offset[item[best]] = near[best], sums[best], d[best]
        yield slice(k, k + 1), votes, own, offset


def _merged(d: np.ndarray, item: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (item, d) as one, in this order, their sums added."""
    order = np.lexsort((d, item))
    d, item, sums = d[order], item[order], sums[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(d)), bool), (item[1:] != item[:-1]) | (d[1:] != d[:-1]))))
    return d[first], item[first], np.add.reduceat(sums, first) if len(first) else sums


class _Products:
    """Votes at every offset as an inverse Fourier transform of sums over the bands."""

    @classmethod
    def of(cls, q: Side, i: Side, bands: int) -> _Products | None:
        """None where lookups cost less or counts could be inexact."""
        if not len(q.t) or not len(i.t):
            return None
        base, span_q, span_i = (int(q.t.min()), int(i.t.min())), int(q.t.max()) - int(q.t.min()) + 1, int(i.t.max()) - int(i.t.min()) + 1
        n = span_q + span_i - 1
        k = n // 2 + 1
        met = int(np.bincount(q.f, minlength=bands).astype(object) @ np.bincount(i.f, minlength=bands).astype(object))
        if n > OFFSETS or bands * k > COEFFICIENTS or (8 * bands + 4 * n) * k * q.n * i.n > LOOKUP * met:
            return None
        # No pair has more votes than this (Cauchy-Schwarz over the counts of bands).
        most = np.sqrt(np.square(_counts(q, bands).astype(float)).sum(1).max() * np.square(_counts(i, bands).astype(float)).sum(1).max())
        for kind, unit in ((np.float32, 2.0**-24), (np.float64, 2.0**-53)):
            # Error of sums of products over the bands and over the coefficients, of products and of casts.
            if most * unit * (3 * bands + 2 * k + 6) < 0.4 and most * (n + 2) * unit < 0.5:
                return cls(base, (span_q, span_i), bands, kind)
        return None

    def __init__(self, base: tuple[int, int], span: tuple[int, int], bands: int, kind: type) -> None:
        self.base, self.span, self.bands, self.kind = base, span, bands, kind
        self.n = n = span[0] + span[1] - 1
        k = np.arange(n // 2 + 1)
        self.wave = np.exp(-2j * np.pi * (np.arange(max(span))[:, None] * k % n) / n)
        # Rows: offsets ascending between two empty ones; columns: real and imaginary parts of the coefficients.
        turn = 2 * np.pi * ((np.arange(n) - span[1] + 1)[:, None] * k % n) / n
        weight = np.where((k == 0) | (2 * k == n), 1.0, 2.0) / n
        back = np.stack((weight * np.cos(turn), -weight * np.sin(turn)), 2).reshape(n, -1)
        self.back = np.pad(back, ((1, 1), (0, 0))).astype(kind)
        self.rank = np.arange(n + 2, 0, -1).astype(kind)[:, None] - 1

    def rows(self, most: int) -> int:
        """As many rows as their coefficients fit a block, ``most`` at most."""
        return max(1, min(most, BLOCK // (4 * np.dtype(self.kind).itemsize * self.bands * len(self.wave[0]))))

    def _coefficients(self, s: Side, which: int) -> np.ndarray:
        """(coefficients, rows, bands)"""
        span = self.span[which]
        grid = np.bincount((s.row * self.bands + s.f) * span + (s.t - self.base[which]), minlength=s.n * self.bands * span)
        c = grid.reshape(-1, span).astype(float) @ self.wave[:span].view(float).reshape(span, -1)
        return np.moveaxis(c.view(complex).reshape(s.n, self.bands, -1), 2, 0)

    def take(self, q: Side) -> None:
        """The queries of the next ``votes``."""
        width = BLOCK // (2 * np.dtype(self.kind).itemsize * len(self.wave[0]) * ITEMS)
        step = max(1, min(QUERIES, width))
        self.blocks = []
        for a in range(0, q.n, step):
            rows, f = slice(a, min(a + step, q.n)), self.bands
            m = rows.stop - a
            c = self._coefficients(q.part(a, rows.stop), 0)
            out = np.empty((len(c), 2 * m, 2 * f), self.kind)
            out[:, :m, :f], out[:, :m, f:], out[:, m:, :f], out[:, m:, f:] = c.real, c.imag, c.imag, -c.real
            self.blocks.append((rows, out))

    def votes(self, i: Side) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(query rows, votes, votes at the offset itself, offset) of all queries and these items."""
        c = self._coefficients(i, 1)
        items = np.empty((len(c), 2 * self.bands, i.n), self.kind)
        items[:, : self.bands], items[:, self.bands :] = c.real.transpose(0, 2, 1), c.imag.transpose(0, 2, 1)
        del c
        low, n = self.base[0] - self.base[1] - self.span[1], self.n + 2
        room = np.empty(max(len(q) * len(q[0]) for _, q in self.blocks) * i.n, self.kind)
        for rows, q in self.blocks:
            out = room[: len(q) * len(q[0]) * i.n].reshape(len(q), -1, i.n)
            sums = np.matmul(q, items, out=out).reshape(2 * len(q), -1)
            votes, own, offset = (np.zeros(sums.shape[1], np.int64) for _ in range(3))
            for a in range(0, sums.shape[1], RANKED):
                v = self.back @ sums[:, a : a + RANKED]
                np.rint(v, out=v)
                # The most votes and, among equals, the smallest offset have the greatest key.
                key = v * n
                key += self.rank
                key = key.max(0).astype(np.int64)
                best, at = key // n, n - 1 - key % n
                pair = np.flatnonzero(best)
                at = at[pair]
                cut = slice(a, a + RANKED)
                own[cut], offset[a + pair] = best, at + low
                votes[a + pair] = v[at, pair] + v[at - 1, pair] + v[at + 1, pair]
            yield rows, votes, own, offset

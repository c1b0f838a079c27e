"""An R-tree over count vectors, joined with itself under a bound on shared counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points of a leaf, and children of an inner node.
FAN = 16


class CountTree:
    """Points are vectors of counts; a node keeps the maximum of each coordinate and its range of sizes.

    Of two sets whose elements are hashed into the same groups, the
    intersection has at most the sum over groups of the smaller count. With a
    node's maxima in place of a point's counts, the same sum bounds every
    point below the node.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, num: int, den: int):
        """num / den: the Jaccard similarity that a pair must reach."""
        self.num, self.den = num, den
        self.order = self._tiles(counts, sizes)
        self.counts, self.sizes = counts[self.order].astype(np.int32), sizes[self.order].astype(np.int64)
        self.levels = []
        most, low, high = self.counts, self.sizes, self.sizes
        while True:
            at = np.arange(0, len(most), FAN)
            most, low, high = np.maximum.reduceat(most, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((most, low, high))
            if len(most) == 1:
                break

    @staticmethod
    def _tiles(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile order: by size in slabs, within a slab by the widest coordinates."""
        order = np.argsort(sizes, kind="stable")
        slab = max(FAN, int(np.ceil(len(order) / max(1.0, np.sqrt(len(order) / FAN)))))
        wide = np.argsort(-counts.std(axis=0), kind="stable")[:3]
        out = []
        for k in range(0, len(order), slab):
            part = order[k : k + slab]
            out.append(part[np.lexsort(counts[part][:, wide].T)])
        return np.concatenate(out) if out else order

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least intersection of sets of sizes a and b that reaches the similarity."""
        return -(-(self.num * (a + b)) // (self.num + self.den))

    def _may(self, x, y, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (mx, lx, hx), (my, ly, hy) = x, y
        fits = (hx[i] * self.den >= ly[j] * self.num) & (hy[j] * self.den >= lx[i] * self.num)
        k = np.flatnonzero(fits)
        if len(k):
            shared = np.minimum(mx[i[k]], my[j[k]]).sum(axis=1)
            fits[k[shared < self.needed(lx[i[k]], ly[j[k]])]] = False
        return fits

    def pairs(self, block: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs of points that pass the bound at every level, as positions in the given arrays."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        points = (self.counts, self.sizes, self.sizes)
        while stack:
            level, i, j = stack.pop()
            ok = self._may(self.levels[level], self.levels[level], i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            below = len(self.levels[level - 1][0]) if level else len(self.sizes)
            di, dj = np.divmod(np.arange(FAN * FAN), FAN)
            step = max(1, block // (FAN * FAN))
            for k in range(0, len(i), step):
                a = (i[k : k + step, None] * FAN + di).ravel()
                b = (j[k : k + step, None] * FAN + dj).ravel()
                ok = (a < below) & (b < below) & ((a < b) if not level else (a <= b))
                a, b = a[ok], b[ok]
                if level:
                    stack.append((level - 1, a, b))
                elif len(a):
                    ok = self._may(points, points, a, b)
                    if ok.any():
                        yield self.order[a[ok]], self.order[b[ok]]


class Forest:
    """Union by least index with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a < b:
            self.up[b] = a
        else:
            self.up[a] = b
        return True

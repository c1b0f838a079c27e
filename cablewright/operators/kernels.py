"""Sequential algorithms on one site, in NumPy and plain Python. Nothing here imports Spark.

A site is (ids, xy): ids of its points, roots negative, and coordinates as `points` gives them. Edges are
pairs of indices into ids. Ties are broken by length, then by ids, so results don't depend on input order.
"""

from __future__ import annotations

import heapq
import itertools
import math
from fractions import Fraction

import numpy as np

#: Extent within which all tests on whole numbers stay below 2**63.
EXTENT = 28_000
#: Relative errors of the two determinants below in doubles, rounded up (Shewchuk, 1997).
TURN_ERROR, CIRCLE_ERROR = 4e-16, 1.2e-15


def points(xy) -> np.ndarray:
    """Coordinates as 64-bit whole numbers if they are whole and within `EXTENT`, else as doubles; tests on either are exact."""
    xy = np.asarray(xy)
    if not len(xy):
        return xy.reshape(0, 2).astype(np.int64)
    span = max(float(xy[:, k].max()) - float(xy[:, k].min()) for k in (0, 1))
    if span <= EXTENT and (xy == np.rint(xy)).all() and abs(xy).max() < 1 << 52:
        xy = xy.astype(np.int64)
        return xy if abs(xy).max() < 1 << 30 else xy - xy.min(axis=0)
    return xy.astype(np.float64)


def _settled(det, error, exact, *at) -> np.ndarray:
    """det, with what an error as large as given would leave unsure computed exactly."""
    det = np.asarray(det)
    unsure = (np.abs(det) <= error) & (np.asarray(error) > 0)
    if not unsure.any():
        return det
    out, at = np.array(det, float), [np.broadcast_to(x, det.shape + (2,)) for x in at]
    for k in zip(*np.nonzero(unsure), strict=True) if det.ndim else [()]:
        out[k] = float(exact(*([Fraction(float(c)) for c in x[k]] for x in at)))
    return out


def _turn(p, q, r):
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def _circle(a, b, c, d):
    p, q, r = ([x[0] - d[0], x[1] - d[1]] for x in (a, b, c))
    s, t, u = (x[0] * x[0] + x[1] * x[1] for x in (p, q, r))
    return s * (q[0] * r[1] - q[1] * r[0]) - t * (p[0] * r[1] - p[1] * r[0]) + u * (p[0] * q[1] - p[1] * q[0])


def orient(xy: np.ndarray, a, b, c) -> np.ndarray:
    """Positive where a, b, c turn counter-clockwise; the sign is exact."""
    p, q, r = xy[a], xy[b], xy[c]
    left, right = (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]), (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    if xy.dtype != np.float64:
        return left - right
    return _settled(left - right, TURN_ERROR * (np.abs(left) + np.abs(right)), _turn, p, q, r)


def in_circle(xy: np.ndarray, a: int, b: int, c: int, d: np.ndarray) -> np.ndarray:
    """Positive where d lies within the circle of the counter-clockwise triangle abc; the sign is exact."""
    p, q, r = (xy[k] - xy[d] for k in (a, b, c))
    s, t, u = ((v * v).sum(axis=-1) for v in (p, q, r))
    x, y, z = ((m[..., 0] * n[..., 1], m[..., 1] * n[..., 0]) for m, n in ((q, r), (p, r), (p, q)))
    det = s * (x[0] - x[1]) - t * (y[0] - y[1]) + u * (z[0] - z[1])
    if xy.dtype != np.float64:
        return det
    size = sum(w * (np.abs(m) + np.abs(n)) for w, (m, n) in zip((s, t, u), (x, y, z), strict=True))
    return _settled(det, CIRCLE_ERROR * size, _circle, xy[a], xy[b], xy[c], xy[d])


def within_circle(xy: np.ndarray, a: int, b: int, c: int, d: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """As `in_circle`, but never 0 for another point: of four on one circle, the one of least rank counts as lifted out of it.

    rank: of each point, its index if not given. Any subset of the points then has one triangulation, which agrees
    with that of the whole wherever its circles are empty in the whole.
    """
    det = np.asarray(in_circle(xy, a, b, c, d), float)
    rank = np.arange(len(xy)) if rank is None else rank
    for k in np.flatnonzero(det == 0).tolist():
        e = int(d[k])
        if e in (a, b, c):
            continue
        # The determinant's factors of the four lifts, in which it is linear.
        lifts = ((a, orient(xy, e, b, c)), (b, -orient(xy, e, a, c)), (c, orient(xy, e, a, b)), (e, -orient(xy, a, b, c)))
        det[k] = next(np.sign(float(x)) for _, x in sorted(lifts, key=lambda f: rank[f[0]]) if x != 0) * np.finfo(float).tiny
    return det


def apex(xy: np.ndarray, a: int, b: int, among: np.ndarray, rank: np.ndarray | None = None) -> int | None:
    """The point left of ab whose circle through a and b holds no other of `among` that lies there; None if none does."""
    left = among[orient(xy, a, b, among) > 0]
    if not len(left):
        return None
    c = int(left[0])
    while True:
        inside = within_circle(xy, a, b, c, left, rank)
        if not (inside > 0).any():
            return c
        c = int(left[np.argmax(inside)])


def circle(at: np.ndarray, a: int, b: int, c: int) -> tuple[float, float, float]:
    """Centre and radius of a triangle's circle, in doubles, the radius rounded up; infinite where doubles say too little."""
    (px, py), (qx, qy) = (at[b] - at[a]).tolist(), (at[c] - at[a]).tolist()
    d, s, t = 2 * (px * qy - py * qx), px * px + py * py, qx * qx + qy * qy
    if abs(d) <= 1e-9 * max(s, t):
        return 0.0, 0.0, float("inf")
    x, y = (qy * s - py * t) / d, (px * t - qx * s) / d
    return float(at[a][0]) + x, float(at[a][1]) + y, float(np.hypot(x, y)) * (1 + 1e-5)


def _morton(at: np.ndarray) -> np.ndarray:
    """Ranks of points along a curve that keeps near ones together."""
    span = max(float(np.ptp(at, axis=0).max()), 1e-300)
    cell = np.minimum((at - at.min(axis=0)) / span * 65535, 65535).astype(np.int64)
    out = np.zeros(len(at), np.int64)
    for bit in range(16):
        for k in (0, 1):
            out |= (cell[:, k] >> bit & 1) << (2 * bit + k)
    return out


def delaunay(xy: np.ndarray) -> list[tuple[int, int, int]]:
    """Counter-clockwise triangles. Of points that coincide, the last one stands for all.

    Points are put in one after another: the triangles whose circle holds the new one go, and it is joined to the rim of
    what they leave. A rim of the whole counts as triangles with the index `far`. They come in parts
    of twice as many each, near ones after each other, so that the way from the last one to the next is short.
    """
    xy = points(xy)
    n = len(xy)
    if n < 3:
        return []
    order = np.lexsort((xy[:, 1], xy[:, 0]))
    kept = order[np.append((xy[order[1:]] != xy[order[:-1]]).any(axis=1), True)]
    if len(kept) < 3:
        return []
    part = np.zeros(len(kept), int)
    mixed = np.random.default_rng(len(kept)).permutation(len(kept))
    part[mixed] = np.log2(np.arange(1, len(kept) + 1)).astype(int)
    kept = kept[np.lexsort((_morton(xy[kept].astype(float)), part))]
    a, b = int(kept[0]), int(kept[1])
    third = kept[orient(xy, a, b, kept) != 0]
    if not len(third):
        return []
    c = int(third[0])
    if orient(xy, a, b, c) < 0:
        a, b = b, a
    px, py, plain, far, m = xy[:, 0].tolist(), xy[:, 1].tolist(), xy.dtype != np.float64, n, n + 1

    def turn(u: int, v: int, w: int):
        left, right = (px[v] - px[u]) * (py[w] - py[u]), (py[v] - py[u]) * (px[w] - px[u])
        det = left - right
        if plain or abs(det) > TURN_ERROR * (abs(left) + abs(right)):
            return det
        return _turn(*([Fraction(px[k]), Fraction(py[k])] for k in (u, v, w)))

    def holds(u: int, v: int, w: int, d: int) -> bool:
        """Whether the circle of a triangle, or the land beyond a side of the rim, holds d; four on a circle as in `within_circle`."""
        if far in (u, v, w):
            u, v = (u, v) if w == far else (v, w) if u == far else (w, u)
            t = turn(u, v, d)
            return t > 0 or (t == 0 and within(u, v, d))
        x, y = px[d], py[d]
        ax, ay, bx, by, cx, cy = px[u] - x, py[u] - y, px[v] - x, py[v] - y, px[w] - x, py[w] - y
        s, t, r = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        if plain:
            det = s * (bx * cy - by * cx) - t * (ax * cy - ay * cx) + r * (ax * by - ay * bx)
        else:
            e, f, g, h, i, j = bx * cy, by * cx, ax * cy, ay * cx, ax * by, ay * bx
            det = s * (e - f) - t * (g - h) + r * (i - j)
            if abs(det) <= CIRCLE_ERROR * (s * (abs(e) + abs(f)) + t * (abs(g) + abs(h)) + r * (abs(i) + abs(j))):
                det = _circle(*([Fraction(px[k]), Fraction(py[k])] for k in (u, v, w, d)))
        if det:
            return det > 0
        lifts = ((u, turn(d, v, w)), (v, -turn(d, u, w)), (w, turn(d, u, v)), (d, -turn(u, v, w)))
        return next(t for _, t in sorted(lifts) if t) > 0

    def within(u: int, v: int, d: int) -> bool:
        """Whether d, on the line of u and v, lies between them."""
        at = px if abs(px[v] - px[u]) >= abs(py[v] - py[u]) else py
        return min(at[u], at[v]) < at[d] < max(at[u], at[v])

    apex: dict[int, int] = {}  # of a directed side, the point on its left
    for u, v, w in ((a, b, c), (b, a, far), (c, b, far), (a, c, far)):
        apex[u * m + v], apex[v * m + w], apex[w * m + u] = w, u, v
    u, v = a, b
    for d in kept.tolist():
        if d in (a, b, c):
            continue
        # The triangle that it lies in, or a side of the rim that it lies beyond.
        w = apex[u * m + v]
        if w == far:
            u, v = v, u
            w = apex[u * m + v]
        while True:
            for p, q, o in ((u, v, w), (v, w, u), (w, u, v)):
                if turn(p, q, d) < 0:
                    u, v, w = q, p, apex[q * m + p]
                    break
            else:
                break
            if w == far:
                break
        for p, q in ((u, v), (v, w), (w, u)):
            del apex[p * m + q]
        todo, rim = [(u, v), (v, w), (w, u)], []
        while todo:
            p, q = todo.pop()
            o = apex.get(q * m + p)
            if o is None:
                continue
            if holds(q, p, o, d):
                del apex[q * m + p], apex[p * m + o], apex[o * m + q]
                todo += [(p, o), (o, q)]
            else:
                rim.append((p, q))
        for p, q in rim:
            apex[p * m + q], apex[q * m + d], apex[d * m + p] = d, p, q
            if p != far and q != far:
                u, v = p, q
    out = []
    for k, w in apex.items():
        u, v = divmod(k, m)
        if u < v and u < w and v != far and w != far:
            out.append((u, v, w))
    return sorted(out)


def between(xy: np.ndarray, a: int, b: int) -> list[int]:
    """Points on the segment ab other than its ends; whole numbers or doubles of any scale."""
    # On a line, the coordinate that changes more tells the order, exactly.
    x = xy[:, int(np.argmax(np.abs(xy[b] - xy[a])))]
    return np.flatnonzero((orient(xy, a, b, np.arange(len(xy))) == 0) & (x > min(x[a], x[b])) & (x < max(x[a], x[b]))).tolist()


def crosses(xy: np.ndarray, u, v, s, t) -> np.ndarray:
    """Whether segments cross properly: a shared end or a touch is none."""
    sg = lambda a, b, c: np.sign(orient(xy, a, b, c))
    return (sg(u, v, s) * sg(u, v, t) < 0) & (sg(s, t, u) * sg(s, t, v) < 0)


def diagonals(xy: np.ndarray, triangles) -> dict[tuple[int, int], tuple[int, int]]:
    """Side -> diagonal, where the two triangles on a side form a convex quadrilateral."""
    across: dict[tuple[int, int], list[int]] = {}
    for a, b, c in triangles:
        for u, v, w in ((a, b, c), (b, c, a), (c, a, b)):
            across.setdefault((min(u, v), max(u, v)), []).append(w)
    return {e: (min(w), max(w)) for e, w in across.items() if len(w) == 2 and crosses(xy, e[0], e[1], w[0], w[1])}


def length(xy: np.ndarray, u, v) -> np.ndarray:
    d = xy[u] - xy[v]
    return np.sqrt((d * d).sum(axis=-1).astype(float))


def available(xy: np.ndarray) -> list[tuple[int, int]]:
    """Sides of the triangulation and their diagonals."""
    tri = delaunay(xy)
    sides = {(min(u, v), max(u, v)) for t in tri for u, v in itertools.combinations(t, 2)}
    return sorted(sides | set(diagonals(xy, tri).values()))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def spanning_forest(ids, xy: np.ndarray, edges) -> list[tuple[int, int]]:
    """A minimum spanning tree, cut at the longest hop of the way between any two roots."""
    size = lambda e: (float(length(xy, *e)), tuple(sorted((ids[e[0]], ids[e[1]]))))
    u = Union(len(ids))
    rooted = [i < 0 for i in ids]
    out = []
    # Kruskal's rule with components that hold a root kept apart does the cut: the joining edge is the longest of the way.
    for e in sorted(edges, key=size):
        a, b = u.find(e[0]), u.find(e[1])
        if a == b or (rooted[a] and rooted[b]):
            continue
        u.up[b] = a
        rooted[a] = rooted[a] or rooted[b]
        out.append(e)
    return out


def nearest_root(ids, xy: np.ndarray) -> dict[int, tuple[float, int]]:
    """Of each terminal: the distance to the nearest root, and its id; ties go to the least id."""
    roots = [k for k, i in enumerate(ids) if i < 0]
    return {k: min((float(length(xy, k, r)), ids[r]) for r in roots) for k, i in enumerate(ids) if i >= 0}


#: Pairs of segments that are tested at once.
PAIRS = 1 << 21


def _covered(xy: np.ndarray, segments: np.ndarray, low, side: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of a grid that segments go through, as rows (index of the segment, column, row); a bit more at the cells' rims, so that rounding loses none."""
    p, q = xy[segments[:, 0]].astype(float) - low, xy[segments[:, 1]].astype(float) - low
    turn = (p[:, 0] > q[:, 0])[:, None]
    p, q = np.where(turn, q, p) / side, np.where(turn, p, q) / side
    first, last = np.floor(p[:, 0]).astype(np.int64), np.floor(q[:, 0]).astype(np.int64)
    which = np.repeat(np.arange(len(p)), last - first + 1)
    column = np.arange(len(which)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[which]
    p, q, rim = p[which], q[which], 1e-6
    wide = q[:, 0] - p[:, 0]
    slope = np.divide(q[:, 1] - p[:, 1], wide, out=np.zeros(len(wide)), where=wide > 0)
    at = [np.where(wide > 0, p[:, 1] + (x - p[:, 0]) * slope, y) for x, y in ((np.maximum(p[:, 0], column - rim), p[:, 1]), (np.minimum(q[:, 0], column + 1 + rim), q[:, 1]))]
    below, above = np.minimum(p[:, 1], q[:, 1]), np.maximum(p[:, 1], q[:, 1])
    bottom = np.floor(np.clip(np.minimum(*at), below, above) - rim).astype(np.int64)
    top = np.floor(np.clip(np.maximum(*at), below, above) + rim).astype(np.int64)
    k = np.repeat(np.arange(len(which)), top - bottom + 1)
    row = np.arange(len(k)) - np.repeat(np.cumsum(top - bottom + 1) - (top - bottom + 1), top - bottom + 1) + bottom[k]
    return which[k], column[k], row


def _met(xy: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Indices into a and into b, in parts, of segments that cross properly; a pair may come more than once.

    Those that share a cell of a grid are tested, so the work follows the near pairs and not the product of the two.
    """
    if not len(a) or not len(b):
        return
    ends = xy[np.unique(np.concatenate([a.ravel(), b.ravel()]))].astype(float)
    low, span = ends.min(axis=0), np.ptp(ends, axis=0)
    side = max(float(np.sqrt(max(span[0], span[1] / 100) * max(span[1], span[0] / 100) / len(ends))), 1e-300)
    i, x, y = _covered(xy, a, low, side)
    j, z, w = _covered(xy, b, low, side)
    # A cell as one number; rows reach one beyond the grid at either end.
    tall = int(span[1] / side) + 4
    one, other = x * tall + y + 1, z * tall + w + 1
    order = np.argsort(other, kind="stable")
    other, j = other[order], j[order]
    start, stop = np.searchsorted(other, one, "left"), np.searchsorted(other, one, "right")
    meet = stop - start
    done, at = np.concatenate([[0], np.cumsum(meet)]), 0
    while at < len(one):
        # At least one row, whose partners are no more than the segments of b.
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
        m = meet[at:to]
        k = np.repeat(np.arange(at, to), m)
        g = i[k]
        h = j[start[k] + np.arange(len(k)) - np.repeat(np.cumsum(m) - m, m)]
        # Segments with a common end don't cross.
        apart = (a[g, 0] != b[h, 0]) & (a[g, 0] != b[h, 1]) & (a[g, 1] != b[h, 0]) & (a[g, 1] != b[h, 1])
        g, h = g[apart], h[apart]
        if len(g):
            hit = crosses(xy, a[g, 0], a[g, 1], b[h, 0], b[h, 1])
            yield g[hit], h[hit]
        at = to


def crossing_pairs(xy: np.ndarray, a, b) -> np.ndarray:
    """Pairs (index into a, index into b) of segments that cross properly, each once, in ascending order."""
    a, b = np.asarray(a, int).reshape(-1, 2), np.asarray(b, int).reshape(-1, 2)
    found = [np.unique(g * len(b) + h) for g, h in _met(xy, a, b)]
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, int)
    return np.stack(np.divmod(pairs, max(1, len(b))), axis=1)


#: Segments whose cells are listed at once.
SEGMENTS = 1 << 14


def crossed(xy: np.ndarray, a: np.ndarray, b) -> np.ndarray:
    """For each segment of a whether one of b crosses it properly. The longest of b go first: what they cross isn't looked at again."""
    b, out = np.asarray(b, int).reshape(-1, 2), np.zeros(len(a), bool)
    b = b[np.argsort(-length(xy, b[:, 0], b[:, 1]), kind="stable")]
    cuts = [0, *sorted({len(b) >> s for s in (6, 4, 2, 1, 0)} - {0})]
    for first, last in zip(cuts, cuts[1:], strict=False):
        left = np.flatnonzero(~out)
        for k in range(0, len(left), SEGMENTS):
            some = left[k : k + SEGMENTS]
            for g, _ in _met(xy, a[some], b[first:last]):
                out[some[g]] = True
    return out




class Crossed:
    """Which of the segments b cross another one, found by the cells of a grid when it is asked for."""

    def __init__(self, xy: np.ndarray, b: np.ndarray):
        self.xy, self.b = xy, b
        if len(b):
            ends = xy[np.unique(b)].astype(float)
            self.low, span = ends.min(axis=0), np.ptp(ends, axis=0)
            self.side = max(float(np.sqrt(max(span[0], span[1] / 100) * max(span[1], span[0] / 100) / len(ends))), 1e-300)
            self.tall = int(span[1] / self.side) + 4
            which, x, y = _covered(xy, b, self.low, self.side)
            cells = x * self.tall + y + 1
            order = np.argsort(cells, kind="stable")
            self.cells, self.which = cells[order], which[order]

    def by(self, u: int, v: int) -> list[int]:
        """Indices into b of the segments that uv crosses properly, in ascending order."""
        if not len(self.b):
            return []
        # Beyond the grid, cells share numbers with others: a few segments are tested for nothing.
        _, x, y = _covered(self.xy, np.array([[u, v]]), self.low, self.side)
        cells = x * self.tall + y + 1
        start, stop = np.searchsorted(self.cells, cells, "left"), np.searchsorted(self.cells, cells, "right")
        some = np.unique(np.concatenate([self.which[i:j] for i, j in zip(start.tolist(), stop.tolist(), strict=True)]))
        return some[crosses(self.xy, u, v, self.b[some, 0], self.b[some, 1])].tolist()


#: How a subtree's best merge is chosen, by (weight, closeness of the far end to its root, ids): the least weight;
#: of those within 2 % of the least weight the closest; of twentieths of the least weight, then the closest.
RULES = ("weight", "margin", "bins")


def _chosen(options: list[tuple], rule: str):
    """options: (weight, distance of the far end to its root, ids in order, near end, far end)."""
    least = min(o[0] for o in options)
    if rule == "margin":
        return min((o for o in options if o[0] <= 1.02 * least), key=lambda o: (o[1], o[0], *o[2:]))
    if rule == "bins" and least > 0:
        return min(options, key=lambda o: (float(np.rint(20 * o[0] / least)), o[1], o[0], *o[2:]))
    return min(options)


def esau_williams(ids, xy: np.ndarray, edges, capacity: int, *, rule: str = "weight", uncrossed: bool = True, gates_block: bool = False, path: bool = False, rootlust: float = 0.0, blocked=()) -> dict[int, int]:
    """Parents of a capacitated forest, by savings over a star.

    Every terminal starts with a gate to its nearest root. Each subtree has a best merge, chosen by `rule`
    among the edges to other subtrees that fit and are no longer than its gate; the merge of the
    least tradeoff, its length less that of the gate that goes, is made, as long as one isn't positive.
    With `uncrossed` an edge that crosses one made before is out; with `gates_block`, so is one that
    crosses the gate of a full subtree. With `path`, only a subtree's ends are joined. `rootlust` favours
    subtrees far from their root; `blocked` are segments (x, y, x, y) that no edge may cross.
    """
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}")
    xy = np.asarray(xy)
    near = nearest_root(ids, xy)
    at = {i: k for k, i in enumerate(ids)}
    walls = np.array(blocked, float).reshape(-1, 4)
    own = [(u, v) for u, v in edges if ids[u] >= 0 and ids[v] >= 0 and not _hits(xy, u, v, walls)]
    both = np.array(own, int).reshape(-1, 2)
    weight = length(xy, both[:, 0], both[:, 1]).tolist()
    # Asked of the links that are made and of the gates of full subtrees alone: most edges and gates never block any.
    met = Crossed(xy, both) if uncrossed or gates_block else None
    hooks = sorted(near)
    adj: dict[int, dict[int, int]] = {k: {} for k in near}
    for e, (u, v) in enumerate(own):
        adj[u][v] = adj[v][u] = e
    comp = {k: k for k in near}  # by the hook
    members = {k: [k] for k in near}
    tail = {k: k for k in near}
    links: list[tuple[int, int]] = []

    def best(hook: int):
        """(tradeoff, ids, hook, near end, far end) of the merge that gives up this subtree's gate."""
        gate, room = near[hook][0], capacity - len(members[hook])
        limit, options = gate * (1 + rootlust), []
        for u in members[hook] if not path else {hook, tail[hook]}:
            for v, e in adj[u].items():
                other = comp[v]
                if other == hook or len(members[other]) > room or weight[e] > limit or (path and v != tail[other]):
                    continue
                options.append((weight[e], near[v][0], min(ids[u], ids[v]), max(ids[u], ids[v]), u, v))
        if not options:
            return None
        w, _, a, b, u, v = _chosen(options, rule)
        t = w - gate * (1 + rootlust * len(members[hook]) / capacity)
        return (t, a, b, ids[hook], hook, u, v) if t <= 0 else None

    def banned(found) -> set[int]:
        """The subtrees whose edges went."""
        out = set()
        for e in found:
            u, v = own[e]
            if adj[u].pop(v, None) is not None:
                del adj[v][u]
                out |= {comp[u], comp[v]}
        return out

    def full(hook: int) -> set[int]:
        return banned(met.by(hook, at[near[hook][1]])) if gates_block and len(members[hook]) == capacity else set()

    stale = set().union(*(full(h) for h in hooks)) if capacity == 1 else set()
    heap = [o for h in near if (o := best(h))]
    heapq.heapify(heap)
    while heap or stale:
        for h in stale:
            if h in members and (o := best(h)):
                heapq.heappush(heap, o)
        stale = set()
        if not heap:
            break
        top = heapq.heappop(heap)
        hook = top[4]
        if hook not in members:
            continue
        now = best(hook)
        if now != top:
            if now:
                heapq.heappush(heap, now)
            continue
        *_, u, v = top
        e, other = adj[u][v], comp[v]
        links.append((u, v))
        if path:
            tail[other] = tail[hook] if u == hook else hook
        for m in (moved := members.pop(hook)):
            comp[m] = other
        members[other] += moved
        stale = {other, *(comp[w] for m in members[other] for w in adj[m])} | (banned(met.by(u, v)) if uncrossed else set()) | full(other)
    return parents_from(ids, links, {h: near[h][1] for h in members})


class _Nearest:
    """Of one terminal, the nearest terminals that still may be joined, each found when it is asked for: (weight, gate, ids in order, near end, far end)."""

    def __init__(self, u: int):
        self.u, self.beyond, self.count, self.some, self.at = u, -1.0, FIRST // 2, [], 0

    def first(self, ids, xy: np.ndarray, gate: np.ndarray, nodes: np.ndarray, comp: np.ndarray, size: np.ndarray, capacity: int):
        u = self.u
        own, room = comp[u], capacity - size[u]
        while True:
            while self.at < len(self.some):
                v = self.some[self.at][5]
                if comp[v] != own and size[v] <= room:
                    return self.some[self.at]
                # That stays so: subtrees only grow.
                self.at += 1
            m = nodes[(comp[nodes] != own) & (size[nodes] <= room)]
            w = length(xy, m, u)
            m, w = m[w > self.beyond], w[w > self.beyond]
            if not len(m):
                return None
            if len(m) > self.count:
                most = np.partition(w, self.count - 1)[self.count - 1]
                m, w = m[w <= most], w[w <= most]
            self.beyond, self.count, self.at = float(w.max()), 4 * self.count, 0
            self.some = sorted((x, g, min(ids[u], ids[v]), max(ids[u], ids[v]), u, v) for x, g, v in zip(w.tolist(), gate[m].tolist(), m.tolist(), strict=True))


def classic(ids, xy: np.ndarray, capacity: int) -> dict[int, int]:
    """As `esau_williams` by weight over all pairs of terminals, crossings allowed, without a list of the pairs.

    What a subtree's best merge costs can only rise until the subtree itself grows, so merges are looked at again when their turn comes.
    """
    near = nearest_root(ids, xy)
    gate = np.zeros(len(ids))
    for k, (g, _) in near.items():
        gate[k] = g
    nodes = np.array(sorted(near), int)
    comp, size = np.arange(len(ids)), np.ones(len(ids), int)
    members = {k: [k] for k in near}
    lists = {k: _Nearest(k) for k in near}
    links: list[tuple[int, int]] = []

    def best(hook: int):
        if len(members[hook]) >= capacity:
            return None
        o = min((x for u in members[hook] if (x := lists[u].first(ids, xy, gate, nodes, comp, size, capacity))), default=None)
        if o is None or o[0] > near[hook][0]:
            return None
        w, _, a, b, u, v = o
        t = w - near[hook][0]
        return (t, a, b, ids[hook], hook, u, v)

    heap = [o for h in near if (o := best(h))]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        if top[4] not in members:
            continue
        now = best(top[4])
        if now != top:
            if now:
                heapq.heappush(heap, now)
            continue
        # Of equal tradeoffs the least ids are taken, which others may have come to only now.
        same = [top]
        while heap and heap[0][0] == top[0]:
            hook = heapq.heappop(heap)[4]
            if hook in members and hook != top[4] and (o := best(hook)):
                same.append(o)
        first, *rest = sorted(same)
        for o in rest:
            heapq.heappush(heap, o)
        *_, hook, u, v = first
        other = int(comp[v])
        links.append((u, v))
        moved = members.pop(hook)
        members[other] += moved
        comp[moved] = other
        size[members[other]] = len(members[other])
        if o := best(other):
            heapq.heappush(heap, o)
    return parents_from(ids, links, {h: near[h][1] for h in members})


def _hits(xy, u, v, walls: np.ndarray) -> bool:
    if not len(walls):
        return False
    pts = np.concatenate([xy[[u, v]].astype(float), walls.reshape(-1, 2)])
    k = np.arange(len(walls))
    return bool(crosses(pts, 0, 1, 2 + 2 * k, 3 + 2 * k).any())


def parents_from(ids, links, hooks: dict[int, int]) -> dict[int, int]:
    """id -> id of the node fed, by walking the links from each hook (index -> root id)."""
    adj: dict[int, list[int]] = {}
    for u, v in links:
        adj.setdefault(u, []).append(v)
        adj.setdefault(v, []).append(u)
    out = {}
    for h, r in hooks.items():
        out[ids[h]] = r
        todo = [h]
        while todo:
            u = todo.pop()
            for v in adj.get(u, ()):
                if ids[v] not in out:
                    out[ids[v]] = ids[u]
                    todo.append(v)
    return out


def savings_routes(ids, xy: np.ndarray, capacity: int, rounds: int = 50, banned=frozenset(), vehicles: int | None = None) -> list[list[int]]:
    """Open routes from the nearest roots: parallel savings, then 2-opt within and moves between routes. No hop is in `banned`.

    With `vehicles`, routes are joined on to at most so many, or to as few as the savings' ends allow.
    """
    near = nearest_root(ids, xy)
    d = Lengths(xy)
    allowed = lambda r: not banned or not any((min(a, b), max(a, b)) in banned for a, b in zip(r, r[1:], strict=False))
    route = {k: [k] for k in near}
    head = {k: k for k in near}
    free = Free(near, capacity)
    for forced in (False, True) if vehicles else (False,):
        # Forced joins may lengthen: they go by all pairs.
        pairs = sorted((d[u][v] - max(near[u][0], near[v][0]), ids[u], ids[v], u, v) for u, v in itertools.combinations(sorted(near), 2)) if forced else by_saving(ids, xy, near, free)
        for _, _, _, u, v in pairs:
            if forced and len(route) <= vehicles:
                break
            a, b = head[u], head[v]
            x, y = route[a], route[b]
            if a == b or (u, v) in banned or len(x) + len(y) > capacity or u not in (x[0], x[-1]) or v not in (y[0], y[-1]):
                continue
            joined = (x if x[-1] == u else x[::-1]) + (y if y[0] == v else y[::-1])
            if forced or _open(d, near, joined) < _open(d, near, x) + _open(d, near, y) - 1e-9:
                del route[b]
                route[a] = joined
                for m in joined:
                    head[m] = a
                free.join(joined, a)
    routes = [improve(d, near, r, allowed) for _, r in sorted(route.items())]
    return [oriented(xy, near, r) for r in moved(d, near, routes, capacity, rounds, allowed)]


class Free:
    """Which nodes may still be joined: those at the end of a route that has room; and each one's route and its size."""

    def __init__(self, near, capacity: int):
        self.nodes, self.capacity = np.array(sorted(near), int), capacity
        most = int(self.nodes.max(initial=-1)) + 1
        self.size, self.head, self.end = np.ones(most, int), np.arange(most), np.ones(most, bool)

    def join(self, route: list[int], head: int) -> None:
        self.size[route], self.head[route] = len(route), head
        self.end[route[1:-1]] = False
        if len(route) >= self.capacity:
            self.end[route] = False

    def partners(self, u: int) -> np.ndarray:
        m = self.nodes
        return m[self.end[m] & (self.head[m] != self.head[u]) & (self.size[m] + self.size[u] <= self.capacity)]


#: Partners that a node is given first; each time it asks for more, it gets four times as many.
FIRST = 16


def by_saving(ids, xy: np.ndarray, near, free: Free):
    """(length less the longer of the two gates, ids, u < v) of pairs of nodes, ascending, as long as it is negative: other joins save nothing.

    A pair belongs to its node of the longer gate, which lists its partners in growing parts; those that can't be joined any
    more, which stays so, are left out.
    """
    gate = np.zeros(len(xy))
    for k, (g, _) in near.items():
        gate[k] = g
    at, heap = np.asarray(ids), []

    def more(u: int, beyond: tuple, count: int) -> None:
        """Puts u's next partners on the heap, beyond a key; none is on it."""
        if not free.end[u]:
            return
        m = free.partners(u)
        m = m[(gate[m] < gate[u]) | ((gate[m] == gate[u]) & (m < u))]
        key = length(xy, m, u) - gate[u]
        m, key = m[(key < 0) & (key > beyond)], key[(key < 0) & (key > beyond)]
        if not len(m):
            return
        if len(m) > count:
            most = np.partition(key, count - 1)[count - 1]
            m, key = m[key <= most], key[key <= most]
        low, high = np.minimum(m, u), np.maximum(m, u)
        order = np.lexsort((at[high], at[low], key))
        some = iter(list(zip(key[order].tolist(), at[low][order].tolist(), at[high][order].tolist(), low[order].tolist(), high[order].tolist(), strict=True)))
        heapq.heappush(heap, (*next(some), u, count, some))

    for u in free.nodes.tolist():
        more(u, -np.inf, FIRST)
    while heap:
        *pair, u, count, some = heapq.heappop(heap)
        yield tuple(pair)
        if (after := next(some, None)) is not None:
            if free.end[u]:
                heapq.heappush(heap, (*after, u, count, some))
        else:
            more(u, pair[0], 4 * count)


class Lengths(dict):
    """Lengths between points as d[u][v], each computed when it is first asked for."""

    def __init__(self, xy: np.ndarray):
        self.xy, self.at = xy, xy.tolist()

    def __missing__(self, u: int):
        self[u] = row = _Row(self.at, u)
        return row

    def closest(self, u: int, nodes: np.ndarray, count: int) -> list[int]:
        """The nodes nearest to u other than u, ties by index."""
        nodes = nodes[nodes != u]
        d = length(self.xy, nodes, u)
        if len(nodes) > count:
            near = d <= np.partition(d, count - 1)[count - 1]
            nodes, d = nodes[near], d[near]
        return nodes[np.lexsort((nodes, d))][:count].tolist()


class _Row(dict):
    def __init__(self, at: list, u: int):
        self.every, self.at = at, at[u]

    def __missing__(self, v: int) -> float:
        (a, b), (x, y) = self.at, self.every[v]
        self[v] = d = math.sqrt(float((a - x) * (a - x) + (b - y) * (b - y)))
        return d


#: Nearest nodes beside which a node may be moved.
NEIGHBOURS = 10


def moved(d, near, routes: list[list[int]], capacity: int, rounds: int, allowed) -> list[list[int]]:
    """Routes improved by moving single nodes beside near ones of other routes, each pass over all nodes, until none gains."""
    nodes = sorted(near)
    every = np.array(nodes, int)
    close = {m: d.closest(m, every, NEIGHBOURS) for m in nodes}
    of = {m: i for i, r in enumerate(routes) for m in r}
    size = [_open(d, near, r) for r in routes]
    for _ in range(rounds):
        changed = False
        for m in nodes:
            i = of[m]
            rest = [k for k in routes[i] if k != m]
            gain = size[i] - (_open(d, near, rest) if rest else 0.0)
            best = None
            for j in sorted({of[k] for k in close[m]} - {i}):
                b = routes[j]
                if len(b) >= capacity:
                    continue
                for p in range(len(b) + 1):
                    if not ((p and b[p - 1] in close[m]) or (p < len(b) and b[p] in close[m])):
                        continue
                    new = b[:p] + [m] + b[p:]
                    x = _open(d, near, new) - size[j] - gain
                    if x < -1e-6 and (best is None or x < best[0]) and allowed(new) and allowed(rest):
                        best = (x, j, new)
            if best:
                _, j, new = best
                routes[i], routes[j] = rest, improve(d, near, new, allowed)
                size[i], size[j] = _open(d, near, rest) if rest else 0.0, _open(d, near, routes[j])
                of[m] = j
                changed = True
        if not changed:
            break
    return [r for r in routes if r]


def oriented(xy, near, r):
    return r if near[r[0]][0] <= near[r[-1]][0] else r[::-1]


def _open(d, near, r) -> float:
    total = min(near[r[0]][0], near[r[-1]][0])
    for a, b in zip(r, r[1:], strict=False):
        total += d[a][b]
    return total


def open_length(xy, near, r) -> float:
    return float(length(xy, np.array(r[:-1], int), np.array(r[1:], int)).sum()) + min(near[r[0]][0], near[r[-1]][0])


def improve(d, near, r, allowed=lambda r: True):
    """2-opt until no reversal of a part, that is allowed, shortens the open route."""
    better, now = True, _open(d, near, r)
    while better:
        better = False
        for i, j in itertools.combinations(range(len(r) + 1), 2):
            new = r[:i] + r[i:j][::-1] + r[j:]
            size = _open(d, near, new)
            if size < now - 1e-9 and allowed(new):
                r, now, better = new, size, True
    return r


def iterated_routes(ids, xy: np.ndarray, capacity: int, most: int = 10) -> list[list[int]]:
    """Routes solved and repaired again and again, a hop that still crosses being banned each time; the least crossed, then shortest."""
    near = nearest_root(ids, xy)
    banned: set[tuple[int, int]] = set()
    best = None
    for _ in range(max(1, most)):
        routes = repair(ids, xy, savings_routes(ids, xy, capacity, banned=frozenset(banned)))
        hops = sorted((min(a, b), max(a, b)) for r in routes for a, b in zip(r, r[1:], strict=False))
        score = (count_crossings(xy, hops), sum(open_length(xy, near, r) for r in routes))
        if best is None or score < best[0]:
            best = (score, routes)
        if not score[0]:
            break
        crossed = np.unique(crossing_pairs(xy, hops, hops)[:, 0]).tolist()
        offending = [hops[k] for k in crossed if hops[k] not in banned]
        if not offending:
            break
        banned.add(max(offending, key=lambda e: (float(length(xy, *e)), e)))
    return best[1]


def routes_to_parents(ids, xy, routes) -> dict[int, int]:
    near = nearest_root(ids, xy)
    return {ids[m]: (near[r[0]][1] if k == 0 else ids[r[k - 1]]) for r in routes for k, m in enumerate(r)}


def count_crossings(xy, edges) -> int:
    if len(edges) < 2:
        return 0
    pairs = crossing_pairs(xy, edges, edges)
    return int((pairs[:, 0] < pairs[:, 1]).sum())


def repair(ids, xy: np.ndarray, routes: list[list[int]], rounds: int = 20) -> list[list[int]]:
    """Fewer crossings between routes: swaps of the tails beyond a crossing, or of two nodes, the cheapest that lessens them."""
    near = nearest_root(ids, xy)
    capacity = max((len(r) for r in routes), default=0)
    routes = [*routes]
    best: dict[tuple[int, int], tuple | None] = {}
    for _ in range(rounds):
        hops = np.array([(a, b) for r in routes for a, b in zip(r, r[1:], strict=False)], int).reshape(-1, 2)
        of = np.repeat(np.arange(len(routes)), [len(r) - 1 for r in routes])
        pairs = of[crossing_pairs(xy, hops, hops)]
        met = {(i, j) for i, j in pairs.tolist() if i < j}
        if not len(pairs):
            break
        for i, j in met:
            if (i, j) not in best:
                best[i, j] = _swapped(xy, near, routes[i], routes[j], capacity, hops[(of != i) & (of != j)])
        found = min(((*best[p][:2], p) for p in met if best[p]), default=None)
        if found is None:
            break
        i, j = found[2]
        changed = _box(xy, routes[i] + routes[j])
        _, _, routes[i], routes[j] = best[i, j]
        # What was found for routes elsewhere still holds.
        best = {p: b for p, b in best.items() if not {i, j} & {*p} and not _boxes_meet(changed, _box(xy, routes[p[0]] + routes[p[1]]))}
    return routes


def _box(xy: np.ndarray, nodes: list[int]) -> tuple:
    return (*xy[nodes].min(axis=0).tolist(), *xy[nodes].max(axis=0).tolist())


def _boxes_meet(a: tuple, b: tuple) -> bool:
    """Whether two boxes meet."""
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def _swapped(xy: np.ndarray, near, a: list[int], b: list[int], capacity: int, others: np.ndarray):
    """(crossings less those now, length, two routes) of the best swap between two routes; None if none lessens the crossings."""
    nodes = a + b
    legs = np.array(list(itertools.combinations(range(len(nodes)), 2)), int)
    at = np.array(nodes)
    x0, y0, x1, y1 = _box(xy, nodes)
    p, q = xy[others[:, 0]], xy[others[:, 1]]
    close = others[(np.minimum(p, q) <= (x1, y1)).all(axis=1) & (np.maximum(p, q) >= (x0, y0)).all(axis=1)]
    u, v = at[legs[:, 0]], at[legs[:, 1]]
    outer = crosses(xy, u[:, None], v[:, None], close[None, :, 0], close[None, :, 1]).sum(axis=1)
    inner = crosses(xy, u[:, None], v[:, None], u[None, :], v[None, :])
    place = {frozenset((nodes[s], nodes[t])): k for k, (s, t) in enumerate(legs.tolist())}

    def count(*routes: list[int]) -> int:
        k = [place[frozenset(e)] for r in routes for e in zip(r, r[1:], strict=False)]
        return int(outer[k].sum()) + int(inner[np.ix_(k, k)].sum()) // 2

    now, best = count(a, b), None
    options = [(a[:p] + b[q:], b[:q] + a[p:]) for p in range(1, len(a)) for q in range(1, len(b))]
    options += [(a[:p] + [b[q]] + a[p + 1 :], b[:q] + [a[p]] + b[q + 1 :]) for p in range(len(a)) for q in range(len(b))]
    for x, y in options:
        if max(len(x), len(y)) > capacity:
            continue
        fewer = count(x, y) - now
        if fewer < 0:
            cost = open_length(xy, near, x) + open_length(xy, near, y)
            if best is None or (fewer, cost) < best[:2]:
                best = (fewer, cost, oriented(xy, near, x), oriented(xy, near, y))
    return best


def exact_forest(ids, xy: np.ndarray, capacity: int, branching: bool = True, most: int = 10, power: dict[int, int] | None = None, gates: int | None = None) -> tuple[float, dict[int, int]]:
    """The least total length of a capacitated forest over all edges, by dynamic programming over subsets of up to `most` terminals.

    power: what terminals feed in, by id, if not 1; gates: the most gates. Infinite, without parents, if that can't be.
    """
    t = [k for k, i in enumerate(ids) if i >= 0]
    if len(t) > most:
        raise ValueError(f"{len(t)} terminals; the exact search takes {most}")
    near = nearest_root(ids, xy)
    d = {(a, b): float(length(xy, a, b)) for a in t for b in t}
    feeds = [(power or {}).get(ids[k], 1) for k in t]
    single: dict[int, tuple[float, list, int]] = {}
    for mask in range(1, 1 << len(t)):
        own = [t[k] for k in range(len(t)) if mask >> k & 1]
        if sum(feeds[k] for k in range(len(t)) if mask >> k & 1) > capacity:
            continue
        if branching:
            links, inside, cost = [], [own[0]], 0.0
            while len(inside) < len(own):
                w, a, b = min((d[a, b], a, b) for a in inside for b in own if b not in inside)
                cost, links = cost + w, [*links, (a, b)]
                inside.append(b)
            hook = min(own, key=lambda k: near[k])
        else:
            cost, p = min(((open_length(xy, near, list(q)), list(q)) for q in itertools.permutations(own)), key=lambda x: x[0])
            p = oriented(xy, near, p)
            links, hook = list(zip(p, p[1:], strict=False)), p[0]
            cost -= near[hook][0]
        single[mask] = (cost + near[hook][0], links, hook)
    # A layer for each number of gates left; without a limit, one.
    layers = 1 if gates is None else gates + 1
    best = [[0.0] + [float("inf")] * ((1 << len(t)) - 1) for _ in range(layers)]
    choice = [[0] * (1 << len(t)) for _ in range(layers)]
    for g in range(layers):
        before = g if gates is None else g - 1
        for mask in range(1, 1 << len(t)) if before >= 0 else ():
            low, sub = mask & -mask, mask
            while sub:
                if sub & low and sub in single and single[sub][0] + best[before][mask ^ sub] < best[g][mask] - 1e-9:
                    best[g][mask], choice[g][mask] = single[sub][0] + best[before][mask ^ sub], sub
                sub = (sub - 1) & mask
    links, hooks, mask, g = [], {}, (1 << len(t)) - 1, layers - 1
    total = best[g][mask]
    while mask and np.isfinite(total):
        _, ls, h = single[choice[g][mask]]
        links += ls
        hooks[h] = near[h][1]
        mask ^= choice[g][mask]
        g -= gates is not None
    return total, parents_from(ids, links, hooks)


def improved_forest(ids, xy: np.ndarray, capacity: int, parent: dict[int, int], most: int = 7) -> dict[int, int]:
    """A solution no longer than the one given: pairs of near subtrees, of up to `most` terminals together, are solved exactly for as long as one gains.

    Crossings aren't looked at.
    """
    at = {i: k for k, i in enumerate(ids)}
    own = dict(parent)
    roots = [i for i in ids if i < 0]
    size = lambda p: sum(float(length(xy, at[a], at[b])) for a, b in p.items())

    def top(n: int) -> int:
        while own[n] >= 0:
            n = own[n]
        return n

    near = {(min(ids[u], ids[v]), max(ids[u], ids[v])) for u, v in available(xy) if ids[u] >= 0 and ids[v] >= 0}
    done: set[frozenset] = set()
    changed = True
    while changed:
        changed = False
        for a, b in sorted(near):
            x, y = top(a), top(b)
            part = frozenset(n for n in own if top(n) in (x, y))
            if x == y or len(part) > most or part in done:
                continue
            done.add(part)
            some = [*roots, *sorted(part)]
            cost, new = exact_forest(some, xy[[at[i] for i in some]], capacity, most=most)
            if cost < size({n: own[n] for n in part}) - 1e-9:
                own.update(new)
                changed = True
    return own


def detours(ids, xy: np.ndarray, parent: dict[int, int], blocked=()) -> tuple[dict[int, list[int]], list[int]]:
    """Ways for the gates that cross something: hook id -> ids from a node of its subtree to the root, and hooks without one.

    A way is a shortest path over the site's points along segments that cross no edge, no straight
    gate that stays and no other way, from any node of the subtree.
    """
    at = {i: k for k, i in enumerate(ids)}
    walls = np.array(blocked, float).reshape(-1, 2)
    n = len(ids)
    every = points(np.concatenate([xy, walls])) if len(walls) else np.asarray(xy)
    edges = [(at[a], at[b]) for a, b in parent.items() if b >= 0]
    gates = sorted((float(length(xy, at[a], at[b])), a, b) for a, b in parent.items() if b < 0)
    top: dict[int, int] = {}
    for a in parent:
        chain = [a]
        while chain[-1] not in top and parent[chain[-1]] >= 0:
            chain.append(parent[chain[-1]])
        top |= dict.fromkeys(chain, top.get(chain[-1], chain[-1]))
    own: dict[int, list[int]] = {}
    for a in parent:
        own.setdefault(top[a], []).append(at[a])
    fixed = _Fixed(every, [*edges, *((n + k, n + k + 1) for k in range(0, len(walls), 2))], np.arange(n))
    bad = []
    for _, a, b in gates:
        if len(fixed.now) and crosses(every, at[a], at[b], *fixed.now.T).any():
            bad.append((a, b))
        else:
            fixed.add(at[a], at[b])
    ways, failed = {}, []
    passed = np.array([k for k, i in enumerate(ids) if i >= 0], int)
    for a, b in bad:
        way = fixed.way(np.array(own[a]), at[b], passed)
        if way is None:
            failed.append(a)
            fixed.add(at[a], at[b])
            continue
        ways[a] = [ids[k] for k in way]
        for s, t in zip(way, way[1:], strict=False):
            fixed.add(s, t)
    return ways, failed


#: Segments about a point that are tested first, by equal angles.
NEAREST, SECTORS = 512, 1024
#: Points that views hold at most, before they are found anew.
HELD = 4_000_000
#: Ways that are longer than straight by more than this share count as long.
LONG = 0.1


class _Fixed:
    """Segments that nothing may cross, and shortest ways over points between them. What a point sees is found when a way comes by it."""

    def __init__(self, xy: np.ndarray, segments, among: np.ndarray):
        """among: the points that ways go over or end at."""
        self.xy, self.count, self.among = xy, len(segments), among
        self.rows = np.array(segments, int).reshape(-1, 2)
        self.ends = xy.astype(float)
        # By end of ways, which points can't reach it: as segments only come, none of them ever will.
        self.shut: dict[int, np.ndarray] = {}
        self.views: dict[int, tuple[np.ndarray, int]] = {}
        self.held = 0

    @property
    def now(self) -> np.ndarray:
        return self.rows[: self.count]

    def add(self, s: int, t: int) -> None:
        if self.count == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((self.count + 16, 2), int)])
        self.rows[self.count] = s, t
        self.count += 1

    def seen(self, k: int, among: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """Which of some points are seen from k. The nearest segments hide most of what is hidden; all are tested with the rest."""
        out = np.ones(len(among), bool)
        off = self.ends - self.ends[k]
        # Segments that end at k hide nothing from it.
        here = ~off.any(axis=1)
        segments = segments[~(here[segments[:, 0]] | here[segments[:, 1]])]
        p, q = off[segments[:, 0]], off[segments[:, 1]]
        side = q - p
        (px, py), (sx, sy) = p.T, side.T
        along = np.clip(-(px * sx + py * sy) / np.maximum(sx * sx + sy * sy, 1e-300), 0, 1)
        least = np.hypot(px + along * sx, py + along * sy) * (1 - 1e-9)
        near = np.argpartition(least, NEAREST)[:NEAREST] if len(least) > NEAREST else np.arange(len(least))
        out[self._behind(off[among], p[near], q[near])] = False
        left = np.flatnonzero(out)
        if len(left) and len(segments):
            out[left[self._hidden(k, among[left], segments, p, q, least)]] = False
        return out

    @staticmethod
    def _behind(d: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of some points lie for certain behind a segment: in each of `SECTORS` equal angles, what is farther than a segment that spans all of it. All as seen from one point."""
        first, last, sector, rim = np.arctan2(p[:, 1], p[:, 0]), np.arctan2(q[:, 1], q[:, 0]), 2 * np.pi / SECTORS, 1e-9
        wide = np.mod(last - first + np.pi, 2 * np.pi) - np.pi
        low = np.where(wide >= 0, first, last) + np.pi
        start, stop = np.floor((low + rim) / sector).astype(int) + 1, np.floor((low + np.abs(wide) - rim) / sector).astype(int)
        m = np.where(np.abs(wide) < 3, np.maximum(stop - start, 0), 0)
        g = np.repeat(np.arange(len(p)), m)
        h = start[g] + np.arange(len(g)) - np.repeat(np.cumsum(m) - m, m)
        side = (q - p)[g]
        over = p[g, 0] * side[:, 1] - p[g, 1] * side[:, 0]
        # A segment is farthest at one end of the angle.
        rays = [(h + e) * sector - np.pi for e in (0, 1)]
        depth = np.full(SECTORS, np.inf)
        np.minimum.at(depth, h % SECTORS, np.maximum(*[over / (np.cos(a) * side[:, 1] - np.sin(a) * side[:, 0]) for a in rays]))
        at = np.floor((np.arctan2(d[:, 1], d[:, 0]) + np.pi) / sector).astype(int) % SECTORS
        return np.hypot(d[:, 0], d[:, 1]) > depth[at] * (1 + rim)

    def _hidden(self, k: int, among: np.ndarray, segments: np.ndarray, p: np.ndarray, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which of some points a segment hides from k: one is tested with those alone that lie in its angle and farther than its nearest point. p, q: its ends, seen from k."""
        out = np.zeros(len(among), bool)
        d = self.ends[among] - self.ends[k]
        size = np.hypot(d[:, 0], d[:, 1])
        close = least <= size.max()
        segments, p, q, least = segments[close], p[close], q[close], least[close]
        to = np.arctan2(d[:, 1], d[:, 0])
        order = np.argsort(to, kind="stable")
        turns = np.concatenate([to[order], to[order] + 2 * np.pi])
        first, last, rim = np.arctan2(p[:, 1], p[:, 0]), np.arctan2(q[:, 1], q[:, 0]), 1e-7
        wide = np.mod(last - first + np.pi, 2 * np.pi) - np.pi
        low = np.where(wide >= 0, first, last) - rim
        low = np.where(low < -np.pi, low + 2 * np.pi, low)
        start, stop = np.searchsorted(turns, low, "left"), np.searchsorted(turns, low + np.abs(wide) + 2 * rim, "right")
        m = np.minimum(stop - start, len(among))
        step = 1 + PAIRS // len(among)
        for at in range(0, len(segments), step):
            part = slice(at, at + step)
            g = np.repeat(np.arange(len(segments))[part], m[part])
            h = order[(start[g] + np.arange(len(g)) - np.repeat(np.cumsum(m[part]) - m[part], m[part])) % len(among)]
            beyond = size[h] >= least[g]
            g, h = g[beyond], h[beyond]
            hit = crosses(self.xy, k, among[h], segments[g, 0], segments[g, 1])
            out[h[hit]] = True
        return out

    def view(self, k: int) -> np.ndarray:
        """The points seen from k. Found once, as segments only come: later ones are held against what was seen before them."""
        if k not in self.views:
            if self.held > HELD:
                self.views, self.held = {}, 0
            found = self.among[self.seen(k, self.among, self.now)]
        else:
            found, since = self.views[k]
            if since == self.count:
                return found
            self.held -= len(found)
            s, t = self.rows[since : self.count].T
            step = 1 + PAIRS // max(1, len(found))
            for at in range(0, len(s), step):
                found = found[~crosses(self.xy, k, found[:, None], s[None, at : at + step], t[None, at : at + step]).any(axis=1)]
        self.views[k], self.held = (found.astype(np.int32), self.count), self.held + len(found)
        return found

    def way(self, sources: np.ndarray, end: int, passed: np.ndarray) -> list[int] | None:
        """The shortest way from one of the sources over points of `passed` to the end, none if there is none.

        Where ways are long, the end's side is searched, too, as far as the other: whichever is closed in tells that there is none.
        """
        shut = self.shut.setdefault(end, np.zeros(len(self.xy), bool))
        sources = sources[~shut[sources]]
        if not len(sources):
            return None
        open_ = np.zeros(len(self.xy), bool)
        open_[passed] = open_[sources] = open_[end] = True
        open_ &= ~shut
        left = length(self.xy, np.arange(len(self.xy)), end)
        dist, rated, before = np.full(len(self.xy), np.inf), np.full(len(self.xy), np.inf), np.full(len(self.xy), -1)
        dist[sources], rated[sources] = 0.0, left[sources]
        done = np.zeros(len(self.xy), bool)
        far = float(rated.min()) * (1 + LONG)
        about, behind = open_.copy(), [end]
        about[end] = False
        while True:
            k = int(np.argmin(rated))
            if rated[k] == np.inf:
                shut |= done
                return None
            if k == end:
                break
            if rated[k] > far and behind is not None:
                if not behind:
                    # Nothing but what `about` has left reaches the end, and no source is among it.
                    shut |= about
                    return None
                seen = self.view(behind.pop())
                seen = seen[about[seen]]
                about[seen] = False
                behind = None if (~about[sources]).any() else behind + seen.tolist()
            done[k], rated[k] = True, np.inf
            new = self.view(k)
            new = new[open_[new] & ~done[new]]
            reach = dist[k] + length(self.xy, new, k)
            less = reach < dist[new] - 1e-9
            new, reach = new[less], reach[less]
            dist[new], rated[new], before[new] = reach, reach + left[new], k
        way = [k]
        while before[way[-1]] >= 0:
            way.append(int(before[way[-1]]))
        return way[::-1]


def rerouted(ids, parent: dict[int, int], ways: dict[int, list[int]]) -> list[tuple[int, int, int, str]]:
    """(from, to, load, kind) of the routeset's hops: links, straight gates, and the hops of ways, each of which bears its subtree's load.

    A way may begin at another node than the hook that it stands for: the links on the way from the
    hook to that node turn round. Hops are listed from the far end of the flow to the root.
    """
    own = dict(parent)
    for hook, way in ways.items():
        chain = [way[0]]
        while chain[-1] != hook:
            chain.append(parent[chain[-1]])
        for a, b in zip(chain, chain[1:], strict=False):
            own[b] = a
        own[way[0]] = way[-1]
    load = dict.fromkeys(own, 0)
    for n in own:
        m = n
        while m >= 0:
            load[m] += 1
            m = own[m]
    starts = {way[0]: way for way in ways.values()}
    out = []
    for n, p in sorted(own.items()):
        if n in starts:
            out += [(a, b, load[n], "detour") for a, b in zip(starts[n], starts[n][1:], strict=False)]
        else:
            out.append((n, p, load[n], "gate" if p < 0 else "link"))
    return out


def smallest_rectangle(xy: np.ndarray) -> float:
    """Area of the least rectangle around the points: over the hull's sides, the least bounding box along one."""
    pts = sorted(map(tuple, xy.tolist()))
    hull: list = []
    for seq in (pts, pts[::-1]):
        part: list = []
        for p in seq:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]) <= 0:
                part.pop()
            part.append(p)
        hull += part[:-1]
    h = np.array(hull, float)
    best = float("inf")
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        d = (b - a) / np.hypot(*(b - a))
        along, across = h @ d, h @ np.array([-d[1], d[0]])
        best = min(best, float((along.max() - along.min()) * (across.max() - across.min())))
    return best


def convex_ring(xy: np.ndarray) -> list[int]:
    """Indices of the convex hull's corners, counter-clockwise from the least; points on its sides are none."""
    order = np.lexsort((xy[:, 1], xy[:, 0])).tolist()
    out: list[int] = []
    for seq in (order, order[::-1]):
        part: list[int] = []
        for k in seq:
            while len(part) > 1 and orient(xy, part[-2], part[-1], k) <= 0:
                part.pop()
            part.append(k)
        out += part[:-1]
    return out


def pockets(ring) -> list[list[int]]:
    """Parts of a simple ring between neighbouring corners of its hull that lie inside the hull: indices with both corners, in the ring's order."""
    xy = points(ring)
    n, corners = len(xy), set(convex_ring(xy))
    on = [k for k in range(n) if k in corners]
    out = []
    for a, b in zip(on, on[1:] + on[:1], strict=True):
        part = [(a + k) % n for k in range((b - a) % n + 1)]
        # Points on the hull's own side make no pocket.
        if len(part) > 2 and any(orient(xy, a, b, k) != 0 for k in part[1:-1]):
            out.append(part)
    return out


def constrained(xy: np.ndarray, constraints) -> list[tuple[int, int, int]]:
    """The Delaunay triangulation with some sides forced, by Anglada's method.

    The triangles that a forced side crosses go; the points on either side of it form a chain, which
    is triangulated anew from the point whose circle through the side's ends holds no other. A side
    that runs through a point is forced in two parts.
    """
    tri = {frozenset(t) for t in delaunay(xy)}

    def force(a: int, b: int) -> None:
        if any(a in t and b in t for t in tri):
            return
        if on := between(xy, a, b):
            k = min(on, key=lambda k: ((xy[k] - xy[a]) ** 2).sum())
            force(a, k)
            force(k, b)
            return
        cut = [t for t in tri if any(u not in (a, b) and v not in (a, b) and crosses(xy, a, b, u, v) for u, v in itertools.combinations(t, 2))]
        points = set().union(*cut) - {a, b}
        tri.difference_update(cut)
        edges: dict[frozenset, int] = {}
        for t in cut:
            for e in itertools.combinations(t, 2):
                edges[frozenset(e)] = edges.get(frozenset(e), 0) + 1
        rim = [tuple(e) for e, n in edges.items() if n == 1]
        for sign in (1, -1):
            side = {p for p in points if sign * orient(xy, a, b, p) > 0}
            adj: dict[int, list[int]] = {}
            for u, v in rim:
                if {u, v} <= side | {a, b}:
                    adj.setdefault(u, []).append(v)
                    adj.setdefault(v, []).append(u)
            chain, seen = [a], {a}
            while chain[-1] != b:
                step = next((k for k in sorted(adj.get(chain[-1], ())) if k not in seen), None)
                if step is None:
                    break
                chain.append(step)
                seen.add(step)
            fill(chain[1:-1] if chain[-1] == b else chain[1:], a, b)

    def fill(chain: list[int], a: int, b: int) -> None:
        if not chain:
            return
        best = 0
        for k in range(1, len(chain)):
            p, q, r = (a, b, chain[best]) if orient(xy, a, b, chain[best]) > 0 else (b, a, chain[best])
            if in_circle(xy, p, q, r, np.array([chain[k]]))[0] > 0:
                best = k
        c = chain[best]
        tri.add(frozenset((a, b, c)))
        fill(chain[:best], a, c)
        fill(chain[best + 1 :], c, b)

    for a, b in constraints:
        force(int(a), int(b))
    out = []
    for t in tri:
        a, b, c = sorted(t)
        turn = orient(xy, a, b, c)
        if turn != 0:
            out.append((a, b, c) if turn > 0 else (a, c, b))
    return sorted(out)


def inside(polygon: np.ndarray, p) -> bool:
    """Whether a point lies within a polygon, by crossing parity in doubled whole numbers or floats."""
    odd = False
    for (ax, ay), (bx, by) in zip(polygon.tolist(), np.roll(polygon, -1, axis=0).tolist(), strict=True):
        if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def navigation_mesh(xy: np.ndarray, border, holes) -> list[tuple[int, int, int]]:
    """Constrained triangles within the border and outside the holes; border and holes are index rings."""
    rings = [border, *holes]
    sides = [(r[k], r[(k + 1) % len(r)]) for r in rings for k in range(len(r))]
    keep = []
    for t in constrained(xy, sides):
        mid = xy[list(t)].mean(axis=0)
        if inside(xy[border], mid) and not any(inside(xy[h], mid) for h in holes):
            keep.append(t)
    return keep

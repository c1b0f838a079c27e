"""Delaunay triangles by tiles against the triangulation of the whole site."""

import numpy as np
import pandas as pd
import pytest

from cablewright.operators import kernels as K
from cablewright.operators import tiles


def _points(kind):
    r = np.random.default_rng(3)
    if kind == "even":
        p = r.integers(0, 20000, (700, 2))
    elif kind == "lattice":
        p = np.array([(10 * x, 10 * y) for x in range(20) for y in range(20)])
    elif kind == "clusters":
        p = np.concatenate([r.normal(c, 50, (150, 2)) for c in ((0, 0), (5000, 200), (9000, 9000), (-3000, 7000))]).round().astype(int)
    else:
        p = r.random((500, 2)) * 1e-3
    p = np.unique(p, axis=0)
    r.shuffle(p)
    return p


@pytest.mark.parametrize("kind,most", [("lattice", 100), ("clusters", 100), ("small doubles", 90)])
def test_tiles_agree_with_the_whole(spark, kind, most):
    p = _points(kind)
    few = [(8, n, x, y) for n, (x, y) in enumerate([(0, 0), (10, 0), (0, 7), (3, 3)], -2)]
    v = pd.concat([pd.DataFrame({"site_id": 7, "n": range(-2, len(p) - 2), "x": p[:, 0], "y": p[:, 1]}), pd.DataFrame(few, columns=["site_id", "n", "x", "y"]).astype({"x": p.dtype, "y": p.dtype})])
    got = {tuple(r) for r in tiles.triangles(spark.createDataFrame(v), most).collect()}
    want = {(7, *(k - 2 for k in sorted(t))) for t in K.delaunay(p)}
    assert {t for t in got if t[0] == 7} == want
    assert {t for t in got if t[0] == 8} == {(8, -2, -1, 1), (8, -2, 0, 1), (8, -1, 0, 1)}


def test_a_site_on_a_line_has_none(spark):
    v = pd.DataFrame({"site_id": 1, "n": range(90), "x": range(90), "y": range(0, 180, 2)})
    assert tiles.triangles(spark.createDataFrame(v), 30).collect() == []


def test_no_group_holds_the_site(spark, monkeypatch):
    """Groups have a tile's points and its halo."""
    p = _points("even")
    v = spark.createDataFrame(pd.DataFrame({"site_id": 7, "n": range(len(p)), "x": p[:, 0], "y": p[:, 1]}))
    tables = {}
    plain = tiles.work_table
    monkeypatch.setattr(tiles, "work_table", lambda d, name: tables.setdefault(name, []).append(plain(d, name)) or tables[name][-1])
    tiles.triangles(v, 64)
    for known in tables["known"]:
        assert known.filter("kind < 2").groupBy(*tiles.TILE).count().agg({"count": "max"}).first()[0] < 300
    assert tables["points"][0].select(*tiles.TILE).distinct().count() >= 9


@pytest.mark.parametrize("scale", [1e-4, 1.0, 1e4])
def test_forced_sides_at_any_scale(scale):
    r = np.random.default_rng(5)
    p = r.integers(0, 10000, (30, 2)) * scale
    ring = np.array([(-100, -100), (10100, -100), (10100, 10100), (-100, 10100)]) * scale
    hole = np.array([(4000, 4000), (6000, 4100), (6100, 6000), (4100, 6100)]) * scale
    inside = K.inside
    p = np.array([q for q in p if not inside(hole, q)])
    xy = K.points(np.concatenate([p, ring, hole]))
    a, b = list(range(len(p), len(p) + 4)), list(range(len(p) + 4, len(p) + 8))
    tri = K.navigation_mesh(xy, a, [b])
    have = {frozenset((t[i], t[j])) for t in tri for i, j in ((0, 1), (1, 2), (2, 0))}
    assert all(frozenset((r[k], r[k - 1])) in have for r in (a, b) for k in range(4))
    area = sum(float(K.orient(xy, *t)) for t in tri)
    ring_area = lambda q: abs(sum(q[k - 1][0] * q[k][1] - q[k][0] * q[k - 1][1] for k in range(len(q))))
    assert area == pytest.approx(ring_area(ring) - ring_area(hole))
    assert len(tri) == 2 * len(p) + 4 + 4 - 2 + 2

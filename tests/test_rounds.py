"""Rounds of joins against walks over one site in plain Python."""

import heapq
import random

import pandas as pd
import pytest

from cablewright.operators import rounds, trees


def _forest(sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for site, size in enumerate(sizes):
        for n in range(size):
            parent = rng.choice((-1, -2)) if n == 0 or rng.random() < 0.05 else rng.randrange(max(0, n - 9), n)
            rows.append((site, n, parent, rng.randrange(1, 50)))
    return rows


def test_loads_of_large_sites(spark, monkeypatch):
    rows = _forest([1, 40, 300])
    d = spark.createDataFrame([(*r[:3], r[2], r[3]) for r in rows], "site_id long, n long, parent long, root long, length long")
    plain = sorted(map(tuple, trees.tree_loads(d).collect()))
    monkeypatch.setattr(trees, "WHOLE", 30)
    assert sorted(map(tuple, trees.tree_loads(d).collect())) == plain
    up = {(r.site_id, r.n): r for r in rounds.ancestors(d, "length").collect()}
    at = {(s, n): (p, w) for s, n, p, w in rows}
    for (site, n), r in up.items():
        m, way = n, 0
        while m >= 0:
            way, m = way + at[site, m][1], at[site, m][0]
        assert (r.root, r.way) == (m, way)


def test_loads_on_a_path_of_100000(spark):
    size = 100_000
    d = spark.range(size).selectExpr("1L AS site_id", "id AS n", "id - 1 AS parent", "-1L AS root")
    got = trees.tree_loads(d)
    assert got.filter(f"load <> {size} - n OR depth <> n + 1 OR subtree <> 0").isEmpty() and got.count() == size


def test_cycles_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(trees, "WHOLE", 2)
    d = spark.createDataFrame([(1, 0, -1, -1), (1, 1, 2, -1), (1, 2, 3, -1), (1, 3, 1, -1)], "site_id long, n long, parent long, root long")
    with pytest.raises(ValueError, match="cycle"):
        trees.tree_loads(d)


def test_hooks_turn_links_round(spark):
    rows = _forest([60, 25], 4)
    f = spark.createDataFrame([(s, n, -1, p) for s, n, p, _ in rows], "site_id long, n long, root long, parent long")
    parent = {(s, n): p for s, n, p, _ in rows}
    hooks, seen = [], set()
    for s, n in sorted(parent, key=lambda k: (k[0], -k[1])):
        top = n
        while parent[s, top] >= 0:
            top = parent[s, top]
        if (s, top) not in seen:
            seen.add((s, top))
            hooks.append((s, n))
    want = dict(parent)
    for s, hook in hooks:
        n, before = hook, parent[s, hook]
        want[s, hook] = -1
        while before >= 0:
            want[s, before] = n
            n, before = before, parent[s, before]
    got = rounds.turned(f, spark.createDataFrame(hooks, "site_id long, hook long")).collect()
    assert {(r.site_id, r.n): r.parent for r in got} == want


def _graph(sizes, seed=2):
    rng = random.Random(seed)
    rows = set()
    for site, size in enumerate(sizes):
        for n in range(1, size):
            for m in {rng.randrange(n), max(0, n - 1)}:
                rows.add((site, m - 2, n - 2, rng.randrange(1, 30)))
    return sorted(rows)


def test_spanning_forest_against_kruskal(spark):
    edges = _graph([3, 50, 200])
    got = {tuple(r) for r in rounds.spanning_forest(spark.createDataFrame(edges, "site_id long, u long, v long, l2 long")).collect()}
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    want = set()
    for s, u, v, w in sorted(edges, key=lambda e: (e[0], e[3], e[1], e[2])):
        a, b = find((s, max(u, -1))), find((s, max(v, -1)))
        if a != b:
            up[a] = b
            want.add((s, u, v, w))
    assert got == want


def test_ways_against_a_heap(spark):
    edges = [(s, u, v, float(w)) for s, u, v, w in _graph([4, 60, 150], 7)] + [(1, 500, 501, 1.0)]
    roots = [(s, r) for s in range(3) for r in (-1, -2)]
    got = {(r.site_id, r.root, r.n): r.way for r in rounds.ways_from(spark.createDataFrame(edges, "site_id long, u long, v long, w double"), spark.createDataFrame(roots, "site_id long, root long")).collect()}
    want = {}
    for s, root in roots:
        near = {}
        for t, u, v, w in edges:
            if t == s:
                near.setdefault(u, []).append((v, w))
                near.setdefault(v, []).append((u, w))
        heap = [(0.0, root)]
        while heap:
            d, n = heapq.heappop(heap)
            if (s, root, n) not in want:
                want[s, root, n] = d
                for m, w in near.get(n, ()):
                    heapq.heappush(heap, (d + w, m))
    assert got == pytest.approx(want)


def test_no_rows(spark):
    e = spark.createDataFrame(pd.DataFrame({"site_id": [1], "u": [-2], "v": [-1], "l2": [5], "w": [1.0]}))
    assert rounds.spanning_forest(e.limit(0)).collect() == [] and rounds.spanning_forest(e).collect() == []
    none = spark.createDataFrame([], "site_id long, n long, parent long, root long")
    assert rounds.ancestors(none).collect() == [] and trees.tree_loads(none).collect() == []

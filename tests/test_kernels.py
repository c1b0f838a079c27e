"""Properties of the kernels on seeded random sites."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cablewright.operators import kernels as K
from cablewright.operators.trees import loads_of


def site(seed, t=40, r=2):
    rng = np.random.default_rng(seed)
    return [*range(-r, 0), *range(t)], rng.integers(0, 20000, (t + r, 2))


@pytest.mark.parametrize("seed", range(4))
def test_triangulation(seed):
    ids, xy = site(seed)
    tri = K.delaunay(xy)
    sides = [tuple(sorted(e)) for t in tri for e in itertools.combinations(t, 2)]
    assert len(xy) - len(set(sides)) + len(tri) == 1
    for a, b, c in tri:
        assert K.orient(xy, a, b, c) > 0
        others = np.array([k for k in range(len(xy)) if k not in (a, b, c)])
        assert not (K.in_circle(xy, a, b, c, others) > 0).any()
    for (u, v), (s, t) in K.diagonals(xy, tri).items():
        assert K.crosses(xy, u, v, s, t)


def test_degenerate_triangulations():
    assert K.delaunay(np.array([[0, 0], [1, 1]])) == [] and K.delaunay(np.array([[0, 0], [1, 1], [2, 2]])) == []
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]])
    assert len(K.delaunay(square)) == 4


@pytest.mark.parametrize("seed", range(3))
def test_spanning_forest(seed):
    ids, xy = site(seed, 25)
    every = list(itertools.combinations(range(len(ids)), 2))
    tri = {tuple(sorted(e)) for t in K.delaunay(xy) for e in itertools.combinations(t, 2)}
    length = lambda f: sum(float(K.length(xy, *e)) for e in f)
    assert abs(length(K.spanning_forest(ids, xy, tri)) - length(K.spanning_forest(ids, xy, every))) < 1e-6


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("options", [{}, {"rule": "margin"}, {"rule": "bins", "gates_block": True}, {"path": True}, {"rootlust": 0.6}])
def test_savings(seed, options):
    ids, xy = site(seed)
    parent = K.esau_williams(ids, xy, K.available(xy), 5, **options)
    loads = loads_of(parent)
    assert sorted(parent) == [i for i in ids if i >= 0] and max(x[0] for x in loads.values()) <= 5
    at = {i: k for k, i in enumerate(ids)}
    assert K.count_crossings(xy, [(at[a], at[b]) for a, b in parent.items() if b >= 0]) == 0
    star = sum(d for d, _ in K.nearest_root(ids, xy).values())
    assert sum(float(K.length(xy, at[a], at[b])) for a, b in parent.items()) < star
    if options.get("path"):
        ends = [k for a, b in parent.items() for k in (a, b) if k >= 0]
        assert max(map(ends.count, set(ends))) <= 2


def test_walls_are_not_crossed():
    ids, xy = site(1)
    walls = [(0, 10000, 20000, 10001)]
    parent = K.esau_williams(ids, xy, K.available(xy), 8, blocked=walls)
    at = {i: k for k, i in enumerate(ids)}
    assert not any(K._hits(xy, at[a], at[b], np.array(walls, float)) for a, b in parent.items() if b >= 0)


@pytest.mark.parametrize("seed", range(3))
def test_exact(seed):
    ids, xy = site(seed, 6)
    at = {i: k for k, i in enumerate(ids)}
    size = lambda p: sum(float(K.length(xy, at[a], at[b])) for a, b in p.items())
    best, parent = K.exact_forest(ids, xy, 3)
    assert abs(best - size(parent)) < 1e-6 and max(x[0] for x in loads_of(parent).values()) <= 3
    t = [i for i in ids if i >= 0]
    brute = min(size(p) for c in itertools.product(ids, repeat=6) if (p := dict(zip(t, c, strict=True))) and all(a != b for a, b in p.items()) and _forest(p, 3))
    assert abs(best - brute) < 1e-6
    path = K.exact_forest(ids, xy, 3, branching=False)[0]
    assert path >= best - 1e-9
    routes = K.savings_routes(ids, xy, 3)
    assert sum(K.open_length(xy, K.nearest_root(ids, xy), r) for r in routes) >= path - 1e-6
    with pytest.raises(ValueError, match="terminals"):
        K.exact_forest(*site(0, 12), 3)


def _forest(parent, capacity):
    for a in parent:
        m, k = a, 0
        while m >= 0:
            m, k = parent[m], k + 1
            if k > len(parent):
                return False
    return max(x[0] for x in loads_of(parent).values()) <= capacity


@pytest.mark.parametrize("seed", range(4))
def test_repair_and_detours(seed):
    ids, xy = site(seed)
    routes = K.savings_routes(ids, xy, 5)
    hops = lambda rs: [(a, b) for r in rs for a, b in zip(r, r[1:], strict=False)]
    fixed = K.repair(ids, xy, routes)
    assert K.count_crossings(xy, hops(fixed)) <= K.count_crossings(xy, hops(routes))
    assert sorted(k for r in fixed for k in r) == sorted(k for r in routes for k in r) and max(map(len, fixed)) <= 5
    parent = K.esau_williams(ids, xy, K.available(xy), 5)
    at = {i: k for k, i in enumerate(ids)}
    ways, failed = K.detours(ids, xy, parent)
    edges = [(at[a], at[b]) for a, b in parent.items() if b >= 0 or (a not in ways and a not in failed)]
    edges += [(at[a], at[b]) for w in ways.values() for a, b in zip(w, w[1:], strict=False)]
    assert K.count_crossings(xy, edges) == 0
    for a, w in ways.items():
        assert w[-1] < 0 and w[0] in parent
        assert loads_of(parent)[w[0]][1] == a


def test_loads_refuse_a_cycle():
    with pytest.raises(ValueError, match="cycle"):
        loads_of({0: 1, 1: 0})


def test_least_rectangle():
    xy = np.array([[0, 0], [4, 3], [1, 7], [-3, 4]])
    assert abs(K.smallest_rectangle(xy) - 25) < 1e-9


def test_a_long_catalogue_of_cables_loses_none(spark):
    from cablewright.operators.joins import assign_cables

    edges = spark.createDataFrame([(1, 10.0), (1500, 10.0), (3000, 1.0)], "load long, length double")
    out = assign_cables(edges, spark.range(1, 2001).selectExpr("id AS cable", "id AS capacity", "2 * id AS cost").orderBy(F.desc("id")))
    assert {(r.load, r.cable, r.cost) for r in out.collect()} == {(1, 1, 20.0), (1500, 1500, 30000.0), (3000, None, None)}


def test_exact_covers_every_terminal(spark):
    from cablewright.plans import solutions

    v = spark.createDataFrame([(7, n, x, x * x % 91) for n, x in [(-1, 500), *[(k, 40 * k + 7) for k in range(8)]]], "site_id long, n long, x long, y long")
    got = {(r.site_id, r.k, r.capacity): r.cost for r in solutions._exact(v).collect()}
    assert set(got) == {(7, k, c) for k in (0, 1) for c in (2, 3)}
    rows = {r.n: (r.x, r.y) for r in v.collect()}
    ids = [-1, 6, 7]
    assert abs(got[7, 1, 2] - K.exact_forest(ids, np.array([rows[i] for i in ids]), 2)[0]) < 1e-3


def test_predicates_are_exact_beyond_whole_numbers_of_64_bits():
    xy = K.points(np.array([[0, 0], [200_000, 0], [0, 200_000], [150_000, 150_000]]))
    assert K.in_circle(xy, 0, 1, 2, np.array([3]))[0] > 0
    # A point on the circle, and ones that doubles alone can't tell from it.
    far = 2.0**27
    xy = K.points(np.array([[far, 0.5], [0.5 + far, 1.0], [far, 1.5], [far - 0.5, 1.0], [far - 0.5, 1.0 + 2.0**-40], [far - 0.5 + 2.0**-25, 1.0]]))
    got = np.sign(K.in_circle(xy, 0, 1, 2, np.array([3, 4, 5]))).tolist()
    assert got == [0, -1, 1]
    line = K.points(np.array([[0.1, 0.1], [0.2, 0.2], [0.3, 0.3], [0.3, 0.1 + 0.2]]))
    exact = [K._turn(*([__import__("fractions").Fraction(float(c)) for c in line[k]] for k in (0, 1, m))) for m in (2, 3)]
    assert np.sign(K.orient(line, 0, 1, np.array([2, 3]))).tolist() == [np.sign(float(x)) for x in exact]


@pytest.mark.parametrize("seed", range(2))
def test_coordinates_need_not_be_whole_or_small(seed):
    ids, xy = site(seed, 30)
    plain = (K.delaunay(xy), K.esau_williams(ids, xy, K.available(xy), 5))
    for moved in (xy / 8.0, xy * 1024.0 + 6_000_000, xy * 1000):
        assert (K.delaunay(moved), K.esau_williams(ids, K.points(moved), K.available(K.points(moved)), 5)) == plain


@pytest.mark.parametrize("seed", range(3))
def test_rerouted_bears_every_terminal(seed):
    ids, xy = site(seed)
    parent = K.esau_williams(ids, xy, K.available(xy), 5, rule="margin")
    ways, failed = K.detours(ids, xy, parent)
    hops = K.rerouted(ids, parent, ways)
    assert sum(load for _, b, load, _ in hops if b < 0) == 40 and max(load for _, _, load, _ in hops) <= 5
    assert {a for a, _, _, kind in hops if kind != "detour"} | {w[0] for w in ways.values()} == {i for i in ids if i >= 0}


def test_few_vehicles():
    ids, xy = site(3, 24, 1)
    routes = K.savings_routes(ids, xy, 8, vehicles=3)
    assert len(routes) == 3 and sorted(k for r in routes for k in r) == [k for k, i in enumerate(ids) if i >= 0] and max(map(len, routes)) <= 8


def test_pockets():
    ring = [(0, 0), (10, 0), (10, 10), (6, 10), (5, 4), (4, 10), (0, 10)]
    assert K.pockets(np.array(ring)) == [[2, 3, 4, 5, 6]]
    assert K.pockets(np.array([(0, 0), (5, 0), (10, 0), (10, 10), (0, 10)])) == []


def test_knn_beyond_the_rings(spark):
    """A tight cluster, a lonely point and equal distances, against all pairs."""
    from cablewright.operators.joins import knn_edges

    rng = np.random.default_rng(5)
    pts = [(1, n, int(x), int(y)) for n, (x, y) in enumerate(rng.integers(0, 40, (60, 2)))] + [(1, 60, 100_000, 5), (1, -1, 3, 90_000), (2, 0, 0, 0), (2, 1, 0, 7), (3, 0, 5, 5)]
    v = spark.createDataFrame(pts, "site_id long, n long, x long, y long")
    want = set()
    for s, n, x, y in pts:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, m) for t, m, a, b in pts if t == s and m != n)[:4]
        want |= {(s, min(n, m), max(n, m), d) for d, m in near}
    assert {tuple(r) for r in knn_edges(v).collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_improved_from_a_warm_start(seed):
    ids, xy = site(seed)
    at = {i: k for k, i in enumerate(ids)}
    size = lambda p: sum(float(K.length(xy, at[a], at[b])) for a, b in p.items())
    start = K.esau_williams(ids, xy, K.available(xy), 3, rule="margin")
    better = K.improved_forest(ids, xy, 3, start)
    tri = {tuple(sorted(e)) for t in K.delaunay(xy) for e in itertools.combinations(t, 2)}
    bound = sum(float(K.length(xy, *e)) for e in K.spanning_forest(ids, xy, tri))
    assert bound <= size(better) <= size(start) + 1e-9 and _forest(better, 3) and sorted(better) == sorted(start)


@pytest.mark.parametrize("seed", range(3))
def test_exact_with_power_and_gates(seed):
    ids, xy = site(seed, 6, 1)
    free = K.exact_forest(ids, xy, 3)[0]
    few, parent = K.exact_forest(ids, xy, 3, gates=2)
    assert few >= free - 1e-9 and sum(p < 0 for p in parent.values()) == 2 and _forest(parent, 3)
    assert K.exact_forest(ids, xy, 2, gates=2) == (float("inf"), {})
    strong, parent = K.exact_forest(ids, xy, 3, power={0: 3, 1: 3})
    assert strong >= free - 1e-9 and parent[0] < 0 and parent[1] < 0 and not {0, 1} & set(parent.values())


@pytest.mark.parametrize("scale", [1, 300])
def test_crossings_by_cells(scale):
    rng = np.random.default_rng(4)
    xy = rng.integers(0, 40 * scale, (300, 2))
    xy[:3] = [[0, 0], [0, 40 * scale * 20], [5, 5]]  # a far point, and one cell that holds most
    a, b = rng.integers(0, 300, (400, 2)), rng.integers(0, 300, (150, 2))
    want = [(i, j) for i in range(len(a)) for j in np.flatnonzero(K.crosses(xy, *a[i], b[:, 0], b[:, 1])).tolist()]
    assert [tuple(p) for p in K.crossing_pairs(xy, a, b).tolist()] == want
    assert [tuple(p) for p in K.crossing_pairs(xy / 7, a, b).tolist()] == [(i, j) for i in range(len(a)) for j in np.flatnonzero(K.crosses(xy / 7, *a[i], b[:, 0], b[:, 1])).tolist()]
    i, j = np.triu_indices(len(a), 1)
    assert K.count_crossings(xy, a) == int(K.crosses(xy, a[i, 0], a[i, 1], a[j, 0], a[j, 1]).sum())


def test_crossings_of_many_edges_take_no_product():
    """20,000 short edges: all pairs would be 400 million tests, of which at most three for each near pair are made."""
    xy = np.array([(x * 10, y * 10) for x in range(101) for y in range(101)])
    k = np.array([x * 101 + y for x in range(100) for y in range(100)])
    edges = np.concatenate([np.stack([k, k + 102], axis=1), np.stack([k + 1, k + 101], axis=1)])
    tested, plain = [], K.crosses
    try:
        K.crosses = lambda xy, u, *rest: tested.append(np.size(u)) or plain(xy, u, *rest)
        assert K.count_crossings(xy, edges) == 10_000
    finally:
        K.crosses = plain
    assert sum(tested) < 1_000_000


def _all_savings(ids, xy, near):
    d = [(float(K.length(xy, u, v)) - max(near[u][0], near[v][0]), ids[u], ids[v], u, v) for u, v in itertools.combinations(sorted(near), 2)]
    return sorted(x for x in d if x[0] < 0)


@pytest.mark.parametrize("seed", range(2))
def test_savings_come_in_order(seed, monkeypatch):
    """Without joins, the lazy list is the sorted list of all pairs that save something."""
    monkeypatch.setattr(K, "FIRST", 2)
    ids, xy = site(seed, 60)
    near = K.nearest_root(ids, xy)
    assert list(K.by_saving(ids, xy, near, K.Free(near, 5))) == _all_savings(ids, xy, near)


def test_routes_hold_no_matrix():
    """4,000 points: a list of all distances alone would take over 400 MB."""
    import tracemalloc

    rng = np.random.default_rng(1)
    xy = rng.integers(0, 20_000, (4_000, 2))
    ids = [-2, -1, *range(3_998)]
    tracemalloc.start()
    routes = K.savings_routes(ids, xy, 3, rounds=0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(m for r in routes for m in r) == list(range(2, 4_000)) and max(map(len, routes)) <= 3
    assert most < 150e6


def test_repair_of_many_routes_tests_few_segments(monkeypatch):
    """400 hops in 200 routes with one crossing: only what lies about it is counted."""
    xy = np.array([(0, -500), (0, -501)] + [(20 * k + dx, dy) for k in range(200) for dx, dy in ((0, 0), (10, 10), (10, 20))])
    ids = [-2, -1, *range(600)]
    routes = [[2 + 3 * k, 3 + 3 * k, 4 + 3 * k] for k in range(200)]
    xy[[3, 6]] = [(25, 12), (5, 12)]
    before, tested, plain = K.count_crossings(xy, [e for r in routes for e in zip(r, r[1:])]), [], K.crosses
    monkeypatch.setattr(K, "crosses", lambda xy, *ends: tested.append(np.broadcast(*ends).size) or plain(xy, *ends))
    fixed = K.repair(ids, xy, routes)
    assert before and sum(tested) < 50_000 and sorted(m for r in fixed for m in r) == list(range(2, 602))
    monkeypatch.undo()
    assert K.count_crossings(xy, [e for r in fixed for e in zip(r, r[1:])]) < before


@pytest.mark.parametrize("capacity", [1, 3, 5, 8])
def test_classic_without_pairs(capacity, monkeypatch):
    """The same parents as over a list of all pairs, on a lattice with many equal lengths and coincident points, too."""
    monkeypatch.setattr(K, "FIRST", 4)
    rng = np.random.default_rng(capacity)
    for xy in (site(capacity, 60)[1], rng.integers(0, 7, (62, 2)) * 10):
        ids = [-2, -1, *range(len(xy) - 2)]
        every = list(itertools.combinations(range(len(xy)), 2))
        assert K.classic(ids, xy, capacity) == K.esau_williams(ids, xy, every, capacity, rule="weight", uncrossed=False)
    monkeypatch.setattr(K, "esau_williams", None)
    xy = rng.integers(0, 20_000, (1_500, 2))
    assert len(K.classic([-2, -1, *range(1_498)], xy, capacity)) == 1_498


def test_crossed_by_any():
    rng = np.random.default_rng(8)
    xy = rng.integers(0, 900, (120, 2))
    a, b = rng.integers(0, 120, (500, 2)), rng.integers(0, 120, (40, 2))
    assert K.crossed(xy, a, b).tolist() == [bool(K.crosses(xy, *e, b[:, 0], b[:, 1]).any()) for e in a]
    assert not K.crossed(xy, a, []).any()

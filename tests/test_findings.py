"""Sites with coincident points and with more than a thousand terminals."""

import math
import time
import tracemalloc

import duckdb
import numpy as np
import pytest

from cablewright.operators import joins, obstacles, polygons, rounds, solvers
from cablewright.operators import kernels as K
from cablewright.plans.catalogue import ORACLES, QUERIES
from cablewright.sources import routing

LONG = "site_id long, n long, x long, y long"


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """One site of 1,203 points on a spiral; two pairs coincide."""
    at = [(round(math.sqrt(k) * 40 * math.cos(2.4 * k)), round(math.sqrt(k) * 40 * math.sin(2.4 * k))) for k in range(1203)]
    at[700], at[701] = at[50], at[51]
    path = str(tmp_path_factory.mktemp("many"))
    rows = [(k, 0, [(x + 0.01) / 10_000, (y + 0.01) / 10_000]) for k, (x, y) in enumerate(at)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


def _equal(spark, sf, name):
    df = QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet'")
    cur = con.execute(ORACLES[name])
    order = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[k] for k in order)) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["gr2_expand", "geo8_line_distance", "top3_best_merge", "jn12_remap"])
def test_coincident_and_many(name, spark, many):
    _equal(spark, many, name)


def test_remap_matches_coincident_nodes_in_order(spark):
    a = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 10, 0), (0, 2, 5, 5), (0, 3, 5, 5), (0, -1, 5, 5)], LONG)
    assert {r["n"]: r["to"] for r in joins.remap(a, a).collect()} == {k: k for k in (0, 1, 2, 3, -1)}


def test_mesh_with_copies_covers_the_hull_once():
    """Among them sites whose first corner is doubled, which were meshed twice in places."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        xy = rng.integers(0, int(rng.integers(3, 10)), (int(rng.integers(5, 40)), 2))
        ring = xy[K.convex_ring(xy)]
        whole = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True))
        assert sum(int(K.orient(xy, *t)) for t in K.delaunay(xy)) == whole


def test_a_tile_is_meshed_in_little_time():
    """About 0.15 s; 2.3 s when each side looked for its apex anew."""
    xy = np.unique(np.random.default_rng(4).integers(0, 10_000, (1600, 2)), axis=0)
    start = time.process_time()
    K.delaunay(xy)
    assert time.process_time() - start < 1


def _scattered(spark, n, sites=1):
    at = np.random.default_rng(5).integers(0, 5000, (sites, n, 2)).tolist()
    return spark.createDataFrame([(s, k - 2, x, y) for s in range(sites) for k, (x, y) in enumerate(at[s])], LONG)


def test_pairs_of_a_site_are_dealt_to_many_tasks(spark):
    v = _scattered(spark, 60)
    for df in (joins.complete_graph(v), joins.length_matrix(v, joins.knn_edges(v))):
        parts = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(k > 0 for k in parts) > 20


def test_long_tours_take_little_time(spark):
    k = 20_000
    text = "DIMENSION : 1\nTOUR_SECTION\n1\n" + "\n".join(str(i + 2) for i in range(k)) + "\n-1\nEOF"
    start = time.monotonic()
    rows = routing.tours(spark.createDataFrame([(0, text)], "site_id long, tour string"), spark.createDataFrame([(0, k)], "site_id long, terminals long")).collect()
    assert [(r["route"], r["seq"], r["n"]) for r in sorted(rows, key=lambda r: r["seq"])] == [(0, i, i) for i in range(k)]
    assert time.monotonic() - start < 30


def test_problem_digests_are_those_of_the_texts(spark):
    from pyspark.sql import functions as F

    v = _scattered(spark, 40, 3).filter("n <> 7")
    e = joins.knn_edges(v)
    want = routing.problems(joins.length_matrix(v, e), 5).select("site_id", F.sha2("problem", 256).alias("digest"))
    assert sorted(routing.problem_digests(v, e, 5).collect()) == sorted(want.collect())


def test_contours_look_for_ways_from_corners_alone(spark, monkeypatch):
    v = _scattered(spark, 80)
    asked = []
    monkeypatch.setattr(obstacles.rounds, "ways_from", lambda e, s, f=rounds.ways_from: asked.append(s.count()) or f(e, s))
    around = polygons.box_border(v).unionByName(polygons.box_obstacle(v, 900))
    assert obstacles.contours(joins.knn_edges(v), v, around).count() > 4
    assert asked == [4]


def test_ways_send_no_sides_to_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(rounds, "work_table", lambda df, name, f=rounds.work_table: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or f(df, name))
    e = spark.createDataFrame([(0, k, k + 1, 1.0) for k in range(9)], "site_id long, u long, v long, w double")
    assert rounds.ways_from(e, spark.createDataFrame([(0, 0)], "site_id long, root long")).count() == 10
    assert all(p.split("InMemoryRelation")[0].count("SortMergeJoin") for name, p in plans[2:])


def test_detours_hold_no_matrix():
    xy = np.unique(np.random.default_rng(6).integers(0, 9000, (1000, 2)), axis=0)
    ids = [-1, *range(len(xy) - 1)]
    parent = K.esau_williams(ids, xy, K.available(xy), 5, rule="margin")
    tracemalloc.start()
    ways, failed = K.detours(ids, xy, parent)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 1,000 points: a matrix of lengths alone has 8 MB.
    assert ways and not failed and peak < 6e6, peak


@pytest.mark.parametrize("method", ["presolver", "crossing_preventing", "non_branching", "obstacle_bypassing"])
def test_only_gates_of_full_subtrees_are_held_against_edges(monkeypatch, method):
    """23,000 to 50,000 pairs of segments are tested on 900 points; 119,000 (presolver, non_branching) and 456,000 when all edges and all gates were."""
    xy = np.unique(np.random.default_rng(8).integers(0, 9000, (900, 2)), axis=0)
    ids = [-1, *range(len(xy) - 1)]
    edges, tested = K.available(xy), []
    monkeypatch.setattr(K, "crosses", lambda xy, u, v, s, t, f=K.crosses: tested.append(np.broadcast(u, s).size) or f(xy, u, v, s, t))
    parent = K.esau_williams(ids, xy, edges, 5, **solvers.SAVINGS[method])
    assert len(parent) == len(xy) - 1
    assert sum(tested) < 60_000, sum(tested)


def test_crossings_asked_for_are_all():
    rng = np.random.default_rng(9)
    for xy in (rng.integers(0, 60, (50, 2)), rng.random((50, 2)) * 1e-3):
        b = rng.integers(0, 30, (80, 2))
        met = K.Crossed(xy, b)
        for u, v in rng.integers(0, 50, (60, 2)).tolist():
            assert met.by(u, v) == np.flatnonzero(K.crosses(xy, u, v, b[:, 0], b[:, 1])).tolist()
    assert K.Crossed(xy, b[:0]).by(0, 1) == []


@pytest.mark.parametrize("n", [120, 480])
def test_a_task_has_no_more_pairs_the_larger_a_site(spark, monkeypatch, n):
    """With blocks of 10 points; a fixed number of parts gave the fullest task of the larger site 16 times the smaller one's pairs."""
    for name, k in (("BLOCK", 10), ("PAIR_TASKS", 4), ("SHARE", 2)):
        monkeypatch.setattr(joins, name, k)
    v = _scattered(spark, n)
    made = joins.complete_graph(v, prune=False)
    assert sorted((r.u, r.v) for r in made.collect()) == [(a, b) for a in range(n - 2) for b in range(a + 1, n - 2)]
    fullest = lambda df: max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
    assert fullest(made) < 2500
    assert fullest(joins.length_matrix(v, joins.knn_edges(v))) < 2500


def test_a_root_that_is_shut_in_is_looked_for_once(monkeypatch):
    """A box shuts in root -2: each of its 120 gates once had a search of all points, of which 46,987 views were found in 60 s, and it wasn't done; now 3 views are."""
    xy = np.unique(np.random.default_rng(10).integers(0, 9000, (500, 2)), axis=0)
    xy = np.concatenate([xy[(np.abs(xy - 4500) > 400).any(axis=1)], [[200, 200], [4500, 4500]]])
    ids = [*range(len(xy) - 2), -1, -2]
    corners = [(4200, 4200), (4200, 4800), (4800, 4800), (4800, 4200)]
    walls = [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    asked = []
    monkeypatch.setattr(K._Fixed, "seen", lambda self, *a, f=K._Fixed.seen: asked.append(1) or f(self, *a))
    parent = K.esau_williams(ids, xy, K.available(xy), 5, rule="bins", gates_block=True, rootlust=0.6, blocked=walls)
    ways, failed = K.detours(ids, xy, parent, walls)
    to = {a: w[-1] for a, w in ways.items()}
    assert failed and {parent[a] for a in failed} == {-2} and -2 not in to.values()
    assert len(asked) < 1500, len(asked)


def test_views_are_what_no_segment_hides():
    rng = np.random.default_rng(11)
    for xy in (rng.integers(0, 60, (120, 2)), rng.integers(0, 10_000, (120, 2)), rng.random((120, 2)) * 1e-3):
        s = rng.integers(0, 120, (700, 2))
        plain = lambda k, m: np.flatnonzero(~K.crosses(xy, k, np.arange(100)[:, None], s[None, :m, 0], s[None, :m, 1]).any(axis=1)).tolist()
        fixed = K._Fixed(xy, s[:30], np.arange(100))
        for m in (30, 33, 60, 700):
            for t in s[fixed.count : m].tolist():
                fixed.add(*t)
            for k in range(0, 120, 3):
                assert fixed.view(k).tolist() == plain(k, m)
        fresh = K._Fixed(xy, s, np.arange(100))
        assert all(fresh.view(k).tolist() == plain(k, 700) for k in range(0, 120, 3))


def test_no_way_leads_over_a_point_within_an_obstacle(spark):
    """Point 1 lies on a diagonal of the box: a way over it went from corner to corner through the box."""
    at = {-1: (-600, 600), -2: (700, 0), 0: (600, -600), 1: (150, 150), 2: (-900, 0)}
    v = spark.createDataFrame([(0, n, *p) for n, p in at.items()], LONG)
    box = spark.createDataFrame([(0, 1, k, x, y) for k, (x, y) in enumerate([(-300, -300), (-300, 300), (300, 300), (300, -300)])], "site_id long, poly_id long, seq int, x long, y long")
    got = {(r["n"], r["root"]): r["length"] for r in obstacles.root_distances(v, box).collect()}
    way = lambda *p: round(1000 * sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False)))
    assert got[0, -1] == way(at[-1], (300, 300), at[0]) and got[2, -1] == way(at[-1], at[2])
    assert got[1, -1] == way(at[-1], (-300, 300), at[1]) and got[2, -2] == way(at[-2], (300, 300), (-300, 300), at[2])


def test_ways_from_a_site_without_edges_end(spark):
    e = spark.createDataFrame([(0, 1, 2, 1.0)], "site_id long, u long, v long, w double")
    start = spark.createDataFrame([(0, -1, 1, 2.0), (5, -1, 7, 3.0)], "site_id long, root long, n long, way double")
    assert sorted(tuple(r) for r in rounds.ways_from(e, start).collect()) == [(0, -1, 1, 2.0), (0, -1, 2, 3.0), (5, -1, 7, 3.0)]


def test_remap_finds_the_nearest_by_cells(spark, monkeypatch):
    """b has other nodes than a beside 0 and 1, and lies partly elsewhere; all pairs of a site were compared before."""
    a, b = _scattered(spark, 200), _scattered(spark, 120, 2).filter("site_id = 1").selectExpr("0L AS site_id", "n", "2 * x AS x", "3 * y - 900 AS y")
    rows = lambda df: {r["n"]: complex(r["x"], r["y"]) for r in df.collect()}
    p, q = rows(a), rows(b)
    turn = (q[1] - q[0]) / (p[1] - p[0])
    met = []
    monkeypatch.setattr(joins, "about", lambda *x, f=joins.about: met.append(f(*x)) or met[-1])
    got = {r["n"]: r["to"] for r in joins.remap(a, b).collect()}
    assert got == {n: min((round(abs(q[0] + (z - p[0]) * turn - w) ** 2, 3), m) for m, w in q.items() if (m < 0) == (n < 0))[1] for n, z in p.items()}
    met.clear()
    joins.remap(a, a).collect()
    assert met[0].count() < 200 * 60

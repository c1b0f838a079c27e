"""The registered queries over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import joins, mesh, polygons, solvers, trees
from ..operators import kernels as K
from ..sources import coordinates, store, synthetic
from ..sources.fixtures import vertices
from ..streaming import replay
from . import flagship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_C1 = """v AS (SELECT site_id, CASE WHEN rn <= 2 THEN -rn ELSE rn - 3 END AS n, x, y FROM (
  SELECT CAST(label AS BIGINT) AS site_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn,
    CAST(round(CAST(embedding[1] AS DOUBLE) * 10000) AS BIGINT) AS x, CAST(round(CAST(embedding[2] AS DOUBLE) * 10000) AS BIGINT) AS y FROM embeddings) q)"""
_D = """d AS (SELECT t.site_id, t.n, r.n AS root, t.x, t.y, r.x AS rx, r.y AS ry, (t.x - r.x) * (t.x - r.x) + (t.y - r.y) * (t.y - r.y) AS d2
  FROM v t JOIN v r ON t.site_id = r.site_id AND t.n >= 0 AND r.n < 0),
near AS (SELECT site_id, n, root, d2 FROM (SELECT *, row_number() OVER (PARTITION BY site_id, n ORDER BY d2, root) AS k FROM d) q WHERE k = 1)"""
_FOREST = """up AS (SELECT a.site_id, a.root, a.n AS parent, t.x AS px, t.y AS py, a.d2 AS pd FROM near a JOIN v t ON t.site_id = a.site_id AND t.n = a.n
  UNION ALL SELECT site_id, n, n, x, y, 0 FROM v WHERE n < 0),
f AS (SELECT site_id, n, root, parent, l2 FROM (SELECT a.site_id, a.n, a.root, u.parent, (t.x - u.px) * (t.x - u.px) + (t.y - u.py) * (t.y - u.py) AS l2,
    row_number() OVER (PARTITION BY a.site_id, a.n ORDER BY (t.x - u.px) * (t.x - u.px) + (t.y - u.py) * (t.y - u.py), u.parent) AS k
  FROM near a JOIN v t ON t.site_id = a.site_id AND t.n = a.n JOIN up u ON u.site_id = a.site_id AND u.root = a.root AND u.pd < a.d2) q WHERE k = 1)"""
_ANC = """anc AS (SELECT site_id, n AS leaf, n AS node, parent, 1 AS hops FROM f UNION ALL
  SELECT a.site_id, a.leaf, f.n, f.parent, a.hops + 1 FROM anc a JOIN f ON f.site_id = a.site_id AND f.n = a.parent),
top AS (SELECT site_id, leaf AS n, node AS subtree, hops AS depth FROM anc WHERE parent < 0),
ld AS (SELECT site_id, node AS n, count(*) AS load FROM anc GROUP BY site_id, node),
l AS (SELECT f.site_id, f.n, f.root, f.parent, ld.load, top.subtree, top.depth FROM f JOIN ld USING (site_id, n) JOIN top USING (site_id, n))"""
_LEN = """len AS (SELECT l.*, CAST(round(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) * 1000) AS BIGINT) AS length
  FROM l JOIN v a ON a.site_id = l.site_id AND a.n = l.n JOIN v b ON b.site_id = l.site_id AND b.n = l.parent)"""
_KNN = """e AS (SELECT DISTINCT site_id, least(u, v) AS u, greatest(u, v) AS v, l2 FROM (SELECT a.site_id, a.n AS u, b.n AS v, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS l2,
  row_number() OVER (PARTITION BY a.site_id, a.n ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.n) AS k FROM v a JOIN v b ON a.site_id = b.site_id AND a.n <> b.n) q WHERE k <= 4)"""
_TRI = """o AS (SELECT a.site_id, a.n AS a, b.n AS b, c.n AS c, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy, c.x AS cx, c.y AS cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn
  FROM v a JOIN v b ON a.site_id = b.site_id AND a.n < b.n JOIN v c ON b.site_id = c.site_id AND b.n < c.n),
tri AS (SELECT site_id, a, b, c FROM o WHERE turn <> 0 AND NOT EXISTS (SELECT 1 FROM v d WHERE d.site_id = o.site_id AND d.n <> o.a AND d.n <> o.b AND d.n <> o.c AND sign(o.turn) * (
  ((ax - d.x) * (ax - d.x) + (ay - d.y) * (ay - d.y)) * ((qx - d.x) * (cy - d.y) - (qy - d.y) * (cx - d.x))
  - ((qx - d.x) * (qx - d.x) + (qy - d.y) * (qy - d.y)) * ((ax - d.x) * (cy - d.y) - (ay - d.y) * (cx - d.x))
  + ((cx - d.x) * (cx - d.x) + (cy - d.y) * (cy - d.y)) * ((ax - d.x) * (qy - d.y) - (ay - d.y) * (qx - d.x))) > 0)),
sd AS (SELECT site_id, a AS u, b AS v, c AS w FROM tri UNION ALL SELECT site_id, a, c, b FROM tri UNION ALL SELECT site_id, b, c, a FROM tri)"""


def _turn(a: str, b: str, c: str) -> str:
    return f"(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def _meet(u: str, v: str, s: str, t: str, op: str = "<") -> str:
    return f"sign({_turn(u, v, s)}) * sign({_turn(u, v, t)}) {op} 0 AND sign({_turn(s, t, u)}) * sign({_turn(s, t, v)}) {op} 0"


_PTS = "p4 AS (SELECT q.*, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, c.x AS sx, c.y AS sy, g.x AS tx, g.y AS ty FROM {0} q JOIN v a ON a.site_id = q.site_id AND a.n = q.u JOIN v b ON b.site_id = q.site_id AND b.n = q.v JOIN v c ON c.site_id = q.site_id AND c.n = q.s JOIN v g ON g.site_id = q.site_id AND g.n = q.t)"
_TWO = f"two AS (SELECT site_id, u, v, min(w) AS s, max(w) AS t FROM sd GROUP BY site_id, u, v HAVING min(w) < max(w)), {_PTS.format('two')}, dg AS (SELECT site_id, s, t, u, v FROM p4 WHERE {_meet('u', 'v', 's', 't')})"
_PAIRS = "pr AS (SELECT a.site_id, a.u, a.v, b.u AS s, b.v AS t FROM {0} a JOIN {0} b ON a.site_id = b.site_id AND (a.u < b.u OR (a.u = b.u AND a.v < b.v)) AND a.u <> b.u AND a.u <> b.v AND a.v <> b.u AND a.v <> b.v)"


def query(name: str, sql: str | None = None):
    """Registers a function (spark, v, sf_dir), v being the fixture's vertices, under `name`."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, vertices(spark, sf_dir), sf_dir)
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts)


_BASE = (_C1, _D)
_LOADS = _with(_C1, _D, _FOREST, _ANC, _LEN, recursive=True)

query("src8_vertices", f"{_with(_C1)} SELECT site_id, n, x, y FROM v")(lambda spark, v, d: v)
query("jn1_d2roots", f"{_with(*_BASE)} SELECT site_id, n, root, d2, dense_rank() OVER (PARTITION BY site_id, root ORDER BY d2) AS dist_rank, dense_rank() OVER (PARTITION BY site_id, root ORDER BY atan2(CAST(y - ry AS DOUBLE), CAST(x - rx AS DOUBLE))) AS angle_rank, x > rx AS xhp, y > ry AS yhp FROM d")(lambda spark, v, d: joins.d2roots(v))
query("jn3_assign_root", f"{_with(*_BASE)} SELECT site_id, n, root, d2 FROM near")(lambda spark, v, d: joins.assign_root(v))
query("jn2_complete_graph", f"{_with(_C1)} SELECT a.site_id, a.n AS u, b.n AS v, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS l2 FROM v a JOIN v b ON a.site_id = b.site_id AND a.n < b.n AND a.n >= 0 WHERE NOT EXISTS (SELECT 1 FROM v r WHERE r.site_id = a.site_id AND r.n < 0 AND (a.x - r.x) * (b.x - r.x) + (a.y - r.y) * (b.y - r.y) < 0)")(lambda spark, v, d: joins.complete_graph(v))
query("jn4_edge_root", f"{_with(_C1, _KNN)} SELECT site_id, u, v, root FROM (SELECT e.site_id, e.u, e.v, r.n AS root, row_number() OVER (PARTITION BY e.site_id, e.u, e.v ORDER BY (a.x + b.x - 2 * r.x) * (a.x + b.x - 2 * r.x) + (a.y + b.y - 2 * r.y) * (a.y + b.y - 2 * r.y), r.n) AS k FROM e JOIN v a ON a.site_id = e.site_id AND a.n = e.u JOIN v b ON b.site_id = e.site_id AND b.n = e.v JOIN v r ON r.site_id = e.site_id AND r.n < 0) q WHERE k = 1")(lambda spark, v, d: joins.edge_root(v, joins.knn_edges(v)))
query("top_knn_edges", f"{_with(_C1, _KNN)} SELECT site_id, u, v, l2 FROM e")(lambda spark, v, d: joins.knn_edges(v))
query("jn5_crossings", f"{_with(_C1, _KNN, _PAIRS.format('e'), _PTS.format('pr'))} SELECT site_id, u, v, s, t FROM p4 WHERE {_meet('u', 'v', 's', 't')}")(lambda spark, v, d: joins.crossings(joins.knn_edges(v), v))
query("jn6_interferences", f"{_with(_C1, _KNN, _PAIRS.format('e'), _PTS.format('pr'))} SELECT site_id, u, v, s, t, CASE WHEN {_turn('s', 't', 'u')} = 0 THEN 0 WHEN {_turn('s', 't', 'v')} = 0 THEN 1 WHEN {_turn('u', 'v', 's')} = 0 THEN 2 WHEN {_turn('u', 'v', 't')} = 0 THEN 3 END AS touching FROM p4 WHERE {_meet('u', 'v', 's', 't', '<=')} AND (vx - ux) * (ty - sy) - (vy - uy) * (tx - sx) <> 0")(lambda spark, v, d: joins.interferences(joins.knn_edges(v), v))
query("jn7_gate_crossings", f"{_with(*_BASE, _KNN, 'pr AS (SELECT d.site_id, d.root AS s, d.n AS t, e.u, e.v FROM d JOIN e ON e.site_id = d.site_id AND e.u >= 0 AND e.u <> d.n AND e.v <> d.n)', _PTS.format('pr'))} SELECT site_id, s AS root, t AS n, u, v FROM p4 WHERE {_meet('u', 'v', 's', 't', '<=')}")(lambda spark, v, d: joins.gate_crossings(joins.d2roots(v), joins.knn_edges(v), v))
query("jn12_remap", f"{_with(_C1)} SELECT site_id, n, n AS \"to\" FROM v")(lambda spark, v, d: joins.remap(v, v.select("site_id", "n", (300 - 2 * F.col("y")).alias("x"), (2 * F.col("x") - 70).alias("y"))))
query("jn18_length_matrix", f"{_with(_C1, _KNN)} SELECT a.site_id, a.n AS i, b.n AS j, CASE WHEN b.n = -1 THEN 0 WHEN a.n = -1 OR EXISTS (SELECT 1 FROM e WHERE e.site_id = a.site_id AND e.u = least(a.n, b.n) AND e.v = greatest(a.n, b.n)) THEN CAST(round(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) * 1000) AS BIGINT) END AS length FROM v a JOIN v b ON a.site_id = b.site_id AND a.n <> b.n AND a.n >= -1 AND b.n >= -1")(lambda spark, v, d: joins.length_matrix(v, joins.knn_edges(v)))
query("seed_forest", f"{_with(*_BASE, _FOREST)} SELECT site_id, n, root, parent, l2 FROM f")(lambda spark, v, d: trees.seed_forest(v))
query("agg1_tree_load", f"{_LOADS} SELECT site_id, n, root, parent, load, subtree, CAST(depth AS BIGINT) AS depth FROM l")(lambda spark, v, d: trees.tree_loads(trees.seed_forest(v)))
query("agg5_num_gates", f"{_with(*_BASE, _FOREST)} SELECT v.site_id, v.n AS root, (SELECT count(*) FROM f WHERE f.site_id = v.site_id AND f.parent = v.n) AS num_gates FROM v WHERE v.n < 0")(lambda spark, v, d: trees.gates_per_root(trees.seed_forest(v), v))
query("agg14_degree", f"{_with(*_BASE, _FOREST)} SELECT site_id, n, count(*) AS degree FROM (SELECT site_id, n FROM f UNION ALL SELECT site_id, parent FROM f) q GROUP BY site_id, n")(lambda spark, v, d: trees.degrees(trees.seed_forest(v)))
query("jn13_cables", f"{_LOADS}, cb(cable, capacity, cost) AS (VALUES (0, 3, 206), (1, 5, 287), (2, 200, 406)) SELECT site_id, n, parent, load, length, CAST((SELECT min(cable) FROM cb WHERE capacity >= load) AS BIGINT) AS cable, CAST(length * (SELECT cost FROM cb WHERE capacity >= load ORDER BY capacity LIMIT 1) AS BIGINT) AS cost FROM len")(lambda spark, v, d: trees.cabled(trees.seed_forest(v), v, flagship.cables(spark)))
query("snk9_edge_table", f"{_LOADS}, cb(cable, capacity, cost) AS (VALUES (0, 3, 206), (1, 5, 287), (2, 200, 406)) SELECT site_id, CASE WHEN n >= 0 THEN n + 3 ELSE -n END AS u, CASE WHEN parent >= 0 THEN parent + 3 ELSE -parent END AS v, length, load, CAST((SELECT min(cable) FROM cb WHERE capacity >= load) AS BIGINT) AS cable, CAST(length * (SELECT cost FROM cb WHERE capacity >= load ORDER BY capacity LIMIT 1) AS BIGINT) AS cost FROM len")(lambda spark, v, d: trees.edge_table(trees.seed_forest(v), v, flagship.cables(spark)))
query("src11_edge_import", f"{_LOADS} SELECT site_id, n, parent, load FROM l")(lambda spark, v, d: trees.from_edge_table(trees.edge_table(trees.seed_forest(v), v, flagship.cables(spark))))
query("agg8_summary", f"{_LOADS} SELECT site_id, count(*) AS terminals, count(*) FILTER (WHERE parent < 0) AS gates, count(*) FILTER (WHERE parent < 0) - CAST(ceil(count(*) / 5.0) AS BIGINT) AS excess_gates, CAST(sum(length) AS BIGINT) AS length, max(load) AS max_load FROM len GROUP BY site_id")(lambda spark, v, d: trees.summary(trees.seed_forest(v), v, 5))
query("agg9_path_lengths", f"{_LOADS} SELECT a.site_id, a.leaf, min(a.parent) AS root, count(*) AS hops, CAST(sum(len.length) AS BIGINT) AS length FROM anc a JOIN len ON len.site_id = a.site_id AND len.n = a.node WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.site_id = a.site_id AND f.parent = a.leaf) GROUP BY a.site_id, a.leaf")(lambda spark, v, d: trees.path_lengths(trees.seed_forest(v), v))
query("win5_countdown", f"{_LOADS} SELECT site_id, subtree, n, row_number() OVER (PARTITION BY site_id, subtree ORDER BY depth, n) AS place, count(*) OVER (PARTITION BY site_id, subtree) - row_number() OVER (PARTITION BY site_id, subtree ORDER BY depth, n) + 1 AS countdown FROM l")(lambda spark, v, d: trees.route_positions(trees.seed_forest(v)))
query("val1_validate", f"{_LOADS}, e AS (SELECT site_id, parent AS u, n AS v FROM f), {_PAIRS.format('e')}, {_PTS.format('pr')}, x AS (SELECT site_id, count(*) AS c FROM p4 WHERE {_meet('u', 'v', 's', 't')} GROUP BY site_id) SELECT site_id, CAST(0 AS BIGINT) AS missing, count(*) FILTER (WHERE load > 5) AS overloaded, coalesce(max(c), 0) AS crossings FROM l LEFT JOIN x USING (site_id) GROUP BY site_id")(lambda spark, v, d: trees.validate(trees.seed_forest(v), v, 5))
query("gr5_hooked_nearest", f"{_LOADS} SELECT site_id, root, subtree, hook, d2 FROM (SELECT l.site_id, l.root, l.subtree, l.n AS hook, d.d2, row_number() OVER (PARTITION BY l.site_id, l.root, l.subtree ORDER BY d.d2, l.n) AS k FROM l JOIN d ON d.site_id = l.site_id AND d.n = l.n AND d.root = l.root) q WHERE k = 1")(lambda spark, v, d: trees.hooked_to_nearest(trees.seed_forest(v), v))
query("gr6_hooked_head", f"{_LOADS}, dgr AS (SELECT site_id, n, count(*) AS g FROM (SELECT site_id, n FROM f UNION ALL SELECT site_id, parent FROM f) q GROUP BY site_id, n), bad AS (SELECT DISTINCT l.site_id, l.subtree FROM l JOIN dgr USING (site_id, n) WHERE g > 2) SELECT site_id, root, subtree, hook, d2 FROM (SELECT l.site_id, l.root, l.subtree, l.n AS hook, d.d2, row_number() OVER (PARTITION BY l.site_id, l.root, l.subtree ORDER BY d.d2, l.n) AS k FROM l JOIN dgr USING (site_id, n) JOIN d ON d.site_id = l.site_id AND d.n = l.n AND d.root = l.root WHERE (g = 1 OR l.n = l.subtree) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.site_id = l.site_id AND bad.subtree = l.subtree)) q WHERE k = 1")(lambda spark, v, d: trees.hooked_to_head(trees.seed_forest(v), v))
query("gr7_terse_roundtrip", f"{_with(*_BASE, _FOREST)} SELECT site_id, n, parent FROM f")(lambda spark, v, d: trees.unterse(trees.terse(trees.seed_forest(v))))
query("replay_events", f"{_with(*_BASE, _FOREST)} SELECT site_id AS instance_id, parent AS u, n AS v FROM f")(lambda spark, v, d: replay.replay(replay.star_log(trees.seed_forest(v))))
query("mesh2_delaunay", f"{_with(_C1, _TRI)} SELECT site_id, a, b, c FROM tri")(lambda spark, v, d: mesh.triangles(v))
query("mesh3_sides", f"{_with(_C1, _TRI)} SELECT site_id, u, v, w FROM sd")(lambda spark, v, d: mesh.sides(mesh.triangles(v)))
query("mesh3_half_edges", f"{_with(_C1, _TRI)}, h AS (SELECT q.site_id, q.u, q.v, atan2(CAST(b.y - a.y AS DOUBLE), CAST(b.x - a.x AS DOUBLE)) AS g FROM (SELECT DISTINCT site_id, u, v FROM sd UNION SELECT DISTINCT site_id, v, u FROM sd) q JOIN v a ON a.site_id = q.site_id AND a.n = q.u JOIN v b ON b.site_id = q.site_id AND b.n = q.v) SELECT site_id, u, v, coalesce(lead(v) OVER w, first_value(v) OVER (PARTITION BY site_id, u ORDER BY g)) AS ccw, coalesce(lag(v) OVER w, last_value(v) OVER (PARTITION BY site_id, u ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS cw FROM h WINDOW w AS (PARTITION BY site_id, u ORDER BY g)")(lambda spark, v, d: mesh.half_edges(mesh.triangles(v), v))
query("mesh4_hull_edges", f"{_with(_C1, _TRI)} SELECT site_id, u, v FROM sd GROUP BY site_id, u, v HAVING count(*) = 1")(lambda spark, v, d: mesh.hull_edges(mesh.triangles(v)))
query("mesh5_diagonals", f"{_with(_C1, _TRI, _TWO)} SELECT site_id, s, t, u, v FROM dg")(lambda spark, v, d: mesh.diagonals(mesh.triangles(v), v))
query("mesh14_available_edges", f"{_with(_C1, _TRI, _TWO)} SELECT q.site_id, q.u, q.v, kind, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS l2 FROM (SELECT DISTINCT site_id, u, v, 'delaunay' AS kind FROM sd UNION ALL SELECT site_id, s, t, 'extended' FROM dg) q JOIN v a ON a.site_id = q.site_id AND a.n = q.u JOIN v b ON b.site_id = q.site_id AND b.n = q.v")(lambda spark, v, d: mesh.available_edges(mesh.triangles(v), v))
query("jn9_exclusive_pairs", f"{_with(_C1, _TRI, _TWO)}, e AS (SELECT DISTINCT site_id, u, v FROM sd UNION SELECT site_id, s, t FROM dg), {_PAIRS.format('e')}, {_PTS.replace('p4 AS', 'p5 AS').format('pr')} SELECT site_id, u, v, s, t FROM p5 WHERE {_meet('u', 'v', 's', 't')}")(lambda spark, v, d: mesh.exclusive_pairs(mesh.triangles(v), v))
query("agg4_kind_counts", f"{_with(*_BASE, _FOREST, _TRI, _TWO)}, av AS (SELECT DISTINCT site_id, u, v, 'delaunay' AS kind FROM sd UNION ALL SELECT site_id, s, t, 'extended' FROM dg) SELECT f.site_id, CASE WHEN f.parent < 0 THEN 'gate' ELSE coalesce(av.kind, 'rogue') END AS kind, count(*) AS edges FROM f LEFT JOIN av ON av.site_id = f.site_id AND av.u = least(f.n, f.parent) AND av.v = greatest(f.n, f.parent) GROUP BY ALL")(lambda spark, v, d: trees.kind_counts(trees.seed_forest(v).select("site_id", F.col("parent").alias("u"), F.col("n").alias("v")), mesh.available_edges(mesh.triangles(v), v)))
query("agg6_area_perimeter", f"{_with(_C1)}, b AS (SELECT site_id, min(x) - 500 AS x0, max(x) + 500 AS x1, min(y) - 500 AS y0, max(y) + 500 AS y1 FROM v GROUP BY site_id) SELECT site_id, 0 AS poly_id, 2 * (x1 - x0) * (y1 - y0) AS area2, 2000 * (x1 - x0 + y1 - y0) AS perimeter FROM b UNION ALL SELECT site_id, 1, -2 * 600 * 600, 4 * 600 * 1000 FROM b")(lambda spark, v, d: polygons.area_perimeter(polygons.box_border(v).unionByName(polygons.box_obstacle(v))))
query("geo16_point_in_polygon", f"{_with(_C1)}, b AS (SELECT site_id, 0 AS poly_id, min(x) - 500 AS x0, max(x) + 500 AS x1, min(y) - 500 AS y0, max(y) + 500 AS y1 FROM v GROUP BY site_id UNION ALL SELECT site_id, 1, CAST(floor(avg(x)) AS BIGINT) - 300, CAST(floor(avg(x)) AS BIGINT) + 300, CAST(floor(avg(y)) AS BIGINT) - 300, CAST(floor(avg(y)) AS BIGINT) + 300 FROM v GROUP BY site_id) SELECT v.site_id, poly_id, n, x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AS inside FROM v JOIN b USING (site_id)")(lambda spark, v, d: polygons.contains(v, polygons.box_border(v).unionByName(polygons.box_obstacle(v))))
query("geo17_clears", f"{_with(_C1)} SELECT site_id, n, x, y FROM v WHERE n >= 0 AND NOT EXISTS (SELECT 1 FROM v r WHERE r.site_id = v.site_id AND r.n < 0 AND (v.x - r.x) * (v.x - r.x) + (v.y - r.y) * (v.y - r.y) < 4000000)")(lambda spark, v, d: polygons.clears(v.filter("n >= 0"), v.filter("n < 0"), 2000))
query("prj2_normalize", f"{_with(_C1)}, b AS (SELECT site_id, min(x) AS x0, min(y) AS y0, sqrt(CAST((max(x) - min(x)) * (max(y) - min(y)) AS DOUBLE)) AS s FROM v GROUP BY site_id) SELECT site_id, n, CAST(round((x - x0) / s * 1000000) AS BIGINT) AS x, CAST(round((y - y0) / s * 1000000) AS BIGINT) AS y FROM v JOIN b USING (site_id)")(lambda spark, v, d: polygons.normalize(v))
query("prj3_rescale", f"{_with(_C1)} SELECT site_id, n, x, y FROM v")(lambda spark, v, d: polygons.rescale(polygons.normalize(v), v))
query("prj5_single_root", f"{_with(_C1)} SELECT site_id, n, x, y FROM v WHERE n >= 0 UNION ALL SELECT site_id, CAST(-1 AS BIGINT), CAST(floor(avg(x)) AS BIGINT), CAST(floor(avg(y)) AS BIGINT) FROM v WHERE n < 0 GROUP BY site_id")(lambda spark, v, d: polygons.single_root(v))
query("prj7_frame", f"{_with(_C1)} SELECT site_id, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS w, max(y) - min(y) AS h FROM v GROUP BY site_id")(lambda spark, v, d: polygons.frame(v))
query("geo_scalars", f"{_with(_C1)}, t AS (SELECT a.site_id, a.n, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, c.x AS sx, c.y AS sy FROM v a JOIN v b ON b.site_id = a.site_id AND b.n = -1 JOIN v c ON c.site_id = a.site_id AND c.n = -2 WHERE a.n >= 0) SELECT site_id, n, {_turn('u', 'v', 's')} AS turn, {_turn('u', 'v', 's')} > 0 AS ccw, round(abs({_turn('v', 's', 'u')}) / sqrt((vx - sx) * (vx - sx) + (vy - sy) * (vy - sy)), 3) AS line, round(atan2((vx - ux) * (sy - uy) - (vy - uy) * (sx - ux), (vx - ux) * (sx - ux) + (vy - uy) * (sy - uy)), 6) AS angle, round(CASE WHEN {_turn('u', 'v', 's')} <> 0 THEN greatest((ux - vx) * (ux - vx) + (uy - vy) * (uy - vy), (vx - sx) * (vx - sx) + (vy - sy) * (vy - sy), (sx - ux) * (sx - ux) + (sy - uy) * (sy - uy)) * 0.8660254037844386 / abs({_turn('u', 'v', 's')}) END, 3) AS aspect FROM t")(lambda spark, v, d: _scalars(v))
query("geo11_opposite_sides", f"{_with(_C1)} SELECT v.site_id, max(sign({_turn('a.', 'b.', 'v.')})) > 0 AND min(sign({_turn('a.', 'b.', 'v.')})) < 0 AS opposite FROM v JOIN v a ON a.site_id = v.site_id AND a.n = -1 JOIN v b ON b.site_id = v.site_id AND b.n = -2 WHERE v.n >= 0 GROUP BY v.site_id")(lambda spark, v, d: _opposite(v))
query("snk3_node_sets", f"{_with(_C1)} SELECT site_id, sha256(string_agg(n || ':' || x || ':' || y, ';' ORDER BY n)) AS digest, count(*) FILTER (WHERE n >= 0) AS T, count(*) FILTER (WHERE n < 0) AS R FROM v GROUP BY site_id")(lambda spark, v, d: store.node_sets(v))
query("snk1_store_roundtrip", f"{_LOADS} SELECT site_id, count(*) AS terminals, CAST(sum(length) AS BIGINT) AS length, CAST(0 AS BIGINT) AS added_again FROM len GROUP BY site_id")(lambda spark, v, d: _stored(spark, v))
query("top3_best_merge", f"{_with(*_BASE, _KNN)}, m AS (SELECT e.site_id, d.n, e.u, e.v, sqrt(CAST(e.l2 AS DOUBLE)) AS w, d.d2 FROM e JOIN near d ON d.site_id = e.site_id AND (d.n = e.u OR d.n = e.v) WHERE e.u >= 0), k AS (SELECT q.*, row_number() OVER (PARTITION BY site_id, n ORDER BY w, u, v) AS r1, row_number() OVER (PARTITION BY site_id, n ORDER BY round_even(20 * w / mw, 0), d2x, u, v) AS r3 FROM (SELECT m.*, min(w) OVER (PARTITION BY m.site_id, m.n) AS mw, least(a.d2, b.d2) AS d2x FROM m JOIN near a ON a.site_id = m.site_id AND a.n = m.u JOIN near b ON b.site_id = m.site_id AND b.n = m.v) q) SELECT a.site_id, a.n, a.u AS u2, a.v AS v2, b.u AS u3, b.v AS v3 FROM k a JOIN k b ON a.site_id = b.site_id AND a.n = b.n AND a.r1 = 1 AND b.r3 = 1")(lambda spark, v, d: _merges(v))

_EXPECT = f"{_with(_C1)}, t AS (SELECT site_id, count(*) AS t FROM v WHERE n >= 0 GROUP BY site_id), g(method) AS (VALUES {{0}}), c(capacity) AS (VALUES (3), (5), (8)) SELECT site_id, method, capacity, CAST(0 AS BIGINT) AS missing, t AS links, CAST(0 AS BIGINT) AS overloads, {{1}} FROM t, g, c"


def _instances(name: str, methods: list[str], columns: dict[str, str]) -> None:
    sql = _EXPECT.format(", ".join(f"('{m}')" for m in methods), ", ".join(f"{x} AS {c}" for c, x in columns.items()))
    query(name, sql)(lambda spark, v, d: solvers.check(solvers.solve(v, methods, [3, 5, 8]), v).select("site_id", "method", "capacity", "missing", "links", "overloads", *columns))


_ZERO = "CAST(0 AS BIGINT)"
_instances("vr1_routes", ["routes"], {"branchings": _ZERO})
_instances("rp1_repair", ["routes_repaired"], {"branchings": _ZERO})


def _corner(v: DataFrame) -> DataFrame:
    r = lambda k, c: v.filter(F.col("n") == k).select("site_id", F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    return v.filter("n >= 0").select("site_id", "n", F.col("x").alias("ux"), F.col("y").alias("uy")).join(r(-1, "v"), "site_id").join(r(-2, "s"), "site_id")


def _scalars(v: DataFrame) -> DataFrame:
    u, w, s = (G.point(c) for c in "uvs")
    return _corner(v).select("site_id", "n", G.orientation(u, w, s).alias("turn"), G.ccw(u, w, s).alias("ccw"), F.round(G.distance_to_line(u, w, s), 3).alias("line"), F.round(G.angle(w, u, s), 6).alias("angle"), F.round(G.aspect_ratio(u, w, s), 3).alias("aspect"))


def _opposite(v: DataFrame) -> DataFrame:
    u, w, s = (G.point(c) for c in "uvs")
    return _corner(v).groupBy("site_id").agg(G.opposite_sides(u, w, s).alias("opposite"))


def _stored(spark: SparkSession, v: DataFrame) -> DataFrame:
    """Written, written again, and read back."""
    path = store.folder(spark)
    nodes, routes = store.node_sets(v), store.route_sets(trees.seed_forest(v), v, 5, "seed")
    for _ in range(2):
        store.add_absent(spark, nodes, f"{path}/nodesets", ["digest"])
        again = store.add_absent(spark, routes, f"{path}/routesets", ["nodes", "method", "capacity"])
    back = store.load(spark, path, [5], "seed")
    return back.select("site_id", F.size("edges").cast("long").alias("terminals"), "length", F.lit(again).cast("long").alias("added_again"))


def _merges(v: DataFrame) -> DataFrame:
    """The best merge edge of each terminal: by weight, and by twentieths of the least weight and then closeness to the root."""
    from pyspark.sql import Window

    near = joins.assign_root(v)
    e = joins.knn_edges(v).filter("u >= 0")
    m = near.select("site_id", "n", "d2").join(e.select("site_id", "u", "v", "l2"), "site_id").filter("n = u OR n = v").withColumn("w", F.sqrt(F.col("l2").cast("double")))
    d = near.select("site_id", F.col("n").alias("k"), F.col("d2").alias("kd"))
    m = m.join(d.select("site_id", F.col("k").alias("u"), F.col("kd").alias("ud")), ["site_id", "u"]).join(d.select("site_id", F.col("k").alias("v"), F.col("kd").alias("vd")), ["site_id", "v"])
    part = Window.partitionBy("site_id", "n")
    m = m.withColumn("least", F.min("w").over(part))
    # Beside a least weight of 0 (coincident terminals) others are infinitely many twentieths, and 0 itself is no number of them, which comes last, as in SQL.
    none = F.when(F.col("w") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    m = m.withColumn("b", F.when(F.col("least") == 0, none).otherwise(F.rint(20 * F.col("w") / F.nullif("least", F.lit(0.0)))))
    first = m.groupBy("site_id", "n").agg(F.min(F.struct("w", "u", "v")).alias("p"), F.min(F.struct("b", F.least("ud", "vd").alias("near"), "u", "v")).alias("q"))
    return first.select("site_id", "n", F.col("p.u").alias("u2"), F.col("p.v").alias("v2"), F.col("q.u").alias("u3"), F.col("q.v").alias("v3"))


from . import more, solutions, records, tables  # noqa: E402,F401  (register their queries)

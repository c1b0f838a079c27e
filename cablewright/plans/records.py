"""Registered queries about sources, sinks, texts and small geometry, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import joins, mesh, obstacles, polygons, sets, solvers, trees
from ..sources import coordinates, fixtures, routing, sites, store, synthetic
from .catalogue import _ANC, _BASE, _C1, _FOREST, _KNN, _TRI, _meet, _with, query
from .solutions import _savings

_SQUARE = "sq AS (SELECT site_id, min(x) - 500 AS x0, max(x) + 500 AS x1, min(y) - 500 AS y0, max(y) + 500 AS y1 FROM v GROUP BY site_id)"
_UNIT = "CAST(round((x - x0) / sqrt(CAST((x1 - x0) * (y1 - y0) AS DOUBLE)) * 1000000) AS BIGINT) AS x, CAST(round((y - y0) / sqrt(CAST((x1 - x0) * (y1 - y0) AS DOUBLE)) * 1000000) AS BIGINT) AS y"
query("prj4_unit_area", f"{_with(_C1, _SQUARE)} SELECT site_id, n, {_UNIT} FROM v JOIN sq USING (site_id)")(lambda spark, v, d: polygons.unit_area(v, polygons.box_border(v)))
query("prj8_unit_area_single_root", f"{_with(_C1, _SQUARE)}, o AS (SELECT site_id, n, x, y FROM v WHERE n >= 0 UNION ALL SELECT site_id, -1, CAST(floor(avg(x)) AS BIGINT), CAST(floor(avg(y)) AS BIGINT) FROM v WHERE n < 0 GROUP BY site_id) SELECT site_id, n, {_UNIT} FROM o JOIN sq USING (site_id)")(lambda spark, v, d: polygons.unit_area(polygons.single_root(v), polygons.box_border(v)))
query("mesh7_concavities", f"{_with(_C1, _SQUARE)} SELECT site_id, 0 AS concavity, s AS seq, CASE s WHEN 0 THEN x1 WHEN 1 THEN CAST(floor((x0 + x1) / 2.0) AS BIGINT) ELSE x0 END AS x, CASE s WHEN 1 THEN y1 - (y1 - y0) // 4 ELSE y1 END AS y FROM sq, (VALUES (0), (1), (2)) t(s)")(lambda spark, v, d: polygons.concavities(polygons.notched_border(v)))

_ARC = "abs(atan2((ux - rx) * (vy - ry) - (uy - ry) * (vx - rx), (ux - rx) * (vx - rx) + (uy - ry) * (vy - ry)))"
query("geo21_arcs", f"""{_with(_C1, _KNN, _TRI)}, hl AS (SELECT site_id, u, v FROM sd GROUP BY site_id, u, v HAVING count(*) = 1),
q AS (SELECT e.site_id, e.u, e.v, r.n AS root, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, r.x AS rx, r.y AS ry, hl.u IS NOT NULL AS exempt FROM e JOIN v a ON a.site_id = e.site_id AND a.n = e.u JOIN v b ON b.site_id = e.site_id AND b.n = e.v JOIN v r ON r.site_id = e.site_id AND r.n < 0 LEFT JOIN hl ON hl.site_id = e.site_id AND hl.u = e.u AND hl.v = e.v WHERE e.u >= 0),
z AS (SELECT *, CASE WHEN exempt THEN 0.0 ELSE {_ARC} END AS arc FROM q)
SELECT site_id, u, v, root, exempt, round(arc, 6) AS arc FROM (SELECT *, max(arc) OVER (PARTITION BY site_id, u, v) AS most FROM z) y WHERE most < pi() / 2""")(
    lambda spark, v, d: joins.arcs(joins.knn_edges(v).filter("u >= 0"), mesh.hull_edges(mesh.triangles(v)), v).withColumn("arc", F.round("arc", 6))
)
_BOX = "bx AS (SELECT site_id, CAST(floor(avg(x)) AS BIGINT) AS cx, CAST(floor(avg(y)) AS BIGINT) AS cy FROM v GROUP BY site_id), ob AS (SELECT site_id, cx + a * 300 AS sx, cy + b * 300 AS sy, cx + c * 300 AS tx, cy + g * 300 AS ty FROM bx, (VALUES (-1, -1, -1, 1), (-1, 1, 1, 1), (1, 1, 1, -1), (1, -1, -1, -1)) k(a, b, c, g))"
query("win7_shortcuts", f"""{_with(*_BASE, _FOREST, _ANC, _BOX, recursive=True)}, tr AS (SELECT a.site_id, a.leaf AS path, a.node AS s, a.parent AS b, f.parent AS t FROM anc a JOIN f ON f.site_id = a.site_id AND f.n = a.parent WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.site_id = a.site_id AND g.parent = a.leaf)),
q AS (SELECT tr.*, p.x AS ux, p.y AS uy, r.x AS vx, r.y AS vy FROM tr JOIN v p ON p.site_id = tr.site_id AND p.n = tr.s JOIN v r ON r.site_id = tr.site_id AND r.n = tr.t)
SELECT site_id, path, s, b, t, NOT EXISTS (SELECT 1 FROM ob WHERE ob.site_id = q.site_id AND {_meet('u', 'v', 's', 't').replace('sx', 'ob.sx').replace('sy', 'ob.sy').replace('tx', 'ob.tx').replace('ty', 'ob.ty')}) AS free FROM q""")(
    lambda spark, v, d: obstacles.shortcuts(sets.triples(trees.paths(trees.seed_forest(v))), v, polygons.box_obstacle(v))
)

# Ways around a box: past one, two or three of its corners, one after another on its ring.
_FREE = " AND ".join(f"NOT ({_meet('u', 'v', 's', 't').replace('sx', f'({x0})').replace('sy', f'({y0})').replace('tx', f'({x1})').replace('ty', f'({y1})')})" for x0, y0, x1, y1 in [("cx - 300", "cy - 300", "cx - 300", "cy + 300"), ("cx - 300", "cy + 300", "cx + 300", "cy + 300"), ("cx + 300", "cy + 300", "cx + 300", "cy - 300"), ("cx + 300", "cy - 300", "cx - 300", "cy - 300"), ("cx - 300", "cy - 300", "cx + 300", "cy + 300"), ("cx - 300", "cy + 300", "cx + 300", "cy - 300")])
_CONTOURS = f"""{_with(_C1, _KNN, _BOX)}, q AS (SELECT DISTINCT e.site_id, e.u, e.v, a.x AS ax, a.y AS ay, b.x AS zx, b.y AS zy FROM e JOIN v a ON a.site_id = e.site_id AND a.n = e.u JOIN v b ON b.site_id = e.site_id AND b.n = e.v JOIN ob ON ob.site_id = e.site_id
  WHERE {_meet('u', 'v', 's', 't').replace('ux', 'a.x').replace('uy', 'a.y').replace('vx', 'b.x').replace('vy', 'b.y')}),
co(c, i, j) AS (VALUES (0, -300, -300), (1, -300, 300), (2, 300, 300), (3, 300, -300)),
en AS (SELECT q.site_id, q.u AS p, q.v AS r, 0 AS side, ax AS ux, ay AS uy FROM q UNION ALL SELECT site_id, u, v, 1, zx, zy FROM q),
hp AS (SELECT site_id, p, r, side, c, sqrt(CAST((ux - vx) * (ux - vx) + (uy - vy) * (uy - vy) AS DOUBLE)) AS w FROM (SELECT en.*, co.c, cx, cy, cx + i AS vx, cy + j AS vy FROM en JOIN bx USING (site_id), co) z WHERE {_FREE})"""
query("mesh11_contours", f"""{_CONTOURS}
SELECT a.site_id, a.p AS u, a.r AS v, CAST(round(min(a.w + b.w + 600 * least((a.c - b.c + 4) % 4, (b.c - a.c + 4) % 4)) * 1000) AS BIGINT) AS length FROM hp a JOIN hp b ON a.site_id = b.site_id AND a.p = b.p AND a.r = b.r AND a.side = 0 AND b.side = 1 GROUP BY a.site_id, a.p, a.r""")(
    lambda spark, v, d: obstacles.contours(joins.knn_edges(v), v, polygons.box_border(v).unionByName(polygons.box_obstacle(v))).drop("midpath")
)

# Contours as clones: the nearest-neighbour edges as hops, those that the box cuts by clones of the corners that they pass.
_FIRST_CLONE = 1_000_000
_CORNER_ID = obstacles.CORNER + obstacles.POLYGON
query("gr2_contours", f"""{_CONTOURS}, wy AS (SELECT a.site_id, a.p, a.r, min(struct_pack(d := a.w + b.w + 600 * least((a.c - b.c + 4) % 4, (b.c - a.c + 4) % 4), last := b.c, first := a.c)) AS m FROM hp a JOIN hp b ON a.site_id = b.site_id AND a.p = b.p AND a.r = b.r AND a.side = 0 AND b.side = 1 GROUP BY a.site_id, a.p, a.r),
ct AS (SELECT site_id, p AS u, r AS v, list_transform(CASE (m.first - m.last + 4) % 4 WHEN 0 THEN [m.first] WHEN 2 THEN [m.first, CASE WHEN m.first % 2 = 0 THEN 1 ELSE 0 END, m.last] ELSE [m.first, m.last] END, lambda c: {_CORNER_ID} + c) AS mid FROM wy),
tp AS (SELECT e.site_id, e.u, e.v, coalesce(mid, []) AS mid FROM e LEFT JOIN ct ON ct.site_id = e.site_id AND ct.u = e.u AND ct.v = e.v),
bs AS (SELECT *, {_FIRST_CLONE} + coalesce(sum(len(mid)) OVER (PARTITION BY site_id ORDER BY u, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM tp),
no AS (SELECT site_id, u AS edge_u, v AS edge_v, list_concat([u], list_transform(range(len(mid)), lambda i: CAST(base + i AS BIGINT)), [v]) AS nodes, list_concat([u], mid, [v]) AS primes, unnest(range(1, len(mid) + 2)) AS i FROM bs)
SELECT site_id, nodes[i] AS u, nodes[i + 1] AS v, primes[i] AS prime_u, primes[i + 1] AS prime_v, edge_u, edge_v FROM no""")(lambda spark, v, d: _clones(v))


def _clones(v: DataFrame) -> DataFrame:
    around = polygons.box_border(v).unionByName(polygons.box_obstacle(v))
    edges = joins.knn_edges(v).select("site_id", "u", "v")
    return sets.expand(edges, obstacles.contours(edges, v, around).select("site_id", "u", "v", "midpath"), _FIRST_CLONE)


_ANGLE = "atan2((ux - sx) * ({0}y - sy) - (uy - sy) * ({0}x - sx), (ux - sx) * ({0}x - sx) + (uy - sy) * ({0}y - sy))"
query("geo10_bunch_split", f"""{_with(_C1, _KNN)}, q AS (SELECT e.site_id, e.u, e.v, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, r.x AS sx, r.y AS sy, p.x AS px, p.y AS py FROM e JOIN v a ON a.site_id = e.site_id AND a.n = e.u JOIN v b ON b.site_id = e.site_id AND b.n = e.v
  JOIN v r ON r.site_id = e.site_id AND r.n = -1 JOIN v p ON p.site_id = e.site_id AND p.n >= 0 AND p.n <> e.u AND p.n <> e.v WHERE e.u >= 0),
g AS (SELECT site_id, u, v, {_ANGLE.format('v')} AS w, {_ANGLE.format('p')} AS a FROM q)
SELECT site_id, u, v, bool_or(CASE WHEN w >= 0 THEN a > 1e-3 AND a < w - 1e-3 ELSE a < -1e-3 AND a > w + 1e-3 END) AND bool_or(CASE WHEN w >= 0 THEN a < -1e-3 OR a > w + 1e-3 ELSE a > 1e-3 OR a < w - 1e-3 END) AS split FROM g GROUP BY site_id, u, v""")(lambda spark, v, d: _corner_split(v))


def _corner_split(v: DataFrame) -> DataFrame:
    """For each edge between terminals: whether the angle that root -1 sees it under splits the other terminals."""
    e = joins.knn_edges(v).filter("u >= 0").select("site_id", "u", "v", F.lit(-1).cast("long").alias("s"))
    q = joins.with_points(joins.with_points(e.withColumn("t", F.col("s")), v), v, "s", "t")
    p = v.filter("n >= 0").select("site_id", F.col("n").alias("m"), F.col("x").alias("px"), F.col("y").alias("py"))
    j = q.join(p, "site_id").filter("m <> u AND m <> v")
    return j.groupBy("site_id", "u", "v").agg(G.bunch_split(G.point("p"), G.point("u"), G.point("s"), G.point("v")).alias("split"))


# Tags: base 50 for terminals, Greek letters for roots, and back.
_DIGIT = f"substr('{X.DIGITS}', CAST({{0}} AS BIGINT) + 1, 1)"
query("prj9_node_tags", f"""{_with(_C1)}, b AS (SELECT site_id, n, n * 1000003 AS big FROM v), t AS (SELECT *, CASE WHEN n < 0 THEN substr('{X.ROOTS}', CAST((-n - 1) % 25 AS BIGINT) + 1, 1) WHEN n < 50 THEN {_DIGIT.format('n')} ELSE {_DIGIT.format('n // 50')} || {_DIGIT.format('n % 50')} END AS tag,
  CASE WHEN n > 0 THEN (SELECT string_agg({_DIGIT.format('big // k % 50')}, '' ORDER BY k DESC) FROM (VALUES (1), (50), (2500), (125000), (6250000), (312500000)) p(k) WHERE k <= big) END AS long_tag FROM b)
SELECT site_id, n, tag, long_tag, n AS back FROM t""")(
    lambda spark, v, d: v.select("site_id", "n", X.node_tag(F.col("n")).alias("tag"), F.when(F.col("n") > 0, X.node_tag(F.col("n") * 1000003)).alias("long_tag")).withColumn("back", X.node_of(F.col("tag")))
)
query("prj10_node_lists", f"{_with(*_BASE, _FOREST, _ANC, recursive=True)} SELECT site_id, leaf AS path, string_agg(CASE WHEN node < 0 THEN substr('{X.ROOTS}', CAST(-node AS BIGINT), 1) WHEN node < 50 THEN {_DIGIT.format('node')} ELSE {_DIGIT.format('node // 50')} || {_DIGIT.format('node % 50')} END, ', ' ORDER BY hops) AS nodes FROM (SELECT site_id, leaf, node, hops FROM anc UNION ALL SELECT site_id, leaf, parent, hops + 1 FROM anc WHERE parent < 0) q WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.site_id = q.site_id AND f.parent = q.leaf) GROUP BY site_id, leaf")(
    lambda spark, v, d: trees.paths(trees.seed_forest(v)).groupBy("site_id", "path").agg(F.array_sort(F.collect_list(F.struct("seq", "n"))).alias("s")).select("site_id", "path", X.node_list(F.col("s.n")).alias("nodes"))
)

# Projection: Krueger's series, with the same constants.
_N = coordinates.FLATTENING / (2 - coordinates.FLATTENING)
_R = coordinates.RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * coordinates.SCALE
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_TERM = " + ".join(f"{a!r} * {{0}}({2 * j} * xi) * {{1}}({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))


# Made-up sites.
query("src19_instance", f"{_with(_C1)} SELECT site_id, CASE WHEN n < 0 THEN -row_number() OVER (PARTITION BY site_id, n < 0 ORDER BY x, y) ELSE row_number() OVER (PARTITION BY site_id, n < 0 ORDER BY x, y) - 1 END AS n, x, y FROM v")(lambda spark, v, d: fixtures.instance(v.select("site_id", "x", "y", (F.col("n") < 0).alias("is_root"))))

# Site files, written and read back, and on to the solver: whole files and coordinates that aren't whole.
query("src1_site_files", f"{_with(_C1, _SQUARE)} SELECT 'site_' || site_id AS handle, CASE WHEN n < 0 THEN 'root' ELSE 'terminal' END AS section, CASE WHEN n < 0 THEN n + 2 ELSE n END AS seq, x / 10 AS x, y / 10 AS y FROM v UNION ALL SELECT 'site_' || site_id, 'border', s, CASE WHEN s IN (0, 3) THEN x0 ELSE x1 END / 10, CASE WHEN s < 2 THEN y0 ELSE y1 END / 10 FROM sq, (VALUES (0), (1), (2), (3)) t(s)")(lambda spark, v, d: _files(spark, v).select("handle", "section", "seq", "x", "y"))
query("src9_repository_solved", f"{_with(*_savings('presolver', (5,)), recursive=True)} SELECT 'site_' || site_id AS handle, n, parent FROM wk")(lambda spark, v, d: _solved(spark, v))


def _files(spark: SparkSession, v: DataFrame) -> DataFrame:
    tenth = [(F.col(c) / 10).alias(c) for c in "xy"]
    rows = v.select(F.concat(F.lit("site_"), F.col("site_id")).alias("handle"), F.when(F.col("n") < 0, "root").otherwise("terminal").alias("section"), F.lit(-1).alias("poly_id"), F.col("n").alias("seq"), *tenth)
    border = polygons.box_border(v).select(F.concat(F.lit("site_"), F.col("site_id")).alias("handle"), F.lit("border").alias("section"), "poly_id", F.col("seq").cast("long").alias("seq"), *tenth)
    path = store.folder(spark)
    sites.write_sites(rows.unionByName(border), path).count()
    return sites.read_sites(spark, path)


def _solved(spark: SparkSession, v: DataFrame) -> DataFrame:
    read = sites.numbered(_files(spark, v)).filter("section IN ('terminal', 'root')")
    at = read.select(F.regexp_extract("handle", r"(\d+)$", 1).cast("long").alias("site_id"), "n", "x", "y")
    return solvers.solve(at, ["presolver"], [5]).select(F.concat(F.lit("site_"), F.col("site_id")).alias("handle"), "n", "parent")


# The store and its records.
query("agg15_duplicates", f"{_with(_C1)}, s AS (SELECT site_id, sha256(string_agg(n || ':' || x || ':' || y, ';' ORDER BY n)) AS digest FROM v GROUP BY site_id) SELECT digest, site_id AS first, CAST(2 AS BIGINT) AS sites FROM s")(
    lambda spark, v, d: store.node_sets(v.unionByName(v.withColumn("site_id", F.col("site_id") + 100))).groupBy("digest").agg(F.min("site_id").alias("first"), F.count("*").alias("sites"))
)
query("snk11_drawing", f"""{_with(*_BASE, _FOREST)}, li AS (SELECT f.site_id, string_agg('<line x1="' || a.x || '" y1="' || -a.y || '" x2="' || b.x || '" y2="' || -b.y || '"' || CASE WHEN parent < 0 THEN ' stroke-dasharray="40"' ELSE '' END || '/>', '' ORDER BY f.n) AS lines FROM f JOIN v a ON a.site_id = f.site_id AND a.n = f.n JOIN v b ON b.site_id = f.site_id AND b.n = f.parent GROUP BY f.site_id),
dt AS (SELECT site_id, string_agg('<circle cx="' || x || '" cy="' || -y || '" r="' || CASE WHEN n < 0 THEN 60 ELSE 30 END || '"/>', '' ORDER BY n) AS dots, min(x) || ' ' || -max(y) || ' ' || max(x) - min(x) || ' ' || max(y) - min(y) AS box FROM v GROUP BY site_id)
SELECT site_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="' || box || '"><g stroke="black" stroke-width="15">' || lines || '</g>' || dots || '</svg>' AS svg FROM li JOIN dt USING (site_id)""")(lambda spark, v, d: store.drawing(trees.seed_forest(v), v))


# Solver texts: a summary's extrema, a problem's text, a tour's routes, options by solver.
query("sf10_named", f"{_with(_C1)} SELECT site_id, n, x + y AS total, x - y AS apart FROM v")(lambda spark, v, d: v.select("site_id", "n", X.named(total=F.col("x") + F.col("y"), apart=F.col("x") - F.col("y")).alias("s")).select("site_id", "n", "s.*"))
query("vr3_problem", f"""{_with(_C1, _KNN)}, w AS (SELECT a.site_id, a.n AS i, b.n AS j, CASE WHEN a.n = b.n OR b.n = -1 THEN 0 WHEN a.n = -1 OR EXISTS (SELECT 1 FROM e WHERE e.site_id = a.site_id AND e.u = least(a.n, b.n) AND e.v = greatest(a.n, b.n)) THEN CAST(round(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) * 1000) AS BIGINT) ELSE {routing.FAR} END AS l FROM v a JOIN v b ON a.site_id = b.site_id AND a.n >= -1 AND b.n >= -1),
r AS (SELECT site_id, i, string_agg(l, ' ' ORDER BY j) AS line FROM w GROUP BY site_id, i)
SELECT site_id, sha256('TYPE : ACVRP' || chr(10) || 'DIMENSION : ' || count(*) || chr(10) || 'CAPACITY : 5' || chr(10) || 'EDGE_WEIGHT_TYPE : EXPLICIT' || chr(10) || 'EDGE_WEIGHT_FORMAT : FULL_MATRIX' || chr(10) || 'EDGE_WEIGHT_SECTION' || chr(10) || string_agg(line, chr(10) ORDER BY i) || chr(10) || 'EOF') AS digest FROM r GROUP BY site_id""")(lambda spark, v, d: routing.problem_digests(v, joins.knn_edges(v), 5))

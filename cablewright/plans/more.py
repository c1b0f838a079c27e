"""More registered queries: predicates, sets, texts, windows and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import joins, mesh, obstacles, polygons, sets, solvers, trees
from ..operators import kernels as K
from ..sources import coordinates, store, synthetic
from .catalogue import _BASE, _C1, _FOREST, _KNN, _LOADS, _PAIRS, _PTS, _TRI, _TWO, _meet, _turn, _with, query

_FE = "fe AS (SELECT DISTINCT site_id, least(n, parent) AS u, greatest(n, parent) AS v FROM f)"
_DE = "de AS (SELECT DISTINCT site_id, u, v FROM sd)"
_QUAD = "qd AS (SELECT e.site_id, e.u, e.v, -1 AS s, -2 AS t FROM e WHERE e.u >= 0)"


def _forest_edges(v: DataFrame) -> DataFrame:
    return trees.seed_forest(v).select("site_id", F.col("parent").alias("u"), F.col("n").alias("v"))


def _sides(v: DataFrame) -> DataFrame:
    return mesh.sides(mesh.triangles(v)).select("site_id", "u", "v").distinct()


def _quads(v: DataFrame) -> DataFrame:
    """Edges between terminals, with both roots as s and t."""
    e = joins.knn_edges(v).filter("u >= 0").select("site_id", "u", "v", F.lit(-1).cast("long").alias("s"), F.lit(-2).cast("long").alias("t"))
    return joins.with_points(joins.with_points(e, v), v, "s", "t")


def _p():
    return [G.point(c) for c in "uvst"]


_SAME = f"sign({_turn('u', 'v', 's')}) * sign({_turn('u', 'v', 't')})"
query("geo5_convex_pair", f"{_with(_C1, _KNN, _QUAD, _PTS.format('qd'))} SELECT site_id, u, v, {_meet('u', 'v', 's', 't')} AS convex FROM p4")(lambda spark, v, d: _quads(v).select("site_id", "u", "v", G.convex_pair(*_p()).alias("convex")))
query("geo6_same_side", f"{_with(_C1, _KNN, _QUAD, _PTS.format('qd'))} SELECT site_id, u, v, {_SAME} >= 0 AS touching, {_SAME} > 0 AS strict FROM p4")(lambda spark, v, d: _quads(v).select("site_id", "u", "v", G.same_side(*_p()).alias("touching"), G.same_side(*_p(), touch=False).alias("strict")))
query("geo7_blocking", f"{_with(_C1, _KNN, _QUAD, _PTS.format('qd'))} SELECT site_id, u, v, {_meet('s', 'u', 'v', 't')} AND NOT sign({_turn('s', 'u', 't')}) * sign({_turn('s', 'u', 'v')}) >= 0 AS blocked FROM p4")(lambda spark, v, d: _quads(v).select("site_id", "u", "v", G.blocks(_p()[3], _p()[2], _p()[0], _p()[1], _p()[3]).alias("blocked")))
query("geo14_bbox_overlap", f"{_with(_C1, _KNN, _QUAD, _PTS.format('qd'))} SELECT site_id, u, v, greatest(ux, vx) >= least(sx, tx) AND greatest(sx, tx) >= least(ux, vx) AND greatest(uy, vy) >= least(sy, ty) AND greatest(sy, ty) >= least(uy, vy) AS overlap FROM p4")(lambda spark, v, d: _quads(v).select("site_id", "u", "v", G.bbox_overlap(*_p()).alias("overlap")))
query("geo1_crossing_roots", f"{_with(_C1, _KNN, _QUAD, _PTS.format('qd'))} SELECT site_id, u, v, {_meet('u', 'v', 's', 't', '<=')} AND (vx - ux) * (ty - sy) <> (vy - uy) * (tx - sx) AS touching, {_meet('u', 'v', 's', 't')} AS strict FROM p4")(lambda spark, v, d: _quads(v).select("site_id", "u", "v", G.is_crossing(*_p()).alias("touching"), G.is_crossing(*_p(), touch=False, bbox=False).alias("strict")))
query("geo8_line_distance", f"{_with(_C1, _KNN, _QUAD, _PTS.format('qd'))} SELECT site_id, u, v, round(abs({_turn('u', 'v', 's')}) / sqrt((ux - vx) * (ux - vx) + (uy - vy) * (uy - vy)), 3) AS distance FROM p4")(lambda spark, v, d: _quads(v).select("site_id", "u", "v", F.round(G.distance_to_line(_p()[2], _p()[0], _p()[1]), 3).alias("distance")))
query("geo13_rotate", f"{_with(_C1)} SELECT site_id, n, round(x * cos(radians(30)) - y * sin(radians(30)), 3) AS x, round(x * sin(radians(30)) + y * cos(radians(30)), 3) AS y FROM v")(lambda spark, v, d: v.select("site_id", "n", *[F.round(c, 3).alias(k) for c, k in zip(G.rotate((F.col("x"), F.col("y")), F.lit(30)), "xy", strict=True)]))
query("geo20_blockage", f"{_with(_C1, _KNN, _QUAD, _PTS.format('qd'))}, a AS (SELECT site_id, u, v, abs(atan2((ux - sx) * (vy - sy) - (uy - sy) * (vx - sx), (ux - sx) * (vx - sx) + (uy - sy) * (vy - sy))) AS arc FROM p4) SELECT site_id, u, v, round(pi() / (pi() - arc), 4) AS plain, round(pi() / (pi() - arc) + 4 * arc / pi(), 4) AS extra FROM a WHERE arc < pi() / 2")(lambda spark, v, d: _blockage(v))
query("set1_edge_difference", f"{_with(*_BASE, _FOREST, _TRI, _FE, _DE)} SELECT site_id, u, v FROM fe EXCEPT SELECT site_id, u, v FROM de")(lambda spark, v, d: sets.difference(_forest_edges(v), _sides(v)))
query("jn16_edges_present", f"{_with(*_BASE, _FOREST, _TRI, _FE, _DE)} SELECT site_id, u, v FROM fe INTERSECT SELECT site_id, u, v FROM de")(lambda spark, v, d: sets.present(_forest_edges(v), _sides(v)))
query("set2_common_neighbours", f"{_with(_C1, _KNN)}, b AS (SELECT site_id, u AS a, v AS b FROM e UNION ALL SELECT site_id, v, u FROM e) SELECT e.site_id, e.u, e.v, x.b AS w FROM e JOIN b x ON x.site_id = e.site_id AND x.a = e.u JOIN b y ON y.site_id = e.site_id AND y.a = e.v AND y.b = x.b")(lambda spark, v, d: sets.common_neighbours(joins.knn_edges(v)))
query("set5_edge_union", f"{_with(*_BASE, _FOREST, _TRI, _FE, _DE)} SELECT site_id, u, v, count(*) AS sources FROM (SELECT * FROM fe UNION ALL SELECT * FROM de) q GROUP BY site_id, u, v")(lambda spark, v, d: sets.union(_forest_edges(v), _sides(v)))
query("prj11_overlay", f"{_with(*_BASE, _FOREST, _TRI, _FE, _DE)} SELECT coalesce(a.site_id, b.site_id) AS site_id, coalesce(a.u, b.u) AS u, coalesce(a.v, b.v) AS v, CASE WHEN a.u IS NOT NULL THEN 'route' ELSE 'planar' END AS kind FROM fe a FULL OUTER JOIN de b ON a.site_id = b.site_id AND a.u = b.u AND a.v = b.v")(lambda spark, v, d: sets.overlay(sets.oriented(_forest_edges(v)).withColumn("kind", F.lit("route")), _sides(v).withColumn("kind", F.lit("planar"))))
query("gr2_expand", f"{_with(*_BASE, _FOREST, _FE)} SELECT site_id, count(*) + count(*) FILTER (WHERE u % 2 = 0) AS hops, count(*) FILTER (WHERE u % 2 = 0) AS clones, count(*) AS edges FROM fe GROUP BY site_id")(lambda spark, v, d: _expanded(v))
query("gr3_contract", f"{_with(*_BASE, _FOREST, _FE)} SELECT site_id, u, v FROM fe")(lambda spark, v, d: sets.contract(sets.expand(_forest_edges(v), _midpaths(v), _FIRST_CLONE)))
query("ml1_model_rows", f"{_with(_C1, _TRI, _TWO)}, av AS (SELECT DISTINCT site_id, u, v FROM sd UNION SELECT site_id, s, t FROM dg), t AS (SELECT site_id, count(*) FILTER (WHERE n >= 0) AS t, count(*) FILTER (WHERE n < 0) AS r FROM v GROUP BY site_id) SELECT site_id, 'links' AS family, (SELECT count(*) FROM av WHERE av.site_id = t.site_id AND av.u >= 0) + t * r AS size, t AS bound FROM t UNION ALL SELECT site_id, 'gates', t * r, CAST(ceil(t / 5.0) AS BIGINT) FROM t")(lambda spark, v, d: _model(v).filter("family IN ('links', 'gates')"))
query("ml2_model_incidence", f"{_with(_C1, _TRI, _TWO)}, av AS (SELECT DISTINCT site_id, u, v FROM sd UNION SELECT site_id, s, t FROM dg), ends AS (SELECT site_id, u AS n FROM av WHERE u >= 0 UNION ALL SELECT site_id, v FROM av WHERE u >= 0), own AS (SELECT site_id, n, count(*) + 2 AS size FROM ends GROUP BY site_id, n) SELECT site_id, family, count(*) AS \"rows\", CAST(sum(size) AS BIGINT) AS size FROM own, (VALUES ('outgoing'), ('flow')) g(family) GROUP BY site_id, family")(lambda spark, v, d: _model(v).filter("family IN ('outgoing', 'flow')").groupBy("site_id", "family").agg(F.count("*").alias("rows"), F.sum("size").alias("size")))
query("src10_border", f"{_with(_C1)}, b AS (SELECT site_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY site_id) SELECT site_id, s AS seq, CASE WHEN s IN (0, 3) THEN x0 ELSE x1 END AS x, CASE WHEN s < 2 THEN y0 ELSE y1 END AS y FROM b, (VALUES (0), (1), (2), (3)) t(s)")(lambda spark, v, d: polygons.box_border(v, 0).drop("poly_id"))
query("snk10_coordinates", f"{_with(_C1)} SELECT site_id, string_agg(x || ' ' || y, ';' ORDER BY n < 0 DESC, CASE WHEN n < 0 THEN -n ELSE n END) AS points FROM v GROUP BY site_id")(lambda spark, v, d: v.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("n") >= 0).alias("a"), F.abs("n").alias("b"), "x", "y"))), lambda p: F.concat_ws(" ", p["x"], p["y"])), ";").alias("points")))
query("snk13_problem_file", f"{_with(_C1)} SELECT site_id, 'DIMENSION: ' || count(*) || chr(10) || 'CAPACITY: 5' || chr(10) || string_agg(n + 2 || ' ' || x || ' ' || y, chr(10) ORDER BY n) || chr(10) || 'EOF' AS problem FROM v WHERE n >= -1 GROUP BY site_id")(lambda spark, v, d: v.filter("n >= -1").groupBy("site_id").agg(F.count("*").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x", "y"))), lambda p: F.concat_ws(" ", p["n"] + 2, p["x"], p["y"])), "\n").alias("lines")).select("site_id", F.format_string("DIMENSION: %d\nCAPACITY: 5\n%s\nEOF", "k", "lines").alias("problem")))
query("sf6_scalars", f"{_with(*_BASE)} SELECT site_id, n, root, round(sqrt(CAST(d2 AS DOUBLE)), 3) AS dist, CAST(ceil(d2 / 1000.0) AS BIGINT) AS up, CAST(floor(d2 / 1000.0) AS BIGINT) AS down, round(log10(d2), 6) AS mag FROM d")(lambda spark, v, d: joins.d2roots(v).select("site_id", "n", "root", F.round(F.hypot(F.sqrt(F.col("d2").cast("double")), F.lit(0.0)), 3).alias("dist"), F.ceil(F.col("d2") / 1000).alias("up"), F.floor(F.col("d2") / 1000).alias("down"), F.round(F.log10("d2"), 6).alias("mag")))
query("prj6_site_only", f"{_with(*_BASE, _FOREST)} SELECT DISTINCT site_id, n FROM (SELECT site_id, n FROM f UNION ALL SELECT site_id, parent FROM f) q")(lambda spark, v, d: trees.degrees(trees.seed_forest(v)).select("site_id", "n"))
query("prj1_lengths", f"{_LOADS} SELECT site_id, n, parent, CASE WHEN n % 2 = 0 THEN -n ELSE length END AS length FROM len")(lambda spark, v, d: trees.lengths(trees.seed_forest(v).select("site_id", "n", "parent", F.when(F.col("n") % 2 == 0, -F.col("n")).alias("length")), v))
query("agg10_power", f"{_with(_C1)} SELECT site_id, CAST(sum(CASE WHEN n % 7 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS power FROM v WHERE n >= 0 GROUP BY site_id")(lambda spark, v, d: v.filter("n >= 0").withColumn("power", F.when(F.col("n") % 7 == 0, F.lit(3))).groupBy("site_id").agg(F.sum(F.coalesce("power", F.lit(1))).alias("power")))
query("agg13_least_rectangle", f"{_with(_C1, _TRI)}, h AS (SELECT q.site_id, b.x - a.x AS dx, b.y - a.y AS dy FROM (SELECT site_id, u, v FROM sd GROUP BY site_id, u, v HAVING count(*) = 1) q JOIN v a ON a.site_id = q.site_id AND a.n = q.u JOIN v b ON b.site_id = q.site_id AND b.n = q.v) SELECT site_id, min(area) AS area FROM (SELECT h.site_id, h.dx, h.dy, round((max(h.dx * v.x + h.dy * v.y) - min(h.dx * v.x + h.dy * v.y)) * 1.0 * (max(h.dx * v.y - h.dy * v.x) - min(h.dx * v.y - h.dy * v.x)) / (h.dx * h.dx + h.dy * h.dy)) AS area FROM h JOIN v USING (site_id) GROUP BY h.site_id, h.dx, h.dy) q GROUP BY site_id")(lambda spark, v, d: _rectangles(v))
query("win3_ring", f"{_with(_C1)}, b AS (SELECT site_id, min(x) - 500 AS x0, max(x) + 500 AS x1, min(y) - 500 AS y0, max(y) + 500 AS y1 FROM v GROUP BY site_id) SELECT site_id, 0 AS poly_id, s AS seq, CASE WHEN s IN (0, 3) THEN x0 ELSE x1 END AS x, CASE WHEN s < 2 THEN y0 ELSE y1 END AS y, CASE WHEN s IN (2, 3) THEN x0 ELSE x1 END AS tx, CASE WHEN s IN (0, 3) THEN y0 ELSE y1 END AS ty FROM b, (VALUES (0), (1), (2), (3)) t(s)")(lambda spark, v, d: polygons.sides(polygons.box_border(v)))
query("win4_slices", f"{_with(*_BASE, _FOREST)}, g AS (SELECT site_id, root, count(*) AS k FROM f GROUP BY site_id, root) SELECT site_id, root, CAST(sum(k) OVER (PARTITION BY site_id ORDER BY root) AS BIGINT) AS upto FROM g")(lambda spark, v, d: trees.seed_forest(v).groupBy("site_id", "root").agg(F.count("*").alias("k")).select("site_id", "root", F.sum("k").over(Window.partitionBy("site_id").orderBy("root")).alias("upto")))
query("top4_near_best", f"{_with(*_BASE, _KNN)}, m AS (SELECT e.site_id, q.n, e.u, e.v, e.l2, q.d2, min(e.l2) OVER (PARTITION BY e.site_id, q.n) AS least FROM e JOIN near q ON q.site_id = e.site_id AND (q.n = e.u OR q.n = e.v)) SELECT site_id, n, u, v FROM (SELECT *, row_number() OVER (PARTITION BY site_id, n ORDER BY greatest(u, v), l2) AS k FROM m WHERE l2 * 10000 <= least * 10404) q WHERE k = 1")(lambda spark, v, d: _near_best(v))
query("top8_longest_hop", f"{_LOADS} SELECT site_id, subtree, n AS hop FROM (SELECT *, row_number() OVER (PARTITION BY site_id, subtree ORDER BY length DESC, n) AS k FROM len) q WHERE k = 1")(lambda spark, v, d: _longest(v))
query("mesh13_scale", f"{_with(_C1, _TRI)} SELECT site_id, CAST(sum(abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))) AS BIGINT) AS area2, min(min(a.x, b.x, c.x)) AS x0 FROM tri JOIN v a USING (site_id) JOIN v b USING (site_id) JOIN v c USING (site_id) WHERE a.n = tri.a AND b.n = tri.b AND c.n = tri.c GROUP BY site_id".replace("min(a.x, b.x, c.x)", "least(a.x, b.x, c.x)"))(lambda spark, v, d: _scale(v))


def _blockage(v: DataFrame) -> DataFrame:
    import math

    e = _quads(v).withColumn("arc", F.abs(G.angle(_p()[0], _p()[2], _p()[1]))).filter(F.col("arc") < math.pi / 2)
    return e.select("site_id", "u", "v", F.round(G.blockage(F.col("arc")), 4).alias("plain"), F.round(G.blockage(F.col("arc"), True), 4).alias("extra"))


#: Clones are numbered from here on, beyond all terminals.
_FIRST_CLONE = obstacles.CORNER


def _midpaths(v: DataFrame) -> DataFrame:
    """A made-up midpath, of node 0, for edges whose lower end is even."""
    return sets.oriented(_forest_edges(v)).filter("u % 2 = 0").withColumn("midpath", F.array(F.lit(0).cast("long")))


def _expanded(v: DataFrame) -> DataFrame:
    h = sets.expand(_forest_edges(v), _midpaths(v), _FIRST_CLONE)
    return h.groupBy("site_id").agg(F.count("*").alias("hops"), F.count_if(F.col("u") >= _FIRST_CLONE).alias("clones"), F.count_distinct("edge_u", "edge_v").alias("edges"))


def _model(v: DataFrame) -> DataFrame:
    t = mesh.triangles(v)
    return sets.model_rows(mesh.available_edges(t, v), mesh.exclusive_pairs(t, v), v, 5)


def _rectangles(v: DataFrame) -> DataFrame:
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["site_id"].iloc[0], float(round(K.smallest_rectangle(pdf[["x", "y"]].to_numpy()))))], columns=["site_id", "area"])

    return v.groupBy("site_id").applyInPandas(run, "site_id long, area double")


def _near_best(v: DataFrame) -> DataFrame:
    """Of each terminal's edges within 2 % of the shortest, the one of the least rank."""
    m = joins.assign_root(v).select("site_id", "n").join(joins.knn_edges(v), "site_id").filter("n = u OR n = v")
    m = m.withColumn("least", F.min("l2").over(Window.partitionBy("site_id", "n"))).filter("l2 * 10000 <= least * 10404")
    best = F.min(F.struct(F.greatest("u", "v").alias("rank"), "l2", "u", "v")).alias("b")
    return m.groupBy("site_id", "n").agg(best).select("site_id", "n", F.col("b.u").alias("u"), F.col("b.v").alias("v"))


def _longest(v: DataFrame) -> DataFrame:
    l = trees.lengths(trees.tree_loads(trees.seed_forest(v)), v)
    return l.groupBy("site_id", "subtree").agg(F.min(F.struct((-F.col("length")).alias("k"), "n")).alias("b")).select("site_id", "subtree", F.col("b.n").alias("hop"))


def _scale(v: DataFrame) -> DataFrame:
    t = mesh.triangles(v)
    p = t
    for c in "abc":
        p = p.join(v.select("site_id", F.col("n").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), ["site_id", c])
    return p.groupBy("site_id").agg(F.sum(F.abs(G.orientation(*(G.point(c) for c in "abc")))).alias("area2"), F.min(F.least("ax", "bx", "cx")).alias("x0"))


# Borders and obstacles: the site's box as the border, a box about the mean point as an obstacle.
def _around(v: DataFrame) -> DataFrame:
    return polygons.box_border(v).unionByName(polygons.box_obstacle(v))


_BOX = "bx AS (SELECT site_id, CAST(floor(avg(x)) AS BIGINT) AS cx, CAST(floor(avg(y)) AS BIGINT) AS cy FROM v GROUP BY site_id), ob AS (SELECT site_id, cx + a * 300 AS sx, cy + b * 300 AS sy, cx + c * 300 AS tx, cy + g * 300 AS ty FROM bx, (VALUES (-1, -1, -1, 1), (-1, 1, 1, 1), (1, 1, 1, -1), (1, -1, -1, -1)) k(a, b, c, g))"
query("mesh9_cut_edges", f"{_with(_C1, _KNN, _BOX)}, q AS (SELECT e.site_id, e.u, e.v, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, sx, sy, tx, ty FROM e JOIN v a ON a.site_id = e.site_id AND a.n = e.u JOIN v b ON b.site_id = e.site_id AND b.n = e.v JOIN ob ON ob.site_id = e.site_id) SELECT site_id, u, v, count(*) AS sides FROM q WHERE {_meet('u', 'v', 's', 't')} GROUP BY site_id, u, v")(lambda spark, v, d: obstacles.cut_edges(joins.knn_edges(v), v, polygons.box_obstacle(v)))
# A polygon with h holes, b corners on all rings and i points inside is cut into 2 * i + b + 2 * h - 2 triangles.
_NOTCH = "nb AS (SELECT site_id, min(x) - 500 AS x0, max(x) + 500 AS x1, min(y) - 500 AS y0, max(y) + 500 AS y1 FROM v GROUP BY site_id), nm AS (SELECT *, CAST(floor((x0 + x1) / 2.0) AS BIGINT) AS xm, y1 - CAST(floor((y1 - y0) / 4.0) AS BIGINT) AS ym FROM nb)"
_INNER = "ip AS (SELECT v.site_id, count(*) AS i FROM v JOIN bx USING (site_id) JOIN nm USING (site_id) WHERE NOT (x BETWEEN cx - 300 AND cx + 300 AND y BETWEEN cy - 300 AND cy + 300) {} GROUP BY v.site_id)"
query("mesh10_navigation_mesh", f"{_with(_C1, _BOX, _NOTCH, _INNER.format(''))} SELECT site_id, 2 * i + 4 + 4 + 2 - 2 AS triangles, CAST(2 * (x1 - x0) * (y1 - y0) - 2 * 600 * 600 AS BIGINT) AS area2, CAST(0 AS BIGINT) AS lacking, CAST(0 AS BIGINT) AS in_holes FROM nm JOIN ip USING (site_id)")(lambda spark, v, d: obstacles.navigation_mesh(v, _around(v)))
_IN_NOTCH = "AND NOT ((xm - x1) * (y - y1) - (ym - y1) * (x - x1) < 0 AND (x0 - xm) * (y - ym) - (y1 - ym) * (x - xm) < 0)"
query("mesh10_concave_border", f"{_with(_C1, _BOX, _NOTCH, _INNER.format(_IN_NOTCH))} SELECT site_id, 2 * i + 5 + 4 + 2 - 2 AS triangles, CAST(2 * (x1 - x0) * (y1 - y0) - (x1 - x0) * (y1 - ym) - 2 * 600 * 600 AS BIGINT) AS area2, CAST(0 AS BIGINT) AS lacking, CAST(0 AS BIGINT) AS in_holes FROM nm JOIN ip USING (site_id)")(lambda spark, v, d: obstacles.navigation_mesh(v, polygons.notched_border(v).unionByName(polygons.box_obstacle(v))))
query("ew5_around_obstacles", f"{_with(_C1)} SELECT site_id, count(*) FILTER (WHERE n >= 0) AS links, CAST(0 AS BIGINT) AS cut_links, CAST(0 AS BIGINT) AS cut_ways FROM v GROUP BY site_id")(lambda spark, v, d: obstacles.solve_around(v, _around(v), 5).drop("ways", "failed"))


query("vr2_iterated", f"{_with(_C1)} SELECT site_id, CAST(0 AS BIGINT) AS missing, count(*) AS links, CAST(0 AS BIGINT) AS overloads, CAST(0 AS BIGINT) AS branchings FROM v WHERE n >= 0 GROUP BY site_id")(lambda spark, v, d: solvers.check(solvers.solve(v, ["routes_iterated"], [5]), v).select("site_id", "missing", "links", "overloads", "branchings"))
query("ml5_pool_choice", f"{_with(_C1)} SELECT DISTINCT site_id, CAST(3 AS BIGINT) AS pool FROM v")(lambda spark, v, d: solvers.pool_choice(solvers.solve(v, ["presolver", "crossing_preventing", "non_branching"], [5]), v).select("site_id", "pool"))


_AV = "av AS (SELECT DISTINCT site_id, u, v FROM sd UNION SELECT site_id, s, t FROM dg)"
_EX = f"{_PAIRS.format('av')}, {_PTS.replace('p4 AS', 'p5 AS').format('pr')}, ex AS (SELECT site_id, u, v, s, t FROM p5 WHERE {_meet('u', 'v', 's', 't')})"
query("jn10_topology_crossings", f"{_with(_C1, _KNN, _TRI, _TWO, _AV, _EX)} SELECT site_id, u, v, s, t FROM ex WHERE EXISTS (SELECT 1 FROM e WHERE e.site_id = ex.site_id AND e.u = ex.u AND e.v = ex.v) AND EXISTS (SELECT 1 FROM e WHERE e.site_id = ex.site_id AND e.u = ex.s AND e.v = ex.t)")(lambda spark, v, d: sets.topology_crossings(joins.knn_edges(v), _exclusive(v)))
query("jn8_edge_crossings", f"{_with(*_BASE, _FOREST, _TRI, _TWO, _AV, _EX, _FE)}, b AS (SELECT * FROM ex UNION ALL SELECT site_id, s, t, u, v FROM ex) SELECT site_id, u, v, s, t FROM b WHERE EXISTS (SELECT 1 FROM fe WHERE fe.site_id = b.site_id AND fe.u = b.u AND fe.v = b.v)")(lambda spark, v, d: sets.edge_crossings(_forest_edges(v), _exclusive(v)))
query("src12_matrix_import", f"{_LOADS} SELECT site_id, n, parent, load FROM l")(lambda spark, v, d: _matrix(v))
query("jn15_edge_lookup", f"{_with(*_BASE, _FOREST, _TRI, _TWO)}, av AS (SELECT DISTINCT site_id, u, v, 'delaunay' AS kind FROM sd UNION ALL SELECT site_id, s, t, 'extended' FROM dg) SELECT f.site_id, f.n, f.parent, av.kind FROM f LEFT JOIN av ON av.site_id = f.site_id AND av.u = least(f.n, f.parent) AND av.v = greatest(f.n, f.parent)")(lambda spark, v, d: _looked_up(v))


def _exclusive(v: DataFrame) -> DataFrame:
    return mesh.exclusive_pairs(mesh.triangles(v), v)


def _matrix(v: DataFrame) -> DataFrame:
    loads = trees.tree_loads(trees.seed_forest(v))
    t = v.filter("n >= 0").groupBy("site_id").agg(F.count("*").alias("T"))
    number = lambda c: F.when(F.col(c) >= 0, F.col(c) + 1).otherwise(F.col("T") + 3 + F.col(c))
    rows = loads.join(t, "site_id").select("site_id", number("n").alias("u"), number("parent").alias("v"), "load")
    return trees.from_matrix(rows, t)


def _looked_up(v: DataFrame) -> DataFrame:
    a = mesh.available_edges(mesh.triangles(v), v).select("site_id", F.col("u").alias("a"), F.col("v").alias("b"), "kind")
    f = trees.seed_forest(v).select("site_id", "n", "parent", F.least("n", "parent").alias("a"), F.greatest("n", "parent").alias("b"))
    return f.join(a, ["site_id", "a", "b"], "left").select("site_id", "n", "parent", "kind")

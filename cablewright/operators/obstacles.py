"""Sites with borders and obstacles: edges that polygons cut, the constrained mesh, and ways around."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.store import work_table
from . import kernels as K
from . import rounds
from .joins import with_points
from .mesh import hull_edges, site
from .mesh import sides as mesh_sides
from .polygons import sides
from .tiles import spread


def cut_edges(edges: DataFrame, v: DataFrame, polygons: DataFrame) -> DataFrame:
    """Edges that cross some side of a polygon of their site, with the number of such sides."""
    e = with_points(edges.select("site_id", "u", "v"), v)
    p = sides(polygons).select("site_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "tx", "ty")
    met = e.join(p, "site_id").filter(G.is_crossing(*(G.point(c) for c in "uvst"), touch=False))
    return met.groupBy("site_id", "u", "v").agg(F.count("*").alias("sides"))


def concave_hull(t: DataFrame, v: DataFrame, border: DataFrame) -> DataFrame:
    """Sides u < v of the mesh's rim once it keeps within the border: triangles behind rim sides that cross the border go, and so on inwards.

    t: the mesh's triangles. In each round go all triangles that share a crossing side with one that went. Points that
    are left without a triangle are on no rim.
    """
    s = mesh_sides(t).select("site_id", "u", "v", F.array_sort(F.array("u", "v", "w")).alias("k"))
    crossing = cut_edges(s.select("site_id", "u", "v").distinct(), v, border).select("site_id", "u", "v")
    open_ = work_table(s.join(crossing, ["site_id", "u", "v"]), "crossing")
    gone = front = work_table(open_.join(hull_edges(t), ["site_id", "u", "v"]).select("site_id", "k").distinct(), "gone")
    while not front.isEmpty():
        next_ = open_.join(front, ["site_id", "k"]).select("site_id", "u", "v").distinct().join(open_, ["site_id", "u", "v"]).select("site_id", "k").distinct()
        front = work_table(next_.join(gone, ["site_id", "k"], "left_anti"), "gone")
        gone = gone.unionByName(front)
    left = t.select("site_id", F.array_sort(F.array("a", "b", "c")).alias("k")).join(gone, ["site_id", "k"], "left_anti")
    return hull_edges(left.select("site_id", *[F.col("k")[i].alias(c) for i, c in enumerate("abc")]))


def shortcuts(triples: DataFrame, v: DataFrame, polygons: DataFrame) -> DataFrame:
    """For points s, b, t of a path: whether the straight line from s to t is free, so that b may be left out."""
    cut = cut_edges(triples.select("site_id", F.col("s").alias("u"), F.col("t").alias("v")).distinct(), v, polygons)
    j = triples.join(cut.select("site_id", F.col("u").alias("s"), F.col("v").alias("t"), "sides"), ["site_id", "s", "t"], "left")
    return j.select("site_id", "path", "s", "b", "t", F.col("sides").isNull().alias("free"))


def _joined(v: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points and polygon vertices of a site as rows (site_id, n, x, y, poly_id, seq); poly_id is null for points."""
    p = polygons.select("site_id", F.lit(None).cast("long").alias("n"), "x", "y", F.col("poly_id").cast("long").alias("poly_id"), F.col("seq").cast("long").alias("seq"))
    return v.select("site_id", "n", "x", "y", F.lit(None).cast("long").alias("poly_id"), F.lit(None).cast("long").alias("seq")).unionByName(p)


def _split(pdf: pd.DataFrame):
    """ids, coordinates of points and then of vertices, and the rings as indices, the border first."""
    ids, xy = site(pdf[pdf["poly_id"].isna()])
    rings, at = [], len(ids)
    parts = [xy]
    for _, ring in pdf[pdf["poly_id"].notna()].sort_values(["poly_id", "seq"]).groupby("poly_id"):
        parts.append(ring[["x", "y"]].to_numpy())
        rings.append(list(range(at, at + len(ring))))
        at += len(ring)
    return [int(i) for i in ids], K.points(np.vstack(parts)), rings


def navigation_mesh(v: DataFrame, polygons: DataFrame) -> DataFrame:
    """For each site, checks on its constrained triangulation: triangles, twice their area, forced sides that lack, triangles in holes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, xy, rings = _split(pdf)
        tri = K.navigation_mesh(xy, rings[0], rings[1:])
        have = {frozenset((a, b)) for t in tri for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        forced = [(r[k], r[(k + 1) % len(r)]) for r in rings for k in range(len(r))]
        lack = sum(frozenset((a, b)) not in have and not K.between(xy, a, b) for a, b in forced)
        area = sum(K.orient(xy, *t) for t in tri)
        held = sum(any(K.inside(xy[h], xy[list(t)].mean(axis=0)) for h in rings[1:]) for t in tri)
        return pd.DataFrame([(pdf["site_id"].iloc[0], len(tri), area, lack, held)], columns=["site_id", "triangles", "area2", "lacking", "in_holes"])

    j = _joined(v, polygons)
    # Twice the area is whole where coordinates are.
    area = "long" if j.schema["x"].dataType.typeName() in ("long", "integer", "short", "byte") else "double"
    return spread(j, "site_id").applyInPandas(run, f"site_id long, triangles long, area2 {area}, lacking long, in_holes long")


#: Corners are numbered from here on, beyond all terminals.
CORNER, POLYGON = 1 << 40, 1 << 20


def free_legs(v: DataFrame, polygons: DataFrame) -> DataFrame:
    """site_id, u < v, w: straight legs of points to roots, and of points and corners to corners, that cross no obstacle; w is the length.

    Corners are nodes from `CORNER` on, `POLYGON` to an obstacle. A leg may touch an obstacle or run along it; the inner
    diagonals of obstacles are walls, too, so that no leg leads through one.
    """
    ring = polygons.filter("poly_id > 0")
    corners = ring.select("site_id", (F.lit(CORNER) + F.col("poly_id").cast("long") * POLYGON + F.col("seq")).alias("n"), "x", "y")
    nodes = work_table(v.select("site_id", "n", "x", "y").unionByName(corners), "nodes")
    size = ring.groupBy("site_id", "poly_id").agg((F.max("seq") + 1).alias("size"))
    s, t = (ring.select("site_id", "poly_id", F.col("seq").alias(f"{c}k"), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")) for c in "st")
    # Every two corners of one obstacle: its sides and its inner diagonals.
    walls = work_table(s.join(t, ["site_id", "poly_id"]).filter("sk < tk").join(size, ["site_id", "poly_id"]).select("site_id", "sx", "sy", "tx", "ty"), "walls")
    a, b = (nodes.select("site_id", F.col("n").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")) for c in "uv")
    # All nodes meet the corners alone, and terminals the roots: never all nodes all others.
    legs = a.join(b.filter(F.col("v") >= CORNER), "site_id").filter("u < v").unionByName(a.filter("u < 0").join(b.filter((F.col("v") >= 0) & (F.col("v") < CORNER)), "site_id"))
    shut = legs.join(walls, "site_id").filter(G.is_crossing(*(G.point(c) for c in "uvst"), touch=False)).select("site_id", "u", "v").distinct()
    return legs.join(shut, ["site_id", "u", "v"], "left_anti").select("site_id", "u", "v", G.distance(G.point("u"), G.point("v")).alias("w"))


def root_distances(v: DataFrame, polygons: DataFrame) -> DataFrame:
    """site_id, n, root, length (thousandths) of the shortest way that crosses no obstacle; null if there is none.

    Ways bend at corners alone: a point within an obstacle is an end, and no way leads over it.
    """
    legs = work_table(free_legs(v, polygons), "legs")
    first = legs.filter(f"u < 0 AND v >= {CORNER}").select("site_id", F.col("u").alias("root"), F.col("v").alias("n"), F.col("w").alias("way"))
    to = rounds.ways_from(legs.filter(f"u >= {CORNER}"), first).withColumnRenamed("n", "v")
    direct = legs.filter(f"u < 0 AND v < {CORNER}").select("site_id", F.col("v").alias("n"), F.col("u").alias("root"), F.col("w").alias("way"))
    last = legs.filter(f"u >= 0 AND u < {CORNER}").join(to, ["site_id", "v"]).select("site_id", F.col("u").alias("n"), "root", (F.col("way") + F.col("w")).alias("way"))
    d = direct.unionByName(last).groupBy("site_id", "n", "root").agg(F.min("way").alias("way"))
    every = v.filter("n >= 0").select("site_id", "n").join(v.filter("n < 0").select("site_id", F.col("n").alias("root")), "site_id")
    return every.join(d, ["site_id", "n", "root"], "left").select("site_id", "n", "root", F.round(F.col("way") * 1000).cast("long").alias("length"))


def contours(edges: DataFrame, v: DataFrame, polygons: DataFrame) -> DataFrame:
    """For edges that an obstacle cuts: the length (thousandths) of the shortest way around, and its corners from u to v as midpath (numbered as in `free_legs`). Edges without a way are left out.

    polygons: the border as polygon 0, and obstacles. Of equally short ways that with the lesser corners, from v on.
    """
    cut = work_table(cut_edges(edges, v, polygons.filter("poly_id > 0")).select("site_id", "u", "v"), "cut")
    # Ways bend at corners alone: of the points, only the ends of cut edges count.
    ends = cut.select("site_id", F.explode(F.array("u", "v")).alias("n")).distinct()
    legs = free_legs(v.join(ends, ["site_id", "n"], "left_semi"), polygons).filter(F.col("v") >= CORNER)
    legs = work_table(legs.unionByName(legs.select("site_id", F.col("v").alias("u"), F.col("u").alias("v"), "w")).select("site_id", F.col("u").alias("p"), F.col("v").alias("at"), "w"), "legs")
    # Ways between corners, of which there are few, and from them those from each u to every corner.
    inner = legs.filter(f"p < at AND p >= {CORNER}").select("site_id", F.col("p").alias("u"), F.col("at").alias("v"), "w")
    every = polygons.filter("poly_id > 0").select("site_id", (F.lit(CORNER) + F.col("poly_id").cast("long") * POLYGON + F.col("seq")).alias("root"))
    between = rounds.ways_from(inner, every).select("site_id", F.col("root").alias("at"), F.col("n").alias("p"), "way")
    first = cut.select("site_id", "u").distinct().join(legs.withColumnRenamed("p", "u"), ["site_id", "u"])
    d = first.join(between, ["site_id", "at"]).groupBy("site_id", "u", "p").agg(F.min(F.col("w") + F.col("way")).alias("way"))
    d = work_table(d.unionByName(cut.select("site_id", "u", F.col("u").alias("p"), F.lit(0.0).alias("way")).distinct()), "ways")
    last = cut.join(legs.withColumnRenamed("at", "v"), ["site_id", "v"]).join(d, ["site_id", "u", "p"])
    found = last.groupBy("site_id", "u", "v").agg(F.round(F.min(F.col("way") + F.col("w")) * 1000).cast("long").alias("length"))
    now, way, k = found.select("site_id", "u", "v", F.col("v").alias("at")), None, 0
    while True:
        # From v back: the corner before each is the one from which it is nearest.
        back = now.join(legs, ["site_id", "at"]).join(d, ["site_id", "u", "p"]).groupBy("site_id", "u", "v").agg(F.min(F.struct((F.col("way") + F.col("w")).alias("d"), "p")).alias("b"))
        now = work_table(back.select("site_id", "u", "v", F.col("b.p").alias("at")).filter("at <> u"), "way")
        step, k = now.withColumn("k", F.lit(-k)), k + 1
        way = step if way is None else way.unionByName(step)
        if now.isEmpty():
            break
    corners = way.groupBy("site_id", "u", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "at"))), lambda s: s["at"]).alias("midpath"))
    return found.join(corners, ["site_id", "u", "v"])


def solve_around(v: DataFrame, polygons: DataFrame, capacity: int) -> DataFrame:
    """Savings forests whose links cross no obstacle's side, and ways for the gates that would: checks for each site."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, xy, rings = _split(pdf)
        own = xy[: len(ids)]
        walls = [(*xy[r[k]].tolist(), *xy[r[(k + 1) % len(r)]].tolist()) for r in rings[1:] for k in range(len(r))]
        parent = K.esau_williams(ids, own, K.available(own), capacity, rule="bins", gates_block=True, rootlust=0.6, blocked=walls)
        at = {i: k for k, i in enumerate(ids)}
        cut = sum(K._hits(own, at[a], at[b], np.array(walls, float)) for a, b in parent.items() if b >= 0)
        ways, failed = K.detours(ids, own, parent, walls)
        bent = sum(K._hits(own, at[a], at[b], np.array(walls, float)) for w in ways.values() for a, b in zip(w, w[1:], strict=False))
        return pd.DataFrame([(pdf["site_id"].iloc[0], len(parent), int(cut), int(bent), len(ways), len(failed))], columns=["site_id", "links", "cut_links", "cut_ways", "ways", "failed"])

    return spread(_joined(v, polygons), "site_id").applyInPandas(run, "site_id long, links long, cut_links long, cut_ways long, ways long, failed long")

"""The navigation mesh: triangles by tiles, and all that follows from them as joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.store import work_table
from . import kernels as K
from . import rounds
from .joins import with_points
from .tiles import triangles


def site(pdf: pd.DataFrame) -> tuple[list[int], np.ndarray]:
    """ids in ascending order and their coordinates, whole or not."""
    pdf = pdf.sort_values("n")
    return pdf["n"].tolist(), K.points(pdf[["x", "y"]].to_numpy())


def sides(t: DataFrame) -> DataFrame:
    """Each triangle's sides u < v with the opposite vertex w."""
    side = lambda u, v, w: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.col(w).alias("w"))
    return t.select("site_id", F.explode(F.array(side("a", "b", "c"), side("a", "c", "b"), side("b", "c", "a"))).alias("s")).select("site_id", "s.*")


def hull_edges(t: DataFrame) -> DataFrame:
    """Sides of one triangle alone."""
    return sides(t).groupBy("site_id", "u", "v").agg(F.count("*").alias("k")).filter("k = 1").select("site_id", "u", "v")


def pruned(t: DataFrame, v: DataFrame, ratio: float = 50.0) -> DataFrame:
    """The triangles without the flat ones at the rim: those of an aspect ratio over `ratio` that have a side of the hull go, and flat ones behind those, until none is left there."""
    p = t
    for c in "abc":
        p = p.join(v.select("site_id", F.col("n").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), ["site_id", c])
    flat = p.filter(F.coalesce(G.aspect_ratio(*(G.point(c) for c in "abc")), F.lit(float("inf"))) > ratio).select("site_id", "a", "b", "c")
    s = work_table(sides(flat).select("site_id", "u", "v", F.array_sort(F.array("u", "v", "w")).alias("k")), "flat")
    gone = front = work_table(s.join(hull_edges(t), ["site_id", "u", "v"]).select("site_id", "k").distinct(), "gone")
    while not front.isEmpty():
        next_ = s.join(front, ["site_id", "k"]).select("site_id", "u", "v").distinct().join(s, ["site_id", "u", "v"]).select("site_id", "k").distinct()
        front = work_table(next_.join(gone, ["site_id", "k"], "left_anti"), "gone")
        gone = gone.unionByName(front)
    left = t.select("site_id", F.array_sort(F.array("a", "b", "c")).alias("k")).join(gone, ["site_id", "k"], "left_anti")
    return left.select("site_id", *[F.col("k")[i].alias(c) for i, c in enumerate("abc")])


def diagonals(t: DataFrame, v: DataFrame) -> DataFrame:
    """s < t across the side u < v of two triangles that form a strictly convex quadrilateral."""
    two = sides(t).groupBy("site_id", "u", "v").agg(F.min("w").alias("s"), F.max("w").alias("t")).filter("s < t")
    p = with_points(with_points(two, v), v, "s", "t")
    return p.filter(G.convex_pair(*(G.point(c) for c in "uvst"))).select("site_id", "s", "t", "u", "v")


def available_edges(t: DataFrame, v: DataFrame) -> DataFrame:
    """Sides (delaunay) and diagonals (extended) with squared lengths."""
    d = sides(t).select("site_id", "u", "v").distinct().withColumn("kind", F.lit("delaunay"))
    x = diagonals(t, v).select("site_id", F.col("s").alias("u"), F.col("t").alias("v"), F.lit("extended").alias("kind"))
    return with_points(d.unionByName(x), v).select("site_id", "u", "v", "kind", G.d2(G.point("u"), G.point("v")).alias("l2"))


def half_edges(t: DataFrame, v: DataFrame) -> DataFrame:
    """Each directed side with the next neighbour of its tail, counter-clockwise and clockwise."""
    d = sides(t).select("site_id", "u", "v").distinct()
    both = with_points(d.unionByName(d.select("site_id", F.col("v").alias("u"), F.col("u").alias("v"))), v)
    angle = F.atan2((F.col("vy") - F.col("uy")).cast("double"), (F.col("vx") - F.col("ux")).cast("double"))
    w = Window.partitionBy("site_id", "u").orderBy("angle")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = both.withColumn("angle", angle)
    return e.select("site_id", "u", "v", F.coalesce(F.lead("v").over(w), F.first("v").over(whole)).alias("ccw"), F.coalesce(F.lag("v").over(w), F.last("v").over(whole)).alias("cw"))


def exclusive_pairs(t: DataFrame, v: DataFrame) -> DataFrame:
    """Pairs of available edges that cross: a diagonal and its side, or diagonals that share a triangle.

    The lookup is by equality on triangles' sides alone: no comparison of all edges with all.
    """
    d = diagonals(t, v)
    own = d.select("site_id", "u", "v", "s", "t")
    tri = sides(t)
    # A diagonal lies in the two triangles on its side; two diagonals of one triangle may cross.
    by = d.join(tri, ["site_id", "u", "v"]).select("site_id", "s", "t", F.array_sort(F.array("u", "v", "w")).alias("tri"))
    a = by.select("site_id", "tri", F.col("s").alias("u"), F.col("t").alias("v"))
    pairs = a.join(by, ["site_id", "tri"]).filter("(u < s OR (u = s AND v < t)) AND u <> s AND u <> t AND v <> s AND v <> t").drop("tri").distinct()
    p = with_points(with_points(pairs, v), v, "s", "t")
    met = p.filter(G.is_crossing(*(G.point(c) for c in "uvst"), touch=False)).select("site_id", "u", "v", "s", "t")
    first = (F.col("u") < F.col("s")) | ((F.col("u") == F.col("s")) & (F.col("v") < F.col("t")))
    own = own.select("site_id", *[F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("u", "s"), ("v", "t"), ("s", "u"), ("t", "v"))])
    return own.unionByName(met)


def flipped(t: DataFrame, d: DataFrame, links: DataFrame) -> DataFrame:
    """The triangles once the diagonals among the links (site_id, u, v) have taken their sides' places.

    Diagonals of one triangle cross, so links that don't cross flip no triangle twice.
    """
    used = d.join(links.select("site_id", F.least("u", "v").alias("s"), F.greatest("u", "v").alias("t")).distinct(), ["site_id", "s", "t"])
    gone = used.select("site_id", "u", "v", F.explode(F.array("s", "t")).alias("w"))
    corner = lambda x, y, z: F.array_sort(F.array(x, y, z))
    gone = gone.select("site_id", corner("u", "v", "w").alias("k"))
    new = used.select("site_id", F.explode(F.array(corner("s", "t", "u"), corner("s", "t", "v"))).alias("k"))
    kept = t.select("site_id", corner("a", "b", "c").alias("k")).join(gone, ["site_id", "k"], "left_anti")
    return kept.unionByName(new).select("site_id", *[F.col("k")[i].alias(c) for i, c in enumerate("abc")])


def build(v: DataFrame) -> DataFrame:
    """The mesh of each site as one table (site_id, kind, a, b, c, value): triangles, sides and diagonals with squared lengths, hull sides, pairs of edges
    that exclude each other (a, b, c and value hold u, v, s, t), and the lengths of ways to roots in thousandths."""
    t = triangles(v)
    none = F.lit(None).cast("long")
    e = available_edges(t, v)
    parts = [
        t.select("site_id", F.lit("triangle").alias("kind"), "a", "b", "c", none.alias("value")),
        e.select("site_id", "kind", F.col("u").alias("a"), F.col("v").alias("b"), none.alias("c"), F.col("l2").alias("value")),
        hull_edges(t).select("site_id", F.lit("hull").alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), none.alias("c"), none.alias("value")),
        exclusive_pairs(t, v).select("site_id", F.lit("exclusive").alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("s").alias("c"), F.col("t").alias("value")),
        root_distances(t, v).select("site_id", F.lit("way").alias("kind"), F.col("n").alias("a"), F.col("root").alias("b"), none.alias("c"), F.col("length").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spanning_forest(v: DataFrame) -> DataFrame:
    """Minimum spanning forest over the triangulation, a tree for each root: site_id, u, v, l2."""
    return rounds.spanning_forest(available_edges(triangles(v), v).filter("kind = 'delaunay'"))


def best_paths(t: DataFrame, v: DataFrame) -> DataFrame:
    """For each terminal: the root nearest along the mesh's sides, the way's length in thousandths, and the next point on it; ties go to the least id."""
    d = root_distances(t, v, exact=True)
    e = available_edges(t, v).filter("kind = 'delaunay'").select("site_id", "u", "v", F.sqrt(F.col("l2").cast("double")).alias("w"))
    both = e.unionByName(e.select("site_id", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    mille = lambda c: F.round(c * 1000).cast("long")
    near = d.filter("n >= 0").groupBy("site_id", "n").agg(F.min(F.struct(mille(F.col("way")).alias("length"), F.col("root"))).alias("b")).select("site_id", "n", "b.root", "b.length")
    step = near.join(both.withColumnRenamed("u", "n"), ["site_id", "n"]).join(d.select("site_id", "root", F.col("n").alias("v"), "way"), ["site_id", "root", "v"])
    return step.groupBy("site_id", "n", "root", "length").agg(F.min(F.struct(mille(F.col("w") + F.col("way")).alias("d"), F.col("v"))).alias("b")).select("site_id", "n", "root", "length", F.col("b.v").alias("step"))


def root_distances(t: DataFrame, v: DataFrame, exact: bool = False) -> DataFrame:
    """Length of the shortest way along the mesh's sides from each terminal to each root, in thousandths; if exact, of every point, as `way`, a double."""
    e = available_edges(t, v).filter("kind = 'delaunay'").select("site_id", "u", "v", F.sqrt(F.col("l2").cast("double")).alias("w"))
    d = rounds.ways_from(e, v.filter("n < 0").select("site_id", F.col("n").alias("root")))
    if exact:
        return d.select("site_id", "n", "root", "way")
    return d.filter("n >= 0").select("site_id", "n", "root", F.round(F.col("way") * 1000).cast("long").alias("length"))

"""Borders and obstacles as rows (site_id, poly_id, seq, x, y)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

MARGIN, BOX = 500, 300


def box_border(v: DataFrame, margin: int = MARGIN) -> DataFrame:
    """The bounding box of each site, grown by a margin, counter-clockwise."""
    b = v.groupBy("site_id").agg((F.min("x") - margin).alias("x0"), (F.max("x") + margin).alias("x1"), (F.min("y") - margin).alias("y0"), (F.max("y") + margin).alias("y1"))
    corner = lambda k, x, y: F.struct(F.lit(k).alias("seq"), F.col(x).alias("x"), F.col(y).alias("y"))
    corners = F.array(corner(0, "x0", "y0"), corner(1, "x1", "y0"), corner(2, "x1", "y1"), corner(3, "x0", "y1"))
    return b.select("site_id", F.lit(0).alias("poly_id"), F.explode(corners).alias("c")).select("site_id", "poly_id", "c.*")


def box_obstacle(v: DataFrame, half: int = BOX) -> DataFrame:
    """A box about each site's mean point (rounded down), clockwise, as polygon 1."""
    b = v.groupBy("site_id").agg(F.floor(F.avg("x")).alias("cx"), F.floor(F.avg("y")).alias("cy"))
    corner = lambda k, dx, dy: F.struct(F.lit(k).alias("seq"), (F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    corners = F.array(corner(0, -half, -half), corner(1, -half, half), corner(2, half, half), corner(3, half, -half))
    return b.select("site_id", F.lit(1).alias("poly_id"), F.explode(corners).alias("c")).select("site_id", "poly_id", "c.*")


def sides(p: DataFrame) -> DataFrame:
    """Each side of a polygon: seq, x, y and the next vertex as tx, ty; the last is followed by the first."""
    w = Window.partitionBy("site_id", "poly_id").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return p.select("site_id", "poly_id", "seq", "x", "y", after("x").alias("tx"), after("y").alias("ty"))


def area_perimeter(p: DataFrame) -> DataFrame:
    """Twice the signed area, and the perimeter in thousandths as a sum of rounded sides."""
    s = sides(p)
    length = F.round(F.sqrt(G.d2((F.col("x"), F.col("y")), G.point("t")).cast("double")) * 1000).cast("long")
    return s.groupBy("site_id", "poly_id").agg(F.sum(F.col("x") * F.col("ty") - F.col("tx") * F.col("y")).alias("area2"), F.sum(length).alias("perimeter"))


def contains(points: DataFrame, p: DataFrame) -> DataFrame:
    """Points (site_id, n, x, y) with inside for each polygon of their site; the boundary counts as inside."""
    s = sides(p).select("site_id", "poly_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "tx", "ty")
    j = points.select("site_id", "n", "x", "y").join(s, "site_id")
    at, a, b = (F.col("x"), F.col("y")), G.point("s"), G.point("t")
    turn = G.orientation(a, b, at)
    on = (turn == 0) & (F.col("x") >= F.least("sx", "tx")) & (F.col("x") <= F.greatest("sx", "tx")) & (F.col("y") >= F.least("sy", "ty")) & (F.col("y") <= F.greatest("sy", "ty"))
    winding = F.when((F.col("sy") <= F.col("y")) & (F.col("ty") > F.col("y")) & (turn > 0), 1).when((F.col("sy") > F.col("y")) & (F.col("ty") <= F.col("y")) & (turn < 0), -1).otherwise(0)
    return j.groupBy("site_id", "poly_id", "n").agg(F.bool_or(on).alias("on"), F.sum(winding).alias("w")).select("site_id", "poly_id", "n", (F.col("on") | (F.col("w") != 0)).alias("inside"))


def clears(points: DataFrame, repellers: DataFrame, radius: int) -> DataFrame:
    """Points farther than a radius from every repeller of their site."""
    r = repellers.select("site_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = (points["site_id"] == r["site_id"]) & (G.d2((points["x"], points["y"]), (r["rx"], r["ry"])) < radius * radius)
    return points.join(r, near, "left_anti")


def frame(v: DataFrame) -> DataFrame:
    """Offset and extents of each site, and the sum of extents as a scale."""
    return v.groupBy("site_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))


def normalize(v: DataFrame) -> DataFrame:
    """Coordinates less the offset, over the root of the bounding box's area, in millionths."""
    f = v.join(frame(v), "site_id")
    side = F.sqrt((F.col("w") * F.col("h")).cast("double"))
    unit = lambda c: F.round((F.col(c) - F.col(f"{c}0")) / side * 1_000_000).cast("long").alias(c)
    return f.select("site_id", "n", unit("x"), unit("y"))


def rescale(unit: DataFrame, v: DataFrame) -> DataFrame:
    """The inverse of normalize, with the frame of v; whole coordinates come back exactly."""
    f = unit.join(frame(v), "site_id")
    side = F.sqrt((F.col("w") * F.col("h")).cast("double"))
    back = lambda c: F.round(F.col(c) / 1_000_000 * side + F.col(f"{c}0")).cast("long").alias(c)
    return f.select("site_id", "n", back("x"), back("y"))


def notched_border(v: DataFrame, margin: int = MARGIN) -> DataFrame:
    """The grown bounding box with a notch: the upper side's middle is drawn down by a quarter of the height."""
    b = v.groupBy("site_id").agg((F.min("x") - margin).alias("x0"), (F.max("x") + margin).alias("x1"), (F.min("y") - margin).alias("y0"), (F.max("y") + margin).alias("y1"))
    b = b.withColumn("xm", F.floor((F.col("x0") + F.col("x1")) / 2)).withColumn("ym", F.col("y1") - F.floor((F.col("y1") - F.col("y0")) / 4))
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("xm", "ym"), ("x0", "y1")]
    rows = F.array(*[F.struct(F.lit(k).alias("seq"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in enumerate(corners)])
    return b.select("site_id", F.lit(0).alias("poly_id"), F.explode(rows).alias("c")).select("site_id", "poly_id", "c.*")


def concavities(border: DataFrame) -> DataFrame:
    """What the convex hull of each border has beyond it: polygons (concavity, seq, x, y), each from a hull corner along the border to the next."""
    from .kernels import pockets

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = pdf.sort_values("seq")
        found = pockets(ring[["x", "y"]].to_numpy())
        rows = [(int(ring["site_id"].iloc[0]), c, k, int(ring["x"].iloc[i]), int(ring["y"].iloc[i])) for c, part in enumerate(found) for k, i in enumerate(part)]
        return pd.DataFrame(rows, columns=["site_id", "concavity", "seq", "x", "y"])

    return border.groupBy("site_id").applyInPandas(run, "site_id long, concavity int, seq int, x long, y long")


def unit_area(v: DataFrame, border: DataFrame) -> DataFrame:
    """Coordinates less the border's least ones, over the root of its area, in millionths."""
    area = area_perimeter(border).select("site_id", F.sqrt((F.abs("area2") / 2).cast("double")).alias("side"))
    f = v.join(area, "site_id").join(border.groupBy("site_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0")), "site_id")
    unit = lambda c: F.round((F.col(c) - F.col(f"{c}0")) / F.col("side") * 1_000_000).cast("long").alias(c)
    return f.select("site_id", "n", unit("x"), unit("y"))


def single_root(v: DataFrame) -> DataFrame:
    """Terminals as they are, and in place of the roots their centroid, rounded down, as root -1."""
    c = v.filter("n < 0").groupBy("site_id").agg(F.floor(F.avg("x")).alias("x"), F.floor(F.avg("y")).alias("y"))
    return v.filter("n >= 0").select("site_id", F.col("n").cast("long").alias("n"), "x", "y").unionByName(c.select("site_id", F.lit(-1).cast("long").alias("n"), "x", "y"))

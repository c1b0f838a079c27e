"""Delaunay triangles of sites of any size: a tile's points and a halo at a time, until no circle is open.

A site of more than `POINTS` points is cut into strips by quantiles of x, and strips into tiles by quantiles of y. Each
tile triangulates its own points with those of a halo. A triangle is certain where its circle lies within what the tile
knows; the other circles, and the outer sides of what the tile knows, are sent to the tiles that they reach, which
answer with points of theirs that lie within. A tile that got answers goes on with these, one without any is done; it
keeps the triangles whose least point is its own. Four points on a circle are told apart by their ids, so
that tiles agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import work_table
from . import kernels as K

#: Points of a tile, and of a site that is one tile.
POINTS = 1024
#: Quantiles that cuts are taken from; a site has this many strips at most.
QUANTILES = 1024
#: Width of the halo, in mean distances between a site's points.
HALO = 3.0
#: Points that a tile answers one circle with in a round; further ones follow in later rounds.
ANSWERS = 8

TILE = ["site_id", "strip", "slot"]
#: Tasks that sites or instances, and tiles, are dealt to at least.
TASKS, TILE_TASKS = 256, 64


def spread(df: DataFrame, *keys: str, tasks: int = TASKS):
    """df grouped by its keys for work that takes long for few rows: a fixed number of tasks, which Spark would else make fewer by the rows' size."""
    tasks = max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys).groupBy(*keys)


_KNOWN = "site_id long, strip int, slot int, kind int, n long, x {0}, y {0}, a long, b long, c long"
_ASKED = "site_id long, strip int, slot int, done boolean, a long, b long, c long, ax {0}, ay {0}, bx {0}, by {0}, cx {0}, cy {0}, x0 double, x1 double, y0 double, y1 double"


def _cuts(v: DataFrame, by: list[str], axis: str, parts: Column) -> DataFrame:
    """by, <axis>cuts: the inner bounds of `parts` parts of like numbers of points."""
    levels = F.array(*[F.lit(k / QUANTILES) for k in range(1, QUANTILES)])
    q = v.withColumn("parts", parts).groupBy(*by).agg(F.percentile_approx(F.col(axis).cast("double"), levels, 10 * QUANTILES).alias("q"), F.first("parts").alias("parts"))
    at = lambda k: F.get(F.col("q"), (k * F.lit(QUANTILES) / F.col("parts")).cast("int") - 1)
    return q.select(*by, F.when(F.col("parts") > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("parts") - 1)), at))).otherwise(F.array().cast("array<double>")).alias(f"{axis}cuts"))


def _below(cuts: str, x: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < x))


def _reached(boxes: DataFrame, xcuts: DataFrame, ycuts: DataFrame, keep: list) -> DataFrame:
    """A row for each tile that a box (x0, x1, y0, y1) meets."""
    j = boxes.join(xcuts, "site_id").withColumn("strip", F.explode(F.sequence(_below("xcuts", F.col("x0")), _below("xcuts", F.col("x1")))))
    j = j.join(ycuts, ["site_id", "strip"]).withColumn("slot", F.explode(F.sequence(_below("ycuts", F.col("y0")), _below("ycuts", F.col("y1")))))
    return j.select(*keep, "strip", "slot")


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tile's triangles if none is open (done), else what it asks: a triangle, or a side with open land on its left (no c), or, knowing one point, for any other (no a)."""
    where = [pdf[c].iloc[0] for c in TILE]
    x0, x1, y0, y1 = (float(pdf[c].iloc[0]) for c in ("x0", "x1", "y0", "y1"))
    clear = {tuple(-1 << 62 if pd.isna(x) else int(x) for x in r) for r in pdf.loc[pdf["kind"] == 2, ["a", "b", "c"]].itertuples(index=False)}
    pts = pdf[pdf["kind"] < 2].sort_values(["n", "kind"]).drop_duplicates("n")
    ids, own, at = pts["n"].astype("int64").tolist(), (pts["kind"] == 0).to_numpy(), pts[["x", "y"]].to_numpy()
    xy, plain = K.points(at), at.astype(float)
    tri = K.delaunay(xy)
    none = -1 << 62
    asked = []

    def ask(*key):
        names = [none if k is None else ids[k] for k in key]
        if tuple(names) not in clear:
            asked.append((names, key))

    if not tri and len(ids) > 1:
        # All on a line: what lies on either side of it?
        a, b = np.lexsort((at[:, 1], at[:, 0]))[[0, -1]].tolist()
        ask(a, b, None)
        ask(b, a, None)
    elif not tri:
        ask(None, None, None)
    else:
        sides = {s for a, b, c in tri for s in ((a, b), (b, c), (c, a))}
        for a, b in sides:
            if (b, a) not in sides and (own[a] or own[b]):
                ask(b, a, None)
        for t in tri:
            if own[list(t)].any():
                x, y, r = K.circle(plain, *t)
                if not (x - r > x0 and x + r < x1 and y - r > y0 and y + r < y1):
                    ask(*t)
    if not asked:
        rows = [(*where, True, *sorted(ids[k] for k in t), *[None] * 10) for t in tri if own[min(t)]]
        return pd.DataFrame(rows, columns=_columns())
    rows = []
    for names, key in asked:
        ends = [None if k is None else at[k][i] for k in key for i in (0, 1)]
        box = (-math.inf, math.inf) * 2
        if key[2] is not None and (ring := K.circle(plain, *key))[2] < math.inf:
            x, y, r = ring
            box = (x - r, x + r, y - r, y + r)
        rows.append((*where, False, *[None if k == none else k for k in names], *ends, *box))
    return pd.DataFrame(rows, columns=_columns())


def _columns() -> list[str]:
    return [c.split()[0] for c in _ASKED.split(", ")]


def _answers(asked: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
    """Points of a tile that lie within the circles it is asked about, the deepest first; beyond a side, the best one and those on it."""
    rows = []
    if len(asked) and len(pts):
        own = pts[["x", "y"]].to_numpy()
        ids = pts["n"].to_numpy()
        for q in asked.itertuples(index=False):
            if pd.isna(q.a):
                found = {int(own[:, 0].argmin()), int(own[:, 0].argmax())}
            else:
                given = [(q.a, q.ax, q.ay), (q.b, q.bx, q.by)] + ([] if pd.isna(q.c) else [(q.c, q.cx, q.cy)])
                m = len(given)
                xy = K.points(np.concatenate([np.array([g[1:] for g in given], own.dtype), own]))
                rank = np.concatenate([np.array([g[0] for g in given]).astype(np.int64), ids])
                every = np.arange(m, len(xy))
                every = every[~np.isin(ids, rank[:m])]
                if m == 3:
                    depth = K.within_circle(xy, 0, 1, 2, every, rank)
                    inside = np.flatnonzero(depth > 0)
                    found = {int(every[k]) - m for k in inside[np.argsort(-depth[inside], kind="stable")][:ANSWERS]}
                else:
                    best = K.apex(xy, 0, 1, every, rank)
                    found = {k - m for k in (*([] if best is None else [best]), *K.between(xy, 0, 1)[:ANSWERS])}
            rows += [(q.site_id, q.from_strip, q.from_slot, q.a, q.b, q.c, ids[k], own[k][0], own[k][1]) for k in found]
    return pd.DataFrame(rows, columns=["site_id", "strip", "slot", "a", "b", "c", "n", "x", "y"])


def _large(v: DataFrame, sizes: DataFrame, points: int) -> DataFrame:
    kind = "double" if v.schema["x"].dataType.typeName() in ("double", "float", "decimal") else "long"
    v = v.select("site_id", "n", F.col("x").cast(kind).alias("x"), F.col("y").cast(kind).alias("y")).join(sizes, "site_id")
    strips = F.least(F.lit(QUANTILES), F.ceil(F.sqrt(F.col("k") / points))).cast("int")
    xcuts = work_table(_cuts(v, ["site_id"], "x", strips), "xcuts")
    in_strip = v.join(xcuts, "site_id").withColumn("strip", _below("xcuts", F.col("x").cast("double")))
    slots = F.least(F.lit(QUANTILES), F.ceil(F.col("k") / (F.size("xcuts") + 1) / points)).cast("int")
    ycuts = work_table(_cuts(in_strip, ["site_id", "strip"], "y", slots), "ycuts")
    own = in_strip.join(ycuts, ["site_id", "strip"]).withColumn("slot", _below("ycuts", F.col("y").cast("double")))
    points_of = work_table(own.select(*TILE, "n", "x", "y", "halo"), "points")

    # What a tile knows at first: the land between its bounds and the halo around them.
    bound = lambda cuts, k, halo: (F.coalesce(F.get(cuts, k - 1) - halo, F.lit(-math.inf)), F.coalesce(F.get(cuts, k) + halo, F.lit(math.inf)))
    land = points_of.groupBy(*TILE).agg(F.first("halo").alias("halo"), F.min("x").cast("double").alias("bx0"), F.max("x").cast("double").alias("bx1"), F.min("y").cast("double").alias("by0"), F.max("y").cast("double").alias("by1"))
    (x0, x1), (y0, y1) = bound("xcuts", F.col("strip"), F.col("halo")), bound("ycuts", F.col("slot"), F.col("halo"))
    land = work_table(land.join(xcuts, "site_id").join(ycuts, ["site_id", "strip"]).select(*TILE, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), "bx0", "bx1", "by0", "by1"), "land")
    box = lambda c, sign: (F.col(c).cast("double") + sign * F.col("halo")).alias(f"{c}{0 if sign < 0 else 1}")
    about = _reached(points_of.select("site_id", F.col("strip").alias("s"), F.col("slot").alias("t"), "n", "x", "y", box("x", -1), box("x", 1), box("y", -1), box("y", 1)), xcuts, ycuts, ["site_id", "s", "t", "n", "x", "y"])
    known = about.select(*TILE, F.when((F.col("s") == F.col("strip")) & (F.col("t") == F.col("slot")), 0).otherwise(1).alias("kind"), "n", "x", "y", *[F.lit(None).cast("long").alias(c) for c in "abc"])
    known = work_table(known, "known")

    out, ddl = None, _ASKED.format(kind)
    while True:
        got = work_table(spread(known.join(land.drop("bx0", "bx1", "by0", "by1"), TILE), *TILE, tasks=TILE_TASKS).applyInPandas(_tile, ddl), "round")
        done = got.filter("done").select("site_id", "a", "b", "c")
        out = done if out is None else out.unionByName(done)
        asked = got.filter("NOT done")
        if asked.isEmpty():
            return out
        # To the tiles whose points' box has a corner on the open land, or meets the circle's box.
        key = ["site_id", "from_strip", "from_slot", "a", "b", "c", "ax", "ay", "bx", "by", "cx", "cy"]
        sent = asked.withColumnRenamed("strip", "from_strip").withColumnRenamed("slot", "from_slot")
        sent = _reached(sent, xcuts, ycuts, [*key, "x0", "x1", "y0", "y1"]).join(land.select(*TILE, "bx0", "bx1", "by0", "by1"), TILE)
        side = lambda x, y: (F.col("bx") - F.col("ax")) * (F.col(y) - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col(x) - F.col("ax"))
        # Rounded alike or not, a corner that may lie on the side counts as beyond it.
        slack = -1e-9 * ((F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay"))) * (F.col("bx1") - F.col("bx0") + F.col("by1") - F.col("by0") + F.abs(F.col("bx0") - F.col("ax")) + F.abs(F.col("by0") - F.col("ay"))))
        beyond = F.greatest(*[side(x, y) for x in ("bx0", "bx1") for y in ("by0", "by1")]) >= slack
        meets = (F.col("bx0") <= F.col("x1")) & (F.col("bx1") >= F.col("x0")) & (F.col("by0") <= F.col("y1")) & (F.col("by1") >= F.col("y0"))
        sent = sent.filter(meets & (F.col("c").isNotNull() | F.col("a").isNull() | beyond)).select(*key, "strip", "slot")
        answers = spread(sent, *TILE, tasks=TILE_TASKS).cogroup(spread(points_of.join(sent.select(*TILE).distinct(), TILE, "left_semi"), *TILE, tasks=TILE_TASKS)).applyInPandas(_answers, f"site_id long, strip int, slot int, a long, b long, c long, n long, x {kind}, y {kind}")
        answers = work_table(answers.join(known.filter("kind < 2").select(*TILE, "n"), [*TILE, "n"], "left_anti"), "answers")
        # Circles that no tile has a point in are closed for good.
        same = [F.col(f"q.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*TILE, "a", "b", "c")]
        closed = asked.alias("q").join(answers.alias("r"), same, "left_anti").select(*TILE, F.lit(2).alias("kind"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(kind).alias("x"), F.lit(None).cast(kind).alias("y"), "a", "b", "c")
        new = answers.select(*TILE, F.lit(1).alias("kind"), "n", "x", "y", *[F.lit(None).cast("long").alias(c) for c in "abc"]).distinct()
        known = work_table(known.join(asked.select(*TILE).distinct(), TILE, "left_semi").unionByName(new).unionByName(closed), "known")


def triangles(v: DataFrame, points: int = POINTS) -> DataFrame:
    """Delaunay triangles a < b < c of each site's points, roots included. No task holds more than a tile of about `points` points, its halo and answers."""
    span = [(F.max(c) - F.min(c)).cast("double") for c in "xy"]
    # Flat sites have no area: their halo goes by their length.
    halo = HALO * F.greatest(F.sqrt(span[0] * span[1] / F.count("*")), F.greatest(*span) / F.count("*"))
    sizes = v.groupBy("site_id").agg(F.count("*").alias("k"), halo.alias("halo")).filter(F.col("k") > points)
    whole = lambda d: d.groupBy("site_id").applyInPandas(_site, "site_id long, a long, b long, c long")
    if sizes.isEmpty():
        return whole(v)
    sizes = work_table(sizes, "sizes")
    return whole(v.join(sizes, "site_id", "left_anti")).unionByName(_large(v, sizes, points))


def _site(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("n")
    ids = pdf["n"].tolist()
    rows = [(pdf["site_id"].iloc[0], *sorted(ids[k] for k in t)) for t in K.delaunay(K.points(pdf[["x", "y"]].to_numpy()))]
    return pd.DataFrame(rows, columns=["site_id", "a", "b", "c"])

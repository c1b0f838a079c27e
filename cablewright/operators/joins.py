"""Joins between the points and segments of a site. Every join has site_id as an equality, so sites spread over tasks.

Where pairs within a site are asked for, the site's cell grid (`grid_pairs`) limits them to near ones.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.store import work_table


def d2roots(v: DataFrame) -> DataFrame:
    """Terminals x roots: squared distance, its dense rank, the rank of the polar angle, and half-plane flags."""
    t = v.filter("n >= 0").select("site_id", "n", "x", "y")
    r = v.filter("n < 0").select("site_id", F.col("n").alias("root"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    j = t.join(r, "site_id").withColumn("d2", G.d2((F.col("x"), F.col("y")), (F.col("rx"), F.col("ry"))))
    j = j.withColumn("angle", F.atan2((F.col("y") - F.col("ry")).cast("double"), (F.col("x") - F.col("rx")).cast("double")))
    by = Window.partitionBy("site_id", "root")
    return j.select("site_id", "n", "root", "d2", F.dense_rank().over(by.orderBy("d2")).cast("long").alias("dist_rank"), F.dense_rank().over(by.orderBy("angle")).cast("long").alias("angle_rank"), (F.col("x") > F.col("rx")).alias("xhp"), (F.col("y") > F.col("ry")).alias("yhp"))


def assign_root(v: DataFrame) -> DataFrame:
    """The nearest root of each terminal; ties go to the least root id."""
    j = d2roots(v)
    best = F.min(F.struct("d2", "root")).alias("b")
    return j.groupBy("site_id", "n").agg(best).select("site_id", "n", F.col("b.root").alias("root"), F.col("b.d2").alias("d2"))


#: Points of a block, blocks of a site at least, tasks for all pairs of blocks at least, and pairs of blocks that a task has on average where there are more.
BLOCK, BLOCKS, PAIR_TASKS, SHARE = 512, 8, 512, 32


def _pairs(a: DataFrame, b: DataFrame, once: bool = False) -> DataFrame:
    """Pairs of points of a site as u, ux, uy, v, vx, vy, and what else a has; if once, each two points make one pair, in either order.

    A site's points are dealt to blocks, and pairs of blocks to tasks, of which there are more the more pairs there are: no task has more pairs at any size.
    """
    sizes = work_table(b.groupBy("site_id").agg(F.greatest(F.lit(BLOCKS), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks")), "blocks")
    made = sizes.agg(F.sum(F.col("blocks").cast("long") * F.col("blocks"))).first()[0] or 0
    tasks = max(PAIR_TASKS, math.ceil(made / (2 if once else 1) / SHARE))
    block, to = F.pmod(F.hash("n"), F.col("blocks")), lambda first, last: F.explode(F.sequence(first, last))
    left = a.join(sizes, "site_id").withColumn("i", block).withColumn("j", to(F.col("i") if once else F.lit(0), F.col("blocks") - 1)).drop("blocks").withColumnsRenamed({"n": "u", "x": "ux", "y": "uy"})
    right = b.join(sizes, "site_id").withColumn("j", block).select("site_id", F.col("n").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"), "j", to(F.lit(0), F.col("j") if once else F.col("blocks") - 1).alias("i"))
    by = ["site_id", "i", "j"]
    pairs = left.repartition(tasks, *by).join(right.repartition(tasks, *by).hint("merge"), by)
    return (pairs.filter("i < j OR u < v") if once else pairs).drop("i", "j")


def complete_graph(v: DataFrame, prune: bool = True) -> DataFrame:
    """All pairs of terminals with squared length, less those that some root sees under more than a right angle.

    A terminal carries its site's roots, so that a pair is judged where it is made and never sent on.
    """
    t = work_table(v.filter("n >= 0").select("site_id", "n", "x", "y"), "terminals")
    both = lambda pairs: pairs.select("site_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), G.d2(G.point("u"), G.point("v")).alias("l2"))
    if not prune:
        return both(_pairs(t, t, once=True))
    r = v.filter("n < 0").groupBy("site_id").agg(F.collect_list(F.struct("x", "y")).alias("r"))
    most = r.agg(F.max(F.size("r"))).first()[0] or 0
    root = lambda k, c: F.get("r", F.lit(k))[c].alias(f"r{k}{c}")
    pairs = _pairs(t.join(r, "site_id", "left").select("site_id", "n", "x", "y", *[root(k, c) for k in range(most) for c in "xy"]), t, once=True)
    for k in range(most):
        at = G.point(f"r{k}")
        pairs = pairs.filter(F.coalesce(G.dot(G.minus(G.point("u"), at), G.minus(G.point("v"), at)) >= 0, F.lit(True)))
    return both(pairs)


def arcs(edges: DataFrame, hull: DataFrame, v: DataFrame) -> DataFrame:
    """The angle that each root sees an edge under: site_id, u, v, root, exempt, arc. Edges of the hull block nothing: they are exempt, with an arc of 0.

    Edges that some root sees under a right angle or more are left out: from their ends it is shorter to go to that root.
    """
    e = with_points(edges.select("site_id", "u", "v"), v)
    e = e.join(hull.select("site_id", "u", "v", F.lit(True).alias("exempt")), ["site_id", "u", "v"], "left").withColumn("exempt", F.coalesce("exempt", F.lit(False)))
    r = v.filter("n < 0").select("site_id", F.col("n").alias("root"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    j = e.join(r, "site_id").withColumn("arc", F.when(F.col("exempt"), 0.0).otherwise(F.abs(G.angle(G.point("u"), G.point("r"), G.point("v")))))
    most = F.max("arc").over(Window.partitionBy("site_id", "u", "v"))
    return j.withColumn("most", most).filter(F.col("most") < math.pi / 2).select("site_id", "u", "v", "root", "exempt", "arc")


def edge_root(v: DataFrame, edges: DataFrame) -> DataFrame:
    """The root nearest to each edge's midpoint (compared at twice the scale, exactly); ties go to the least root id."""
    e = with_points(edges, v)
    r = v.filter("n < 0").select("site_id", F.col("n").alias("root"), (2 * F.col("x")).alias("rx"), (2 * F.col("y")).alias("ry"))
    mid = (F.col("ux") + F.col("vx"), F.col("uy") + F.col("vy"))
    best = F.min(F.struct(G.d2(mid, G.point("r")).alias("d"), F.col("root"))).alias("b")
    return e.join(r, "site_id").groupBy("site_id", "u", "v").agg(best).select("site_id", "u", "v", F.col("b.root").alias("root"))


#: Points that the fullest cell of the first grid holds at most, while cells can be made smaller.
CROWD = 64


def gridded(v: DataFrame, share: float) -> tuple[DataFrame, float]:
    """v with x0, y0, side and span of its site's grid, whose cells hold `share` points on average; and the factor of sides to begin with."""
    f = v.groupBy("site_id").agg(F.count("*").alias("k"), *[(F.max(c) - F.min(c)).cast("double").alias(c) for c in ("x", "y")], *[F.min(c).cast("double").alias(f"{c}0") for c in ("x", "y")])
    side = F.greatest(F.lit(1e-9), F.sqrt(F.greatest("x", F.col("y") / 1000) * F.greatest("y", F.col("x") / 1000) * share / F.col("k")))
    f = f.select("site_id", "x0", "y0", side.alias("side"), F.greatest("x", "y").alias("span"))
    # Read once: every ring joins it on both sides.
    at, wide = work_table(v.join(f, "site_id"), "points"), 1.0
    while wide > 1e-6 and not at.groupBy("site_id", cell("x", wide), cell("y", wide)).count().filter(F.col("count") > CROWD).isEmpty():
        wide /= 4
    return at, wide


def cell(c: str, wide: float):
    return F.floor((F.col(c) - F.col(f"{c}0")) / (F.col("side") * wide))


def about(left: DataFrame, other: DataFrame, wide: float) -> DataFrame:
    """left (u, ux, uy) with all points (v, vx, vy, and what else `other` has) of the nine cells about each."""
    cells = [F.explode(F.sequence(cell(c, wide) - 1, cell(c, wide) + 1)).alias(f"g{c}") for c in "xy"]
    near = left.select("*", cells[0]).select("*", cells[1]).withColumnsRenamed({"n": "u", "x": "ux", "y": "uy"})
    kept = [c for c in other.columns if c not in ("n", "x", "y", "x0", "y0", "side", "span")]
    return near.join(other.select(*kept, cell("x", wide).alias("gx"), cell("y", wide).alias("gy"), F.col("n").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), ["site_id", "gx", "gy"])


def knn_edges(v: DataFrame, k: int = 4) -> DataFrame:
    """Undirected edges from every point to its k nearest, ties by id.

    Candidates come from the cells around a point's own, of a grid whose fullest cell is small; a point is done if its
    k-th neighbour is no farther than its cells reach. The others go on with cells four times as wide, until the cells
    about a point hold its whole site: so few points of a crowd, and none but the most remote, meet many.
    """
    at, wide = gridded(v.select("site_id", "n", "x", "y"), 2.0 * k)
    left, found = at, None
    per = Window.partitionBy("site_id", "u")
    while True:
        pairs = about(left, at, wide).filter("u <> v").withColumn("l2", G.d2(G.point("u"), G.point("v")))
        top = pairs.withColumn("r", F.row_number().over(per.orderBy("l2", "v"))).filter(F.col("r") <= k)
        all_of_it = F.col("side") * wide > F.col("span")
        done = ((F.count("*").over(per) == k) & (F.max("l2").over(per) <= F.pow(F.col("side") * wide, F.lit(2.0)))) | all_of_it
        got = work_table(top.select("site_id", "u", "v", "l2", done.alias("done")), "nearest")
        found = got.filter("done") if found is None else found.unionByName(got.filter("done"))
        left = left.filter(~all_of_it).join(got.filter("done").select("site_id", F.col("u").alias("n")).distinct(), ["site_id", "n"], "left_anti")
        if left.isEmpty():
            return found.select("site_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "l2").distinct()
        left, wide = work_table(left, "left"), wide * 4


def with_points(edges: DataFrame, v: DataFrame, u: str = "u", w: str = "v") -> DataFrame:
    """Edges with the coordinates of both ends as <u>x, <u>y, <w>x, <w>y."""
    for c in (u, w):
        edges = edges.join(v.select("site_id", F.col("n").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), ["site_id", c])
    return edges


def _cells(e: DataFrame, size) -> DataFrame:
    """Edges with a row for each grid cell that their bounding box covers. size: the cell's side."""
    span = [F.sequence(F.floor(F.least(f"u{c}", f"v{c}") / size), F.floor(F.greatest(f"u{c}", f"v{c}") / size)) for c in "xy"]
    return e.withColumn("gx", F.explode(span[0])).withColumn("gy", F.explode(span[1]))


def crossings(edges: DataFrame, v: DataFrame, touch: bool = False) -> DataFrame:
    """Pairs of edges of a site that cross and share no node: u, v < s, t as pairs.

    Candidates meet in the cells of a grid with the site's mean edge extent as its side, so the
    number of pairs follows the crossings and not the square of the edges; each pair is judged in
    one cell only, the least that both cover.
    """
    e = with_points(edges.select("site_id", "u", "v"), v)
    extent = e.groupBy("site_id").agg(F.greatest(F.lit(1.0), F.avg(F.greatest(F.abs(F.col("ux") - F.col("vx")), F.abs(F.col("uy") - F.col("vy"))))).alias("side"))
    c = _cells(e.join(extent, "site_id"), F.col("side"))
    a = c
    b = c.select("site_id", "gx", "gy", *[F.col(f"{x}{s}").alias(f"{y}{s}") for x, y in (("u", "s"), ("v", "t")) for s in ("", "x", "y")])
    j = a.join(b, ["site_id", "gx", "gy"]).filter("(u < s OR (u = s AND v < t)) AND u <> s AND u <> t AND v <> s AND v <> t")
    low = [F.floor(F.greatest(F.least(f"u{k}", f"v{k}"), F.least(f"s{k}", f"t{k}")) / F.col("side")) for k in "xy"]
    j = j.filter((F.col("gx") == low[0]) & (F.col("gy") == low[1]))
    return j.filter(G.is_crossing(G.point("u"), G.point("v"), G.point("s"), G.point("t"), touch)).select("site_id", "u", "v", "s", "t")


def interferences(edges: DataFrame, v: DataFrame) -> DataFrame:
    """Crossings with touches: `touching` is null for a clean crossing, else 0 to 3 for the end (u, v, s, t) on the other edge."""
    found = crossings(edges, v, touch=True)
    e = with_points(with_points(found, v), v, "s", "t")
    u, w, s, t = (G.point(c) for c in "uvst")
    zero = [G.orientation(s, t, u) == 0, G.orientation(s, t, w) == 0, G.orientation(u, w, s) == 0, G.orientation(u, w, t) == 0]
    which = reduce(lambda out, k: F.when(zero[k], F.lit(k)).otherwise(out), (3, 2, 1, 0), F.lit(None).cast("int"))
    return e.select("site_id", "u", "v", "s", "t", which.alias("touching"))


def gate_crossings(gates: DataFrame, edges: DataFrame, v: DataFrame) -> DataFrame:
    """Gates (root, n) that cross or touch an edge which doesn't hold n.

    By ranks of angles: an edge meets the gate's ray if the gate's rank lies between its ends' ranks,
    and crosses the gate unless n and the root are on one side of it.
    """
    return _gates_by_rank(gates.select("site_id", "root", "n"), edges.select("site_id", "u", "v").filter("u >= 0 AND v >= 0"), v)


#: Buckets of ranks that a root's terminals fall into at most.
BUCKETS = 1024


def _gates_by_rank(gates: DataFrame, edges: DataFrame, v: DataFrame) -> DataFrame:
    """A gate meets the edges over its bucket of ranks alone; an edge over the cut at pi has the buckets at both ends."""
    t = v.filter("n >= 0")
    r = v.filter("n < 0").select("site_id", F.col("n").alias("root"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    a = t.join(r, "site_id").withColumn("angle", F.atan2((F.col("y") - F.col("ry")).cast("double"), (F.col("x") - F.col("rx")).cast("double")))
    by = Window.partitionBy("site_id", "root")
    a = a.withColumn("rank", F.dense_rank().over(by.orderBy("angle")))
    # Ranks of a bucket: a root of few terminals has small ones, so that an edge covers few of them at any size.
    a = work_table(a.withColumn("width", F.greatest(F.lit(1), F.ceil(F.max("rank").over(by) / BUCKETS))), "ranks")
    end = lambda c: a.select("site_id", "root", F.col("n").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"), F.col("angle").alias(f"{c}a"), F.col("rank").alias(f"{c}r"))
    e = edges.join(end("u"), ["site_id", "u"]).join(end("v"), ["site_id", "root", "v"])
    e = e.withColumn("wraps", F.abs(F.col("ua") - F.col("va")) > F.lit(math.pi))
    e = e.join(a.groupBy("site_id", "root").agg(F.max("width").alias("width"), F.max("rank").alias("last")), ["site_id", "root"])
    low, high = F.least("ur", "vr"), F.greatest("ur", "vr")
    bucket = lambda c: F.floor(c / F.col("width"))
    inner = F.sequence(bucket(low), bucket(high))
    # The rest of the circle, in two parts that may share a bucket.
    outer = F.array_union(F.sequence(F.lit(0).cast("long"), bucket(low)), F.sequence(bucket(high), bucket(F.col("last"))))
    e = e.withColumn("bucket", F.explode(F.when(F.col("wraps"), outer).otherwise(inner))).drop("width", "last")
    g = gates.join(a.select("site_id", "root", "n", "rx", "ry", "x", "y", "rank", F.floor(F.col("rank") / F.col("width")).alias("bucket")), ["site_id", "root", "n"])
    j = g.join(e, ["site_id", "root", "bucket"]).filter("n <> u AND n <> v")
    within = G.rank_within(F.col("rank"), F.least("ur", "vr"), F.greatest("ur", "vr"), F.col("wraps"))
    apart = ~G.same_side(G.point("u"), G.point("v"), G.point("r"), (F.col("x"), F.col("y")), touch=False)
    return j.filter(within & apart).select("site_id", "root", "n", "u", "v")


def remap(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each node of a the nearest of b of the same kind, both being one site up to scale, turn and shift.

    The nodes 0 and 1 of either give the similarity, as a product of complex numbers. Nodes that coincide are matched in the order of their ids.
    """
    ends = lambda df, p: df.filter("n IN (0, 1)").groupBy("site_id").agg(*[F.max(F.when(F.col("n") == k, F.col(c))).cast("double").alias(f"{p}{k}{c}") for k in (0, 1) for c in "xy"])
    m = ends(a, "a").join(ends(b, "b"), "site_id")
    dx, dy, ex, ey = F.col("a1x") - F.col("a0x"), F.col("a1y") - F.col("a0y"), F.col("b1x") - F.col("b0x"), F.col("b1y") - F.col("b0y")
    size = dx * dx + dy * dy
    m = m.select("site_id", ((ex * dx + ey * dy) / size).alias("p"), ((ey * dx - ex * dy) / size).alias("q"), "a0x", "a0y", "b0x", "b0y")
    nth = lambda n: F.row_number().over(Window.partitionBy("site_id", F.col(n) < 0, "x", "y").orderBy(n))
    moved = a.withColumn("nth", nth("n")).join(m, "site_id").select("site_id", "n", "nth", (F.col("b0x") + (F.col("x") - F.col("a0x")) * F.col("p") - (F.col("y") - F.col("a0y")) * F.col("q")).alias("mx"), (F.col("b0y") + (F.col("x") - F.col("a0x")) * F.col("q") + (F.col("y") - F.col("a0y")) * F.col("p")).alias("my"))
    # Nodes meet in cells of b's grid, wider ones in each round, until a cell reaches farther than the nearest node found.
    there, wide = gridded(b.select("site_id", "n", "x", "y").withColumn("among", nth("n")), 2.0)
    frame = work_table(there.groupBy("site_id").agg(*[F.first(c).alias(c) for c in ("x0", "y0", "side", "span")], *[F.max(c).cast("double").alias(f"{c}1") for c in "xy"]), "frame")
    left = work_table(moved.join(frame, "site_id").select("site_id", "n", "nth", F.col("mx").alias("x"), F.col("my").alias("y"), "x0", "y0", "side", "span", *[F.greatest(F.col(f"{c}0") - F.col(f"m{c}"), F.col(f"m{c}") - F.col(f"{c}1"), F.lit(0.0)).alias(f"o{c}") for c in "xy"]), "moved")
    found = None
    while True:
        pairs = about(left, there, wide).filter("(u < 0) = (v < 0)")
        d = F.pow(F.col("vx") - F.col("ux"), F.lit(2)) + F.pow(F.col("vy") - F.col("uy"), F.lit(2))
        best = pairs.groupBy("site_id", F.col("u").alias("n")).agg(F.min(F.struct(F.round(d, 3).alias("d"), (F.col("nth") != F.col("among")).alias("other"), F.col("v").alias("to"))).alias("b"))
        reach = F.col("side") * wide
        # All of b lies in the cells about a node that is no farther off its frame than a cell is wide, once that is as wide as b.
        all_of_it = reach > F.col("span") + F.greatest("ox", "oy")
        near = left.join(best, ["site_id", "n"], "left").withColumn("done", all_of_it | (F.sqrt(F.col("b.d")) + 0.05 < reach))
        near = work_table(near.select(*left.columns, "b", F.coalesce("done", F.lit(False)).alias("done")), "nearest")
        got = near.filter("done AND b IS NOT NULL").select("site_id", "n", F.col("b.to").alias("to"))
        found = got if found is None else found.unionByName(got)
        left = near.filter("NOT done").select(*left.columns)
        if left.isEmpty():
            return found
        wide *= 4


FEW_CABLES = 1000


def assign_cables(edges: DataFrame, cables: DataFrame, load: str = "load") -> DataFrame:
    """The cable of the least capacity that bears each edge's load, and the cost by its length; null beyond all.

    cables: cable, capacity, cost. A catalogue of up to `FEW_CABLES` rows is broadcast.
    """
    few = cables.limit(FEW_CABLES + 1).count() <= FEW_CABLES
    # Each load's cable is found once: edges share their loads.
    loads = edges.select(F.col(load).alias("_load")).distinct()
    j = loads.join(F.broadcast(cables) if few else cables, F.col("capacity") >= F.col("_load"))
    best = j.groupBy("_load").agg(F.min(F.struct("capacity", "cable", "cost")).alias("_best"))
    out = edges.join(best, F.col(load) == F.col("_load"), "left")
    return out.select(*[F.col(c) for c in edges.columns], F.col("_best.cable").alias("cable"), (F.col("length") * F.col("_best.cost")).alias("cost"))


def length_matrix(v: DataFrame, edges: DataFrame, depot: int = -1) -> DataFrame:
    """For routing from one depot: i, j, length in thousandths; the way back is free, a missing edge has none."""
    nodes = work_table(v.filter((F.col("n") >= 0) | (F.col("n") == depot)).select("site_id", "n", "x", "y"), "nodes")
    # Each node carries its neighbours, which are few, so that pairs are not sent on.
    both = edges.select("site_id", F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select("site_id", F.col("v").alias("n"), F.col("u").alias("m")))
    near = both.groupBy("site_id", "n").agg(F.collect_set("m").alias("near"))
    first = nodes.join(near, ["site_id", "n"], "left").select(*nodes.columns, F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    j = _pairs(first, nodes).filter("u <> v")
    there = F.array_contains("near", F.col("v")) | (F.col("u") == depot)
    length = F.when(F.col("v") == depot, 0).when(there, F.round(F.sqrt(G.d2(G.point("u"), G.point("v")).cast("double")) * 1000).cast("long"))
    return j.select("site_id", F.col("u").alias("i"), F.col("v").alias("j"), length.alias("length"))

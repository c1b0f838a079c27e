"""Forests of cables: a row for each terminal with the node that it feeds (parent), and what flows through it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.store import work_table
from . import rounds
from .joins import about, assign_cables, assign_root, crossings, gridded, interferences, with_points

LOADS = "site_id long, n long, root long, parent long, load long, subtree long, depth long"


def seed_forest(v: DataFrame) -> DataFrame:
    """site_id, n, root, parent, l2: each terminal feeds the nearest node strictly closer to its root, ties by id.

    Candidates come from the cells about a terminal, wider ones in each round. The root bounds the search: a terminal is done
    once its cells reach as far as the best candidate, the root among them.
    """
    own = assign_root(v).select("site_id", "n", "root", F.col("d2").alias("rd"))
    t = v.filter("n >= 0").select("site_id", "n", "x", "y").join(own, ["site_id", "n"])
    at, wide = gridded(t, 8.0)
    # The root is the first candidate, at the terminal's own distance to it.
    left, found = at.withColumn("best", F.struct(F.col("rd").alias("l2"), F.col("root").alias("parent"))), None
    while True:
        other = at.select("site_id", "root", "n", "x", "y", F.col("rd").alias("pd"), "x0", "y0", "side").withColumnRenamed("root", "of")
        near = about(left.select("site_id", "n", "x", "y", "root", "rd", "x0", "y0", "side"), other, wide).filter("of = root AND pd < rd")
        near = near.groupBy("site_id", F.col("u").alias("n")).agg(F.min(F.struct(G.d2(G.point("u"), G.point("v")).alias("l2"), F.col("v").alias("parent"))).alias("near"))
        j = left.join(near, ["site_id", "n"], "left").withColumn("best", F.least("best", "near")).drop("near")
        reach = F.pow(F.col("side") * wide, F.lit(2.0))
        got = work_table(j.withColumn("done", (F.col("best.l2") <= reach) | (F.col("side") * wide > F.col("span"))), "nearest")
        done = got.filter("done").select("site_id", "n", "root", "best.parent", "best.l2")
        found = done if found is None else found.unionByName(done)
        left = got.filter("NOT done").drop("done")
        if left.isEmpty():
            return found
        wide *= 4


def loads_of(parent: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """node -> (load, subtree's gate node, depth) of a parent map whose roots are negative."""
    depth, top = {}, {}
    for n in parent:
        path = []
        m = n
        while m >= 0 and m not in depth:
            path.append(m)
            if len(path) > len(parent):
                raise ValueError("the parents form a cycle")
            m = parent[m]
        for k in reversed(path):
            p = parent[k]
            depth[k], top[k] = (1, k) if p < 0 else (depth[p] + 1, top[p])
    load = dict.fromkeys(parent, 1)
    for n in sorted(parent, key=lambda k: -depth[k]):
        if parent[n] >= 0:
            load[parent[n]] += load[n]
    return {n: (load[n], top[n], depth[n]) for n in parent}


#: Sites with more terminals go by rounds of joins; others are walked in a task, many a task.
WHOLE = 4096


def _parted(forest: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The forest of sites of up to `WHOLE` terminals, and of larger ones if there are any. Written, as it is read more than once."""
    f = work_table(forest.select(*columns), "forest")
    large = f.groupBy("site_id").count().filter(F.col("count") > WHOLE).select("site_id")
    if large.isEmpty():
        return f, None
    return f.join(large, "site_id", "left_anti"), f.join(large, "site_id", "left_semi")


def tree_loads(forest: DataFrame) -> DataFrame:
    """Each terminal's load (terminals fed through it), subtree (the gate's terminal) and depth."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = dict(zip(pdf["n"].tolist(), pdf["parent"].tolist(), strict=True))
        got = loads_of(parent)
        rows = [got[n] for n in pdf["n"].tolist()]
        return pdf[["site_id", "n", "root", "parent"]].assign(load=[r[0] for r in rows], subtree=[r[1] for r in rows], depth=[r[2] for r in rows])

    few, large = _parted(forest, ["site_id", "n", "root", "parent"])
    out = few.groupBy("site_id").applyInPandas(run, LOADS)
    if large is None:
        return out
    up = rounds.ancestors(large).select("site_id", "n", "load", F.col("top").alias("subtree"), "depth")
    return out.unionByName(large.join(up, ["site_id", "n"]).select("site_id", "n", "root", "parent", "load", "subtree", "depth"))


def gates_per_root(forest: DataFrame, v: DataFrame) -> DataFrame:
    """Gates of every root, 0 included."""
    g = forest.filter("parent < 0").groupBy("site_id", F.col("parent").alias("root")).agg(F.count("*").alias("num_gates"))
    return v.filter("n < 0").select("site_id", F.col("n").alias("root")).join(g, ["site_id", "root"], "left").select("site_id", "root", F.coalesce("num_gates", F.lit(0)).cast("long").alias("num_gates"))


def degrees(forest: DataFrame) -> DataFrame:
    ends = forest.select("site_id", F.explode(F.array("n", "parent")).alias("n"))
    return ends.groupBy("site_id", "n").agg(F.count("*").alias("degree"))


def lengths(forest: DataFrame, v: DataFrame) -> DataFrame:
    """The forest with length, in thousandths of a unit, as a whole number. Lengths that it has stay."""
    j = with_points(forest.drop("l2"), v, "n", "parent")
    own = F.round(F.sqrt(G.d2(G.point("n"), G.point("parent")).cast("double")) * 1000).cast("long")
    length = F.coalesce(F.col("length").cast("long"), own) if "length" in forest.columns else own
    return j.select(*[c for c in forest.columns if c not in ("l2", "length")], length.alias("length"))


def cabled(forest: DataFrame, v: DataFrame, cables: DataFrame) -> DataFrame:
    """site_id, n, parent, load, length, cable, cost."""
    l = tree_loads(forest).select("site_id", "n", "parent", "load")
    return assign_cables(lengths(l, v), cables)


def summary(forest: DataFrame, v: DataFrame, capacity: int) -> DataFrame:
    """For each site: terminals, gates, gates beyond the least number, total length, largest load."""
    l = lengths(tree_loads(forest), v)
    return l.groupBy("site_id").agg(F.count("*").alias("terminals"), F.count_if(F.col("parent") < 0).alias("gates"), F.sum("length").alias("length"), F.max("load").alias("max_load")).select("site_id", "terminals", "gates", (F.col("gates") - F.ceil(F.col("terminals") / capacity)).alias("excess_gates"), "length", "max_load")


def validate(forest: DataFrame, v: DataFrame, capacity: int, edges: DataFrame | None = None) -> DataFrame:
    """For each site: missing terminals, terminals over capacity, crossing pairs. All 0 for a valid routeset."""
    l = tree_loads(forest)
    t = v.groupBy("site_id").agg(F.count_if(F.col("n") >= 0).alias("t"))
    have = l.groupBy("site_id").agg(F.count_distinct("n").alias("have"), F.count_if(F.col("load") > capacity).alias("overloaded"))
    e = forest.select("site_id", F.col("parent").alias("u"), F.col("n").alias("v")) if edges is None else edges
    x = crossings(e, v).groupBy("site_id").agg(F.count("*").alias("crossings"))
    return t.join(have, "site_id", "left").join(x, "site_id", "left").select("site_id", (F.col("t") - F.coalesce("have", F.lit(0))).alias("missing"), F.coalesce("overloaded", F.lit(0)).cast("long").alias("overloaded"), F.coalesce("crossings", F.lit(0)).cast("long").alias("crossings"))


def splits(passes: DataFrame, links: DataFrame, v: DataFrame) -> DataFrame:
    """Ways that part the links of a node: site_id, a, d, b, s, t.

    passes: site_id, a, d, b, a way that bends at (or goes straight over) d, coming from a and going on to b, without being joined to it. links: site_id, u, v.
    The way splits d's branch if some of d's neighbours lie inside the angle a-d-b and others outside; s and t are
    the least neighbours of either kind.
    """
    both = links.select("site_id", F.col("u").alias("d"), F.col("v").alias("m")).unionByName(links.select("site_id", F.col("v").alias("d"), F.col("u").alias("m"))).distinct()
    j = passes.select("site_id", "a", "d", "b").distinct().join(both, ["site_id", "d"])
    j = with_points(with_points(j, v, "a", "d"), v, "b", "m")
    inside, outside = G.about_corner(G.point("m"), G.point("a"), G.point("d"), G.point("b"))
    first = j.groupBy("site_id", "a", "d", "b").agg(F.min(F.when(inside, F.col("m"))).alias("s"), F.min(F.when(outside, F.col("m"))).alias("t"))
    return first.filter("s IS NOT NULL AND t IS NOT NULL")


def violations(edges: DataFrame, v: DataFrame, passes: DataFrame | None = None) -> DataFrame:
    """What is wrong with a routeset's edges (site_id, u, v), as rows (site_id, u, v, s, t).

    uv crosses st; or, with u < v or v < u as the touched edge lies, the edge uv goes over a node and parts its neighbours s and t; or, with u = v,
    a detour (of passes: site_id, a, d, b) bends at node u and parts its neighbours s and t. Parallel edges don't cross, and a
    node with one neighbour can't be parted.
    """
    met = interferences(edges, v)
    out = met.filter("touching IS NULL").select("site_id", "u", "v", "s", "t")
    # The touched edge is a straight pass over the touching end.
    over = met.filter("touching IS NOT NULL").select(
        "site_id",
        F.when(F.col("touching") < 2, F.col("s")).otherwise(F.col("u")).alias("a"),
        F.element_at(F.array("u", "v", "s", "t"), F.col("touching") + 1).alias("d"),
        F.when(F.col("touching") < 2, F.col("t")).otherwise(F.col("v")).alias("b"),
    )
    out = out.unionByName(splits(over, edges, v).select("site_id", F.col("a").alias("u"), F.col("b").alias("v"), "s", "t"))
    if passes is not None:
        out = out.unionByName(splits(passes, edges, v).select("site_id", F.col("d").alias("u"), F.col("d").alias("v"), "s", "t"))
    return out


def hooked_to_nearest(forest: DataFrame, v: DataFrame) -> DataFrame:
    """Each subtree's best hook: its node nearest to the root, ties by id."""
    l = tree_loads(forest)
    j = l.join(v.filter("n >= 0"), ["site_id", "n"]).join(v.filter("n < 0").select("site_id", F.col("n").alias("root"), F.col("x").alias("rx"), F.col("y").alias("ry")), ["site_id", "root"])
    best = F.min(F.struct(G.d2((F.col("x"), F.col("y")), G.point("r")).alias("d2"), F.col("n"))).alias("b")
    return j.groupBy("site_id", "root", "subtree").agg(best).select("site_id", "root", "subtree", F.col("b.n").alias("hook"), F.col("b.d2").alias("d2"))


def rehooked(forest: DataFrame, hooks: DataFrame) -> DataFrame:
    """The forest with each subtree fed from its new hook (site_id, root, subtree, hook), and loads: links between the old hook and the new one turn round."""
    f = work_table(rounds.turned(forest, hooks), "turned")
    return tree_loads(f).select("site_id", "n", "root", "parent", "load")


def hooked_to_head(forest: DataFrame, v: DataFrame) -> DataFrame:
    """As hooked_to_nearest, for subtrees that are paths, whose ends alone may be hooks."""
    l = tree_loads(forest)
    d = degrees(forest)
    inner = l.join(d, ["site_id", "n"])
    branched = inner.filter("degree > 2").select("site_id", "subtree").distinct()
    ends = inner.filter("degree = 1 OR n = subtree").join(branched, ["site_id", "subtree"], "left_anti")
    r = v.filter("n < 0").select("site_id", F.col("n").alias("root"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    j = ends.join(v.filter("n >= 0"), ["site_id", "n"]).join(r, ["site_id", "root"])
    best = F.min(F.struct(G.d2((F.col("x"), F.col("y")), G.point("r")).alias("d2"), F.col("n"))).alias("b")
    return j.groupBy("site_id", "root", "subtree").agg(best).select("site_id", "root", "subtree", F.col("b.n").alias("hook"), F.col("b.d2").alias("d2"))


def terse(forest: DataFrame) -> DataFrame:
    """One row for each site: the parent of each terminal in the order of terminals."""
    return forest.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "parent"))), lambda s: s["parent"]).alias("edges"))


def unterse(packed: DataFrame) -> DataFrame:
    return packed.select("site_id", F.posexplode("edges").alias("n", "parent")).select("site_id", F.col("n").cast("long").alias("n"), "parent")


def edge_table(forest: DataFrame, v: DataFrame, cables: DataFrame, roots: int = 2) -> DataFrame:
    """Edges with ids from 1, roots first: u, v, length, load, cable, cost."""
    number = lambda c: F.when(F.col(c) >= 0, F.col(c) + roots + 1).otherwise(-F.col(c))
    return cabled(forest, v, cables).select("site_id", number("n").alias("u"), number("parent").alias("v"), "length", "load", "cable", "cost")


def from_edge_table(table: DataFrame, roots: int = 2) -> DataFrame:
    back = lambda c: F.when(F.col(c) > roots, F.col(c) - roots - 1).otherwise(-F.col(c))
    return table.select("site_id", back("u").alias("n"), back("v").alias("parent"), "load")


def path_lengths(forest: DataFrame, v: DataFrame) -> DataFrame:
    """Of each terminal that feeds from no other: the summed length of the way to its root."""
    few, large = _parted(lengths(forest.select("site_id", "n", "parent"), v), ["site_id", "n", "parent", "length"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = dict(zip(pdf["n"].tolist(), pdf["parent"].tolist(), strict=True))
        length = dict(zip(pdf["n"].tolist(), pdf["length"].tolist(), strict=True))
        out = []
        for n in sorted(set(parent) - set(parent.values())):
            m, total, hops = n, 0, 0
            while m >= 0:
                total, m, hops = total + length[m], parent[m], hops + 1
            out.append((pdf["site_id"].iloc[0], n, m, hops, total))
        return pd.DataFrame(out, columns=["site_id", "leaf", "root", "hops", "length"])

    out = few.groupBy("site_id").applyInPandas(run, "site_id long, leaf long, root long, hops long, length long")
    if large is None:
        return out
    leaf = rounds.ancestors(large, "length").join(large.select("site_id", F.col("parent").alias("n")), ["site_id", "n"], "left_anti")
    return out.unionByName(leaf.select("site_id", F.col("n").alias("leaf"), "root", F.col("depth").alias("hops"), F.col("way").alias("length")))


def paths(forest: DataFrame) -> DataFrame:
    """The way of each terminal that nothing feeds from to its root: site_id, path (the terminal), seq, n. One call for each site."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = dict(zip(pdf["n"].tolist(), pdf["parent"].tolist(), strict=True))
        out = []
        for leaf in sorted(set(parent) - set(parent.values())):
            n, seq = leaf, 0
            while n is not None:
                out.append((pdf["site_id"].iloc[0], leaf, seq, n))
                n, seq = parent.get(n), seq + 1
        return pd.DataFrame(out, columns=["site_id", "path", "seq", "n"])

    return forest.select("site_id", "n", "parent").groupBy("site_id").applyInPandas(run, "site_id long, path long, seq long, n long")


def route_positions(forest: DataFrame) -> DataFrame:
    """For subtrees: a terminal's place by depth, and how many of its subtree lie at its depth or beyond."""
    l = tree_loads(forest)
    w = Window.partitionBy("site_id", "subtree").orderBy("depth", "n")
    whole = Window.partitionBy("site_id", "subtree")
    return l.select("site_id", "subtree", "n", F.row_number().over(w).cast("long").alias("place"), (F.count("*").over(whole) - F.row_number().over(w) + 1).alias("countdown"))


def kind_counts(edges: DataFrame, available: DataFrame) -> DataFrame:
    """How many edges of each kind a topology uses; gates and edges that are not available (rogue) apart."""
    a = available.select("site_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "kind")
    e = edges.select("site_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    j = e.join(a, ["site_id", "a", "b"], "left").withColumn("kind", F.when(F.col("a") < 0, "gate").otherwise(F.coalesce("kind", F.lit("rogue"))))
    return j.groupBy("site_id", "kind").agg(F.count("*").alias("edges"))


def from_matrix(rows: DataFrame, terminals: DataFrame, roots: int = 2) -> DataFrame:
    """Import of 1-based rows (site_id, u, v, load) whose roots come last: terminals 1 to T, roots T + 1 to T + R.

    terminals: site_id, T. Loads are held against those of the tree; a row that differs fails the query.
    """
    back = lambda c: F.when(F.col(c) <= F.col("T"), F.col(c) - 1).otherwise(F.col(c) - F.col("T") - 1 - roots)
    given = rows.join(terminals, "site_id").select("site_id", back("u").alias("n"), back("v").alias("parent"), F.col("load").alias("given"))
    loads = tree_loads(given.withColumn("root", F.lit(0).cast("long"))).select("site_id", "n", "load")
    j = given.join(loads, ["site_id", "n"])
    same = F.when(F.col("load") == F.col("given"), F.col("load")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("load differs at"), "site_id", "n")).cast("long"))
    return j.select("site_id", "n", "parent", same.alias("load"))

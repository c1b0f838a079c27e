"""Forests and ways over a site's graph in rounds of joins, for sites of any size.

Each round is a written table, so that a plan stays as long as one round and lost executors repeat no
more than that. All rounds serve all sites at once; a site that is done leaves no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import work_table


def _min_by(order: list[str], *more: str) -> Column:
    return F.min(F.struct(*order, *more)).alias("b")


def _compressed(links: DataFrame) -> DataFrame:
    """site_id, p, to: where following (site_id, p, to) from each p ends. Ends point to themselves; each table doubles the pointers three times."""
    now = links.select("site_id", "p", "to")
    while True:
        for _ in range(3):
            now = now.join(now.select("site_id", F.col("p").alias("to"), F.col("to").alias("on")), ["site_id", "to"]).select("site_id", "p", F.col("on").alias("to"))
        now = work_table(now, "labels")
        if now.join(now.select("site_id", F.col("p").alias("to"), F.col("to").alias("on")), ["site_id", "to"]).filter("on <> to").isEmpty():
            return now


def spanning_forest(edges: DataFrame) -> DataFrame:
    """site_id, u, v, l2 of the least forest in which each tree has one root (n < 0), by Boruvka's rounds; ties go by u, then v.

    edges: site_id, u < v, l2. Every component takes its least edge to another one, and what is joined is one
    component in the next round, whose edges between two components are one each. A site's roots count as one
    component from the start, so that no way joins two of them.
    """
    e = edges.select("site_id", F.greatest("u", F.lit(-1)).alias("p"), F.greatest("v", F.lit(-1)).alias("q"), "l2", "u", "v").filter("p <> q")
    e, out = work_table(e, "edges"), None
    while True:
        both = e.unionByName(e.select("site_id", F.col("q").alias("p"), F.col("p").alias("q"), "l2", "u", "v"))
        least = work_table(both.groupBy("site_id", "p").agg(_min_by(["l2", "u", "v"], "q")).select("site_id", "p", "b.*"), "least")
        taken = least.select("site_id", "u", "v", "l2")
        out = taken if out is None else out.unionByName(taken)
        # Two components that took the same edge point at each other: the lesser one ends the chain.
        back = least.select("site_id", F.col("p").alias("q"), F.col("q").alias("back"))
        ends = (F.col("back") == F.col("p")) & (F.col("p") < F.col("q"))
        labels = _compressed(least.join(back, ["site_id", "q"]).select("site_id", "p", F.when(ends, F.col("p")).otherwise(F.col("q")).alias("to")))
        for c in "pq":
            e = e.join(labels.select("site_id", F.col("p").alias(c), F.col("to").alias(f"{c}to")), ["site_id", c])
        e = e.filter("pto <> qto").groupBy("site_id", F.least("pto", "qto").alias("p"), F.greatest("pto", "qto").alias("q")).agg(_min_by(["l2", "u", "v"])).select("site_id", "p", "q", "b.*")
        e = work_table(e, "edges")
        if e.isEmpty():
            return out.distinct()


def ancestors(forest: DataFrame, weight: str | None = None) -> DataFrame:
    """site_id, n, root, top, depth, load, way: of each terminal the node that its parents lead to, the last terminal before that, the hops, the
    terminals that feed through it (itself included), and the sum of `weight` along the hops. Parents that form a cycle are an error.

    forest: site_id, n, parent. Pointers double in each round; a terminal's load gains those of the terminals whose pointer, 2^k hops long, is at it.
    """
    way = F.col(weight).cast("double" if weight and forest.schema[weight].dataType.typeName() == "double" else "long") if weight else F.lit(0).cast("long")
    s = forest.select("site_id", "n", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("load"), F.when(F.col("parent") < 0, F.col("n")).alias("top"), way.alias("way"))
    s = work_table(s, "pointers")
    most = None
    k = 0
    while True:
        on = s.filter("up >= 0")
        if on.isEmpty():
            return s.select("site_id", "n", F.col("up").alias("root"), "top", "depth", "load", "way")
        # Without a cycle, no way has more hops than its site has terminals.
        most = most or s.groupBy("site_id").count().agg(F.max("count")).first()[0]
        if 1 << k > 2 * most:
            raise ValueError("the parents form a cycle")
        gain = on.groupBy("site_id", F.col("up").alias("n")).agg(F.sum("load").alias("gain"))
        ahead = s.select("site_id", F.col("n").alias("up"), *[F.col(c).alias(f"a_{c}") for c in ("up", "depth", "top", "way")])
        j = s.join(gain, ["site_id", "n"], "left").join(ahead, ["site_id", "up"], "left")
        # A parent that has no row ends the way, as a root does.
        further = F.when(F.col("up") >= 0, F.coalesce("a_up", F.lit(-1).cast("long"))).otherwise(F.col("up"))
        s = j.select("site_id", "n", further.alias("up"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"), (F.col("load") + F.coalesce("gain", F.lit(0))).alias("load"), F.coalesce("top", "a_top").alias("top"), (F.col("way") + F.coalesce("a_way", F.lit(0))).alias("way"))
        s = work_table(s, "pointers")
        k += 1


def turned(forest: DataFrame, hooks: DataFrame) -> DataFrame:
    """site_id, n, root, parent of the forest once each hook (site_id, hook) feeds its root: links from the hook up to the old gate turn round."""
    f = forest.select("site_id", "n", "root", "parent")
    up = work_table(f.select("site_id", "n", F.col("parent").alias("up")).filter("up >= 0"), "pointers")
    on = work_table(hooks.select("site_id", F.col("hook").alias("n")).distinct(), "turned")
    while not up.isEmpty():
        on = work_table(on.unionByName(on.join(up, ["site_id", "n"]).select("site_id", F.col("up").alias("n"))).distinct(), "turned")
        up = work_table(up.join(up.select("site_id", F.col("n").alias("up"), F.col("up").alias("on")), ["site_id", "up"]).select("site_id", "n", F.col("on").alias("up")), "pointers")
    # On a hook's way, the parent is now the child that lies on it.
    child = f.join(on, ["site_id", "n"]).filter("parent >= 0").select("site_id", F.col("parent").alias("n"), F.col("n").alias("child"))
    hook = hooks.select("site_id", F.col("hook").alias("n"), F.lit(True).alias("hooked")).distinct()
    j = f.join(child, ["site_id", "n"], "left").join(hook, ["site_id", "n"], "left")
    return j.select("site_id", "n", "root", F.when(F.col("hooked"), F.col("root")).otherwise(F.coalesce("child", "parent")).alias("parent"))


#: Width of a bucket of ways, in mean lengths of a site's sides; and how often a round goes on from what it found.
BUCKET, STEPS = 6.0, 3


def ways_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """site_id, root, n, way: length of the shortest way from each source (site_id, root) to every node that it reaches.

    edges: site_id, u, v, w, either way. Sources may have columns n and way: nodes that a source's ways begin at, that long
    already. By delta stepping: the open nodes of each source's least bucket are
    expanded, what becomes nearer is open again, until nothing is.
    """
    both = edges.select("site_id", "u", "v", "w").unionByName(edges.select("site_id", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    both = work_table(both, "sides")
    # Dealt and sorted once for all rounds; broadcast, the sides would pass the driver in each of them.
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = both.withColumnRenamed("u", "n").repartition(tasks, "site_id", "n").sortWithinPartitions("site_id", "n").persist()
    wide = both.groupBy("site_id").agg((F.avg("w") * BUCKET).alias("wide"))
    start = sources if "way" in sources.columns else sources.select("site_id", "root", F.col("root").alias("n"), F.lit(0.0).alias("way"))
    d = work_table(start.select("site_id", "root", "n", "way", F.lit(True).alias("open")), "ways")
    key = ["site_id", "root", "n"]
    while True:
        low = d.filter("open").groupBy("site_id", "root").agg(F.min("way").alias("low")).join(wide, "site_id", "left").fillna(0.0, ["wide"])
        d = d.join(low, ["site_id", "root"], "left").withColumn("now", F.col("open") & (F.col("way") <= F.col("low") + F.col("wide")))
        step, found = d.filter("now").select(*key, "way"), None
        for _ in range(STEPS):
            step = step.join(near.hint("merge"), ["site_id", "n"]).groupBy("site_id", "root", F.col("v").alias("n")).agg(F.min(F.col("way") + F.col("w")).alias("way"))
            found = step if found is None else found.unionByName(step)
        old = d.select(*key, "way", (F.col("open") & ~F.coalesce("now", F.lit(False))).alias("open"), F.lit(0).alias("new"))
        all_ = old.unionByName(found.select(*key, "way", F.lit(True).alias("open"), F.lit(1).alias("new")))
        # The nearest counts; of equals what was there before, which is no longer open.
        d = all_.groupBy(*key).agg(F.min(F.struct("way", "new", "open")).alias("b")).select(*key, "b.way", "b.open")
        d = work_table(d, "ways")
        if d.filter("open").isEmpty():
            near.unpersist()
            return d.select("site_id", "root", "n", "way")

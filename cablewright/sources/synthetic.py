"""Made-up sites."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def toy(spark: SparkSession) -> DataFrame:
    """Twelve terminals in three staggered rows about one root, as site 0."""
    i = F.col("id")
    return spark.range(12).select(F.lit(0).cast("long").alias("site_id"), i.alias("n"), (i % 4 * 900 + F.floor(i / 4) % 2 * 300).cast("long").alias("x"), (F.floor(i / 4) * 800).cast("long").alias("y")).unionByName(spark.range(1).select(F.lit(0).cast("long").alias("site_id"), F.lit(-1).cast("long").alias("n"), F.lit(1500).cast("long").alias("x"), F.lit(-700).cast("long").alias("y")))


def lattice(spark: SparkSession, radius: int, spacing: int) -> DataFrame:
    """Points of a triangular lattice within a radius of its origin: i, j, x2 (twice x), y3 (y over half the root of 3)."""
    k = radius * 2 // spacing + 1
    a = spark.range(-k, k + 1).select(F.col("id").alias("i"))
    b = spark.range(-k, k + 1).select(F.col("id").alias("j"))
    # (2k + 1) squared points, by parameters alone.
    p = a.crossJoin(b).select("i", "j", (spacing * (2 * F.col("i") + F.col("j"))).alias("x2"), (spacing * F.col("j")).alias("y3"))
    return p.filter(F.col("x2") * F.col("x2") + 3 * F.col("y3") * F.col("y3") <= 4 * radius * radius)


def terminal_count(u: Column, least: int, most: int, eta: float, bound: float) -> Column:
    """Inverse distribution: the terminal count at share u, where counts T have a density of 2 * sqrt(eta / pi / T) - bound.

    eta is the share of the area that circles as wide as the least distance cover, bound that
    distance's lower bound. With s the root of T, the mass up to T is 4 * c * s - bound * s**2.
    """
    c = float(np.sqrt(eta / np.pi))
    mass = lambda t: 4 * c * float(np.sqrt(t)) - bound * t
    low, high = mass(least - 0.4999999), mass(most + 0.5)
    y = F.lit(low) + u * F.lit(high - low)
    root = (F.lit(2 * c) - F.sqrt(F.lit(4 * c * c) - F.lit(bound) * y)) / F.lit(bound)
    return F.rint(root * root).cast("long")


#: Candidates of each site in the first batch of a Poisson disc; each later batch has as many as all before it.
FIRST = 1024


def candidates(borders: DataFrame, first: int, last: int, seed: int) -> DataFrame:
    """site_id, n (first to last - 1), x, y: whole-number points in the box of each site's polygon 0, by the md5 of 'seed:site:n'."""
    box = borders.filter("poly_id = 0").groupBy("site_id").agg(*[f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))])
    c = box.withColumn("n", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last - 1).cast("long")))).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "site_id", "n")))
    at = lambda c, k: (F.col(f"{c}0") + F.conv(F.substring("h", k, 8), 16, 10).cast("long") % (F.col(f"{c}1") - F.col(f"{c}0") + 1)).alias(c)
    return c.select("site_id", "n", at("x", 1), at("y", 9))


def poisson_disc(borders: DataFrame, repellers: DataFrame, count: int, least: int, clear: int, seed: int = 1, tries: int = 200) -> DataFrame:
    """Up to `count` points in each site's polygons, no two closer than `least`, none closer than `clear` to a repeller: site_id, n (the candidate's number), x, y.

    borders: site_id, poly_id, seq, x, y; polygon 0 is the border, others are obstacles, whose edges count as theirs.
    repellers: site_id, x, y. Of `count` * `tries` candidates each is taken that no earlier taken one is too close to. In a
    batch, all candidates without an earlier open one close by are taken at once, and what is close to them goes, until none is
    open: the same points as one by one. Conflicts meet in the cells of a grid with `least` as its side.
    """
    from ..operators import polygons
    from .store import work_table

    cell = lambda c: F.floor(F.col(c) / least)
    d2 = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))

    def close(a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs of a (site_id, n, x, y) with those of b (as m, bx, by) within `least`."""
        near = a.withColumn("gx", F.explode(F.sequence(cell("x") - 1, cell("x") + 1))).withColumn("gy", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
        other = b.select("site_id", F.col("n").alias("m"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("gx"), cell("y").alias("gy"))
        return near.join(other, ["site_id", "gx", "gy"]).filter(d2 < least * least)

    taken, first, last = None, 0, min(FIRST, count * tries)
    while first < count * tries:
        c = candidates(borders, first, last, seed)
        fits = polygons.contains(c, borders).groupBy("site_id", "n").agg(F.bool_and(F.when(F.col("poly_id") == 0, F.col("inside")).otherwise(~F.col("inside"))).alias("free")).filter("free")
        c = polygons.clears(c.join(fits.select("site_id", "n"), ["site_id", "n"]), repellers, clear)
        if taken is not None:
            c = c.join(close(c, taken).select("site_id", "n").distinct(), ["site_id", "n"], "left_anti")
        open_ = work_table(c, "open")
        # Pairs in conflict, the later one as n.
        pairs = work_table(close(open_, open_).filter("m < n").select("site_id", "n", "m"), "conflicts")
        while not open_.isEmpty():
            now = work_table(open_.join(pairs.select("site_id", "n").distinct(), ["site_id", "n"], "left_anti"), "taken")
            taken = now if taken is None else taken.unionByName(now)
            gone = pairs.join(now.select("site_id", F.col("n").alias("m")), ["site_id", "m"]).select("site_id", "n").distinct()
            open_ = work_table(open_.join(gone.unionByName(now.select("site_id", "n")), ["site_id", "n"], "left_anti"), "open")
            left = open_.select("site_id", "n")
            pairs = work_table(pairs.join(left, ["site_id", "n"]).join(left.withColumnRenamed("n", "m"), ["site_id", "m"]).select("site_id", "n", "m"), "conflicts")
        # Sites that have enough take no part in further batches.
        done = taken.groupBy("site_id").count().filter(F.col("count") >= count)
        borders = borders.join(done, "site_id", "left_anti")
        first, last = last, min(2 * last, count * tries)
        if borders.isEmpty():
            break
    k = F.row_number().over(Window.partitionBy("site_id").orderBy("n"))
    return taken.withColumn("k", k).filter(F.col("k") <= count).drop("k")

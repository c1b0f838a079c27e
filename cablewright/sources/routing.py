"""Texts of external routing and optimisation programs: problems, tours and option names."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The weight of a pair without an edge.
FAR = 10**9
HEAD = "TYPE : ACVRP\nDIMENSION : %d\nCAPACITY : %d\nEDGE_WEIGHT_TYPE : EXPLICIT\nEDGE_WEIGHT_FORMAT : FULL_MATRIX\nEDGE_WEIGHT_SECTION\n"
#: Tasks that sites are dealt to.
SITES = 64
#: What solvers call the gap at which they stop, and the seconds after which they do.
OPTIONS = {"cbc": ("ratioGap", "seconds"), "highs": ("mip_rel_gap", "time_limit"), "scip": ("limits/gap", "limits/time")}


def option_names(solver: str) -> tuple[str, str]:
    return OPTIONS.get(solver, ("mipgap", "timelimit"))


def option_columns(solver: Column) -> list[Column]:
    """`option_names` as the columns gap and seconds."""
    out = []
    for k, c in enumerate(("gap", "seconds")):
        named = F.lit(option_names("")[k])
        for name, pair in OPTIONS.items():
            named = F.when(solver == name, pair[k]).otherwise(named)
        out.append(named.alias(c))
    return out


def problems(matrix: DataFrame, capacity: int) -> DataFrame:
    """A routing problem with asymmetric weights as a text for each site, the depot first. matrix: site_id, i, j, length (null without an edge)."""
    every = matrix.select("site_id", "i", "j", F.coalesce("length", F.lit(FAR)).alias("w"))
    every = every.unionByName(matrix.select("site_id", "i", F.col("i").alias("j"), F.lit(0).cast("long").alias("w")).distinct())
    joined = lambda key, value, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value].cast("string")), sep)
    lines = every.groupBy("site_id", "i").agg(joined("j", "w", " ").alias("line"))
    return lines.groupBy("site_id").agg(F.count("*").alias("k"), joined("i", "line", "\n").alias("rows")).select("site_id", F.format_string(HEAD + "%s\nEOF", "k", F.lit(capacity), "rows").alias("problem"))


def problem_digests(v: DataFrame, edges: DataFrame, capacity: int, depot: int = -1) -> DataFrame:
    """site_id, digest: the sha256 of each site's text by `problems` over the matrix of these edges, without the matrix.

    A line is `FAR` but for few numbers. Those go in order to one task a site, which puts the lines together one after another.
    """
    place = F.row_number().over(Window.partitionBy("site_id").orderBy("n")) - 1
    nodes = v.filter((F.col("n") >= 0) | (F.col("n") == depot)).select("site_id", "n", "x", "y", place.alias("p"))
    end = lambda c: nodes.select("site_id", F.col("n").alias(c), *[F.col(k).alias(f"{c}{k}") for k in "xyp"])
    both = edges.select("site_id", "u", "v").unionByName(edges.select("site_id", F.col("v").alias("u"), F.col("u").alias("v"))).distinct().filter(F.col("u") != depot)
    # From the depot all others are reached, and back costs nothing.
    first = nodes.filter(F.col("n") == depot).select("site_id", F.col("n").alias("u")).join(nodes.filter(F.col("n") != depot).select("site_id", F.col("n").alias("v")), "site_id")
    met = both.filter(F.col("v") != depot).unionByName(first).join(end("u"), ["site_id", "u"]).join(end("v"), ["site_id", "v"])
    length = F.round(F.sqrt(((F.col("ux") - F.col("vx")) * (F.col("ux") - F.col("vx")) + (F.col("uy") - F.col("vy")) * (F.col("uy") - F.col("vy"))).cast("double")) * 1000).cast("long")
    zero = F.lit(0).cast("long").alias("w")
    back = nodes.filter(F.col("n") != depot).join(nodes.filter(F.col("n") == depot).select("site_id", F.col("p").alias("q")), "site_id").select("site_id", "p", "q", zero)
    rows = met.select("site_id", F.col("up").alias("p"), F.col("vp").alias("q"), length.alias("w")).unionByName(nodes.select("site_id", "p", F.col("p").alias("q"), zero)).unionByName(back)
    rows = rows.join(nodes.groupBy("site_id").agg(F.count("*").alias("k")), "site_id")

    def run(parts):
        far, at, digest = f"{FAR} ".encode(), None, None
        line, q = [], 0

        def end_line(k: int) -> None:
            line.append(far * (k - q))
            digest.update(b"".join(line)[:-1] + b"\n")

        def whole():
            end_line(at[2])
            digest.update(b"EOF")
            return pd.DataFrame([(at[0], digest.hexdigest())], columns=["site_id", "digest"])

        for part in parts:
            for site, i, j, w, k in part[["site_id", "p", "q", "w", "k"]].itertuples(index=False):
                if at is None or site != at[0]:
                    if at is not None:
                        yield whole()
                    digest = hashlib.sha256((HEAD % (k, capacity)).encode())
                    line, q = [], 0
                elif i != at[1]:
                    end_line(k)
                    line, q = [], 0
                line += [far * (j - q), b"%d " % w]
                at, q = (site, i, k), j + 1
        if at is not None:
            yield whole()

    return rows.repartition(SITES, "site_id").sortWithinPartitions("site_id", "p", "q").mapInPandas(run, "site_id long, digest string")


def tours(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The routes of tour texts (site_id, tour): site_id, route, seq, n. sizes: site_id, terminals.

    Node 1 is the depot, the terminals follow; numbers beyond them are more copies of the depot, each of
    which ends a route.
    """
    section = F.regexp_extract("tour", r"TOUR_SECTION\s+([\d\s]+)", 1)
    nodes = F.transform(F.filter(F.split(section, r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    d = texts.join(sizes, "site_id").withColumn("nodes", nodes)
    # The tour is turned so that it begins at the depot.
    at = F.array_position("nodes", F.lit(1)).cast("int")
    turned = F.concat(F.slice("nodes", at, F.size("nodes")), F.slice("nodes", F.lit(1), at - 1))
    depot = lambda x: (x == 1) | (x > F.col("terminals") + 1)
    d = d.select("site_id", "terminals", F.posexplode(turned).alias("place", "node"))
    # A depot's place counts for all nodes up to the next one.
    so_far = Window.partitionBy("site_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(depot(F.col("node")), F.col("place"))
    d = d.withColumn("trip", F.count(at).over(so_far)).withColumn("since", F.col("place") - F.max(at).over(so_far)).filter(~depot(F.col("node")))
    # Depots that stand side by side make no route.
    return d.select("site_id", (F.dense_rank().over(Window.partitionBy("site_id").orderBy("trip")) - 1).alias("route"), (F.col("since") - 1).alias("seq"), (F.col("node") - 2).alias("n"))

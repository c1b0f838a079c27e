"""Sets of edges: differences, common neighbours, unions, and routesets expanded and contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["site_id", "u", "v"]


def oriented(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """site_id, u < v, each once."""
    return edges.select("site_id", F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return oriented(a).join(oriented(b), KEY, "left_anti")


def present(a: DataFrame, b: DataFrame) -> DataFrame:
    return oriented(a).join(oriented(b), KEY, "left_semi")


def union(*parts: DataFrame) -> DataFrame:
    """Edges of several sources, with the number of those that hold each."""
    out = None
    for k, p in enumerate(parts):
        p = oriented(p).withColumn("source", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(*KEY).agg(F.count_distinct("source").alias("sources"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """For each edge, the nodes joined to both ends."""
    e = oriented(edges)
    both = e.select("site_id", F.col("u").alias("a"), F.col("v").alias("b")).unionByName(e.select("site_id", F.col("v").alias("a"), F.col("u").alias("b")))
    x = both.select("site_id", F.col("a").alias("u"), F.col("b").alias("w"))
    y = both.select("site_id", F.col("a").alias("v"), F.col("b").alias("w"))
    return e.join(x, ["site_id", "u"]).join(y, ["site_id", "v", "w"]).select("site_id", "u", "v", "w")


def overlay(routes: DataFrame, mesh: DataFrame) -> DataFrame:
    """Routes merged with a mesh for display: a route's kind stands before the mesh's."""
    r = routes.select(*KEY, F.col("kind").alias("rk"))
    return r.join(mesh.select(*KEY, F.col("kind").alias("mk")), KEY, "full_outer").select(*KEY, F.coalesce("rk", "mk").alias("kind"))


def expand(topology: DataFrame, available: DataFrame, first: int) -> DataFrame:
    """Edges of a topology as hops: an edge with a midpath goes by clones of its points, numbered from `first` on.

    topology: site_id, u, v; available: site_id, u < v, midpath (ARRAY, in the direction from u to v).
    Returns site_id, u, v, prime_u, prime_v, edge_u, edge_v.
    """
    e = topology.select("site_id", F.least("u", "v").alias("edge_u"), F.greatest("u", "v").alias("edge_v"))
    a = available.select("site_id", F.col("u").alias("edge_u"), F.col("v").alias("edge_v"), "midpath")
    j = e.join(a, ["site_id", "edge_u", "edge_v"], "left").withColumn("midpath", F.coalesce("midpath", F.array().cast("array<bigint>")))
    before = F.coalesce(F.sum(F.size("midpath")).over(Window.partitionBy("site_id").orderBy("edge_u", "edge_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = j.withColumn("base", before + first)
    clones = F.transform("midpath", lambda _, i: F.col("base") + i)
    j = j.withColumn("nodes", F.concat(F.array("edge_u"), clones, F.array("edge_v"))).withColumn("primes", F.concat(F.array("edge_u"), "midpath", F.array("edge_v")))
    hops = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.get("nodes", i).alias("u"), F.get("nodes", i + 1).alias("v"), F.get("primes", i).alias("prime_u"), F.get("primes", i + 1).alias("prime_v")))
    return j.select("site_id", "edge_u", "edge_v", F.explode(hops).alias("h")).select("site_id", "h.*", "edge_u", "edge_v")


def routeset(links: DataFrame, available: DataFrame, crossed: DataFrame) -> DataFrame:
    """Each link n - parent of a topology with its kind: of the available edges, or rogue; gate, or tentative for a gate that crosses a link.

    available: site_id, u, v, kind; crossed: site_id, n of such gates.
    """
    a = available.select("site_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "kind")
    j = links.withColumn("a", F.least("n", "parent")).withColumn("b", F.greatest("n", "parent")).join(a, ["site_id", "a", "b"], "left")
    j = j.join(crossed.select("site_id", "n", F.lit(True).alias("crossed")).distinct(), ["site_id", "n"], "left")
    gate = F.when(F.col("crossed"), "tentative").otherwise("gate")
    return j.select("site_id", "n", "parent", F.when(F.col("parent") < 0, gate).otherwise(F.coalesce("kind", F.lit("rogue"))).alias("kind"))


def triples(paths: DataFrame) -> DataFrame:
    """Neighbouring points s, b, t of paths (site_id, path, seq, n)."""
    w = Window.partitionBy("site_id", "path").orderBy("seq")
    return paths.select("site_id", "path", F.col("n").alias("s"), F.lead("n").over(w).alias("b"), F.lead("n", 2).over(w).alias("t")).filter("t IS NOT NULL")


def contract(hops: DataFrame) -> DataFrame:
    """The topology that `expand` came from."""
    return hops.select("site_id", F.col("edge_u").alias("u"), F.col("edge_v").alias("v")).distinct()


def model_rows(available: DataFrame, exclusive: DataFrame, vertices: DataFrame, capacity: int) -> DataFrame:
    """The constraints of the least-length model, a row each: site_id, family, size (variables in it), bound.

    Families: one outgoing link for each terminal; flow conserved at each terminal; at most one edge of
    each crossing pair; gates, at least the terminals over the capacity; edges and gates in all, as many
    as terminals.
    """
    t = vertices.filter("n >= 0").groupBy("site_id").agg(F.count("*").alias("t"))
    r = vertices.filter("n < 0").groupBy("site_id").agg(F.count("*").alias("r"))
    inner = oriented(available).filter("u >= 0")
    ends = inner.select("site_id", F.explode(F.array("u", "v")).alias("n")).groupBy("site_id", "n").agg(F.count("*").alias("deg"))
    own = vertices.filter("n >= 0").select("site_id", "n").join(ends, ["site_id", "n"], "left").join(r, "site_id").select("site_id", (F.coalesce("deg", F.lit(0)) + F.col("r")).alias("size"))
    row = lambda df, family, size, bound: df.select("site_id", F.lit(family).alias("family"), size.cast("long").alias("size"), bound.cast("long").alias("bound"))
    one = F.lit(1)
    edges = inner.groupBy("site_id").agg(F.count("*").alias("e"))
    total = t.join(r, "site_id").join(edges, "site_id")
    return (
        row(own, "outgoing", F.col("size"), one)
        .unionByName(row(own, "flow", F.col("size"), one))
        .unionByName(row(exclusive.filter("u >= 0 AND s >= 0"), "crossing", F.lit(2), one))
        .unionByName(row(total, "gates", F.col("t") * F.col("r"), F.ceil(F.col("t") / capacity)))
        .unionByName(row(total, "links", F.col("e") + F.col("t") * F.col("r"), F.col("t")))
    )


def topology_crossings(topology: DataFrame, exclusive: DataFrame) -> DataFrame:
    """Pairs of a topology's edges that cross, looked up among the mutually exclusive pairs: no geometry, two semi joins."""
    e = oriented(topology)
    other = e.select("site_id", F.col("u").alias("s"), F.col("v").alias("t"))
    return exclusive.join(e, KEY, "left_semi").join(other, ["site_id", "s", "t"], "left_semi").select("site_id", "u", "v", "s", "t")


def edge_crossings(edges: DataFrame, exclusive: DataFrame) -> DataFrame:
    """Of each given edge, every available edge that crosses it, found from either side of the pairs."""
    turned = exclusive.select("site_id", F.col("s").alias("u"), F.col("t").alias("v"), F.col("u").alias("s"), F.col("v").alias("t"))
    both = exclusive.select("site_id", "u", "v", "s", "t").unionByName(turned)
    return both.join(oriented(edges), KEY, "left_semi").select("site_id", "u", "v", "s", "t")

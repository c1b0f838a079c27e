"""Routes, loads and cable costs of every site at several capacities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import solvers, trees
from ..operators.joins import assign_cables
from ..sources.fixtures import vertices

CABLES = ((0, 3, 206), (1, 5, 287), (2, 200, 406))


def cables(spark: SparkSession) -> DataFrame:
    """cable, capacity, cost in ascending capacity."""
    return spark.createDataFrame(list(CABLES), "cable long, capacity long, cost long")


def route_costs(spark: SparkSession, sf_dir: str, capacities=(5, 8), method: str = "presolver") -> DataFrame:
    """site_id, capacity, terminals, gates, length, cost."""
    v = vertices(spark, sf_dir)
    s = solvers.solve(v, [method], list(capacities))
    # An instance is a site of its own to the tree operators.
    code = F.col("site_id") * 1000 + F.col("capacity")
    forest = s.select(code.alias("site_id"), "n", "parent", F.lit(0).cast("long").alias("root"))
    grid = s.select(F.col("site_id").alias("from"), code.alias("site_id")).distinct()
    points = v.withColumnRenamed("site_id", "from").join(grid, "from").select("site_id", "n", "x", "y")
    loads = trees.tree_loads(forest).select("site_id", "n", "parent", "load")
    priced = assign_cables(trees.lengths(loads, points), cables(spark))
    return priced.groupBy("site_id").agg(F.count("*").alias("terminals"), F.count_if(F.col("parent") < 0).alias("gates"), F.sum("length").alias("length"), F.sum("cost").alias("cost")).select(F.floor(F.col("site_id") / 1000).alias("site_id"), (F.col("site_id") % 1000).alias("capacity"), "terminals", "gates", "length", "cost")

"""A heuristic's log of added and removed edges, folded to the edges that stand at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "instance_id long, iteration long, op string, u long, v long"


def star_log(forest: DataFrame) -> DataFrame:
    """The log of building a forest from a star: all gates first, then each gate that gives way to a link."""
    gate = forest.select(F.col("site_id").alias("instance_id"), F.lit(0).cast("long").alias("iteration"), F.lit("addE").alias("op"), F.col("root").alias("u"), F.col("n").alias("v"))
    inner = forest.filter("parent >= 0")
    step = (F.col("n") + 1).cast("long")
    gone = inner.select(F.col("site_id").alias("instance_id"), step.alias("iteration"), F.lit("remE").alias("op"), F.col("root").alias("u"), F.col("n").alias("v"))
    new = inner.select(F.col("site_id").alias("instance_id"), step.alias("iteration"), F.lit("addE").alias("op"), F.col("parent").alias("u"), F.col("n").alias("v"))
    return gate.unionByName(gone).unionByName(new)


def replay(events: DataFrame) -> DataFrame:
    """Edges whose last event is an addition; on a stream, run it with the complete output mode."""
    last = events.groupBy("instance_id", "u", "v").agg(F.max_by("op", "iteration").alias("op"))
    return last.filter("op = 'addE'").select("instance_id", "u", "v")


def replay_stream(spark, path: str, schema: str = EVENT):
    """The replay of a folder to which Parquet files of events are added. Its state is one row for each edge ever seen."""
    return replay(spark.readStream.schema(schema).parquet(path))

"""Sites made from the driver's `embeddings` table, with whole-number coordinates.

A label is a site; its two least vec_ids are the roots -1 and -2, the others terminals from 0 on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALE, ROOTS = 10_000, 2


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, n, x, y."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id", *[F.round(F.get("embedding", F.lit(k)).cast("double") * SCALE).cast("long").alias(c) for k, c in enumerate("xy")])
    rn = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return e.withColumn("rn", rn).select(F.col("label").cast("long").alias("site_id"), F.when(F.col("rn") <= ROOTS, -F.col("rn")).otherwise(F.col("rn") - ROOTS - 1).cast("long").alias("n"), "x", "y")


def instance(positions: DataFrame) -> DataFrame:
    """Canonical vertices from positions (site_id, x, y, is_root): terminals from 0 and roots from -1 down, by x and then y."""
    rn = F.row_number().over(Window.partitionBy("site_id", "is_root").orderBy("x", "y"))
    return positions.select("site_id", F.when(F.col("is_root"), -rn).otherwise(rn - 1).cast("long").alias("n"), "x", "y")


def terminals(v: DataFrame) -> DataFrame:
    return v.filter("n >= 0")


def roots(v: DataFrame) -> DataFrame:
    return v.filter("n < 0")

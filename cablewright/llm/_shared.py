"""Session-level helpers: tables in the shared folder, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only in local mode is a temporary folder made and set where that setting is absent; elsewhere this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cablewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cablewright/{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame that `saved` returned, when nothing will read it again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch between the JVM and a Python worker, at most (a single row may be longer).
BATCH_BYTES = 4 << 20


def batched(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches are held to `BATCH_BYTES` from now on.

    Batches are else limited by rows alone, so that long texts fill the memory of both sides. A
    smaller limit that the session has is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = df.sparkSession
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(c):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u, v): a row (node, root) for each node.

    The root is the component's least node. Alternates the large-star and
    small-star steps (Kiveris et al., 2014) until nothing changes; each round
    ends in a written table. A node of any degree is met by partial minima and
    by joins that adaptive execution can split, never by collecting its
    neighbours.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        # Small stars look from each larger end at its smaller neighbours; large stars from every end at all.
        both = e if small else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = both.join(low, "u")
        if small:
            out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        else:
            out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    e = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        old, e = e, saved(star(star(e, False), True), "edges")
        discard(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    out._saved_at = e._saved_at
    return out

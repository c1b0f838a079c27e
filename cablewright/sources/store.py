"""The store: Parquet tables of node sets, methods and route sets, filled by digest.

A table is a folder with `data-` folders of rows and a log `_commits`, whose files are named by version and hold the
name of one data folder each. A version can be published once: of two writers that want the same one, the later reads what
the other wrote, leaves out what is there by now, and goes on to the next. Data that no version names don't count.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; in local mode a temporary one where that is unset, elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cablewright-")
    return f"{base.rstrip('/')}/store/{uuid.uuid4().hex}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder that driver and executors share, and read again: its lineage ends there, and lost executors cost no more than a reading."""
    path = f"{folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The store's tables.
SCHEMAS = {
    "nodesets": "site_id bigint, digest string, T bigint, R bigint",
    "methods": "digest string, solver_name string, options string",
    "machines": "name string, attributes string",
    "routesets": "site_id bigint, nodes string, method string, capacity int, edges array<bigint>, length bigint, num_gates array<bigint>, misc string",
}


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def _snapshot(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The newest version of a table, -1 without any, and its data folders."""
    fs, at = _file_system(spark, f"{path}/_commits")
    if not fs.exists(at):
        return -1, []
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().isdigit())
    folders = []
    for name in names:
        stream = fs.open(_file_system(spark, f"{path}/_commits/{name}")[1])
        folders.append(f"{path}/{bytes(stream.readAllBytes()).decode()}")
        stream.close()
    return (int(names[-1]) if names else -1), folders


def _publish(spark: SparkSession, path: str, version: int, data: str) -> bool:
    """Makes `version` name the data folder, unless there is such a version: then False. Either all of it is seen or nothing."""
    fs, log = _file_system(spark, f"{path}/_commits")
    fs.mkdirs(log)
    draft, final = (_file_system(spark, f"{path}/_commits/{name}")[1] for name in (f"draft-{uuid.uuid4().hex}", f"{version:020d}"))
    out = fs.create(draft, False)
    out.write(data.encode())
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            # Elsewhere than here, a file isn't renamed over another.
            return bool(fs.rename(draft, final))
        local = lambda at: spark._jvm.java.io.File(at.toUri().getPath()).toPath()
        try:
            spark._jvm.java.nio.file.Files.createLink(local(final), local(draft))
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True
    finally:
        fs.delete(draft, False)


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table's newest version; None if there is no version."""
    _, folders = _snapshot(spark, path)
    return spark.read.parquet(*folders) if folders else None


def _append(spark: SparkSession, rows: DataFrame, path: str, version: int) -> bool:
    data = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{data}")
    done = _publish(spark, path, version, data)
    if not done:
        _delete(spark, f"{path}/{data}")
    return done


def create(spark: SparkSession, path: str) -> None:
    """Empty tables where there are none yet."""
    for name, ddl in SCHEMAS.items():
        if _snapshot(spark, f"{path}/{name}")[0] < 0:
            _append(spark, spark.createDataFrame([], ddl), f"{path}/{name}", 0)


def machine(spark: SparkSession) -> DataFrame:
    """The machine that drives this session, as a row of `machines`."""
    import platform

    about = {"cores": spark.sparkContext.defaultParallelism, "master": spark.sparkContext.master}
    return spark.createDataFrame([(platform.node(), json.dumps(about, sort_keys=True))], SCHEMAS["machines"])


def stamped(rows: DataFrame) -> DataFrame:
    """Rows with the time of writing, in UTC, as `timestamp`, where they have none."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return rows.withColumn("timestamp", F.coalesce("timestamp", now) if "timestamp" in rows.columns else now)


def node_sets(v: DataFrame) -> DataFrame:
    """site_id, digest (of the points in order), T, R."""
    points = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x", "y"))), lambda p: F.concat_ws(":", p["n"], p["x"], p["y"])), ";")
    g = v.groupBy("site_id").agg(points.alias("points"), F.count_if(F.col("n") >= 0).alias("T"), F.count_if(F.col("n") < 0).alias("R"))
    return g.select("site_id", F.sha2("points", 256).alias("digest"), "T", "R")


def methods(rows: list[tuple[str, dict]], spark: SparkSession) -> DataFrame:
    """digest (of the name and the options in order), solver_name, options as JSON; a whole number as gates_limit is stored as 'given'."""
    plain = [(name, {k: "given" if k == "gates_limit" and type(x) is int else str(x) for k, x in options.items()}) for name, options in rows]
    return digested(spark.createDataFrame(plain, "solver_name string, o map<string,string>"))


def digested(d: DataFrame) -> DataFrame:
    """digest, solver_name, options of methods given as solver_name, o (a map of texts)."""
    d = d.withColumn("options", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("o")))))
    return d.select(F.sha2(F.concat_ws("|", "solver_name", "options"), 256).alias("digest"), "solver_name", "options")


def route_sets(forest: DataFrame, v: DataFrame, capacity: int, method: str, misc: dict[str, str] | None = None) -> DataFrame:
    """For each site: the node set's and the method's digest, capacity, the parents in order, length, gates of each root, and what else is known of it, as JSON in the order of keys."""
    from ..operators.trees import gates_per_root, lengths, terse

    total = lengths(forest.select("site_id", "n", "parent"), v).groupBy("site_id").agg(F.sum("length").alias("length"))
    gates = gates_per_root(forest, v).groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("root", "num_gates"))), lambda s: s["num_gates"]).alias("num_gates"))
    return terse(forest).join(total, "site_id").join(gates, "site_id").join(node_sets(v).select("site_id", F.col("digest").alias("nodes")), "site_id").select("site_id", "nodes", F.lit(method).alias("method"), F.lit(capacity).alias("capacity"), "edges", "length", "num_gates", F.lit(json.dumps(misc, sort_keys=True) if misc else None).cast("string").alias("misc"))


def add_absent(spark: SparkSession, new: DataFrame, path: str, key: list[str]) -> int:
    """Adds the rows whose key the table at `path` lacks, one for each key; returns how many. Writers at the same time add a key once."""
    # What is offered is computed once, however often a version is taken by another writer.
    offered = work_table(new.dropDuplicates(key), "offered")
    while True:
        version, folders = _snapshot(spark, path)
        rows = offered.join(spark.read.parquet(*folders).select(*key), key, "left_anti").select(*offered.columns) if folders else offered
        n = rows.count()
        if not n or _append(spark, rows, path, version + 1):
            return n


def load(spark: SparkSession, path: str, capacities: list[int] | None = None, method: str | None = None) -> DataFrame:
    """Stored route sets with their node sets, by capacity and method."""
    r = table(spark, f"{path}/routesets")
    if capacities is not None:
        r = r.filter(F.col("capacity").isin(capacities))
    if method is not None:
        r = r.filter(F.col("method") == method)
    n = table(spark, f"{path}/nodesets").select(F.col("digest").alias("nodes"), "T", "R")
    return r.join(n, "nodes")


def mismatched(routes: DataFrame, v: DataFrame, share: float = 1e-4) -> DataFrame:
    """Loaded route sets with the length that their parents give over the sites' points (`found`), and whether the stored one differs by more than a share of it.

    Points are taken by digest, so a route set of other points has neither.
    """
    from ..operators.trees import lengths, unterse

    own = routes.join(node_sets(v).select("digest", F.col("site_id").alias("at")), F.col("nodes") == F.col("digest"), "left").drop("digest")
    # A route set is a site of its own here, so that those of one site keep apart.
    key = F.xxhash64("nodes", "method", "capacity")
    numbered = work_table(own.withColumn("key", key), "routes")
    points = numbered.filter("at IS NOT NULL").select("key", "at").join(v.withColumnRenamed("site_id", "at"), "at").select(F.col("key").alias("site_id"), "n", "x", "y")
    hops = unterse(numbered.filter("at IS NOT NULL").select(F.col("key").alias("site_id"), "edges"))
    found = lengths(hops, points).groupBy(F.col("site_id").alias("key")).agg(F.sum("length").alias("found"))
    out = numbered.join(found, "key", "left").withColumn("differs", F.abs(F.col("length") - F.col("found")) > share * F.col("found"))
    return out.drop("key", "at")


def drawing(forest: DataFrame, v: DataFrame) -> DataFrame:
    """One SVG text for each site: lines for links, dashed ones for gates, dots for points, y upwards."""
    from ..operators.joins import with_points

    e = with_points(forest.select("site_id", "n", "parent"), v, "n", "parent")
    line = F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d"%s/>', "nx", -F.col("ny"), "parentx", -F.col("parenty"), F.when(F.col("parent") < 0, ' stroke-dasharray="40"').otherwise(""))
    lines = e.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("s")))), lambda x: x["s"]), "").alias("lines"))
    dot = F.format_string('<circle cx="%d" cy="%d" r="%d"/>', "x", -F.col("y"), F.when(F.col("n") < 0, 60).otherwise(30))
    dots = v.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", dot.alias("s")))), lambda x: x["s"]), "").alias("dots"), F.min("x").alias("x0"), (-F.max("y")).alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    return lines.join(dots, "site_id").select("site_id", F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="%d %d %d %d"><g stroke="black" stroke-width="15">%s</g>%s</svg>', "x0", "y0", "w", "h", "lines", "dots").alias("svg"))

"""Site files: YAML layouts, and nested wind-farm descriptions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .coordinates import located

SECTIONS = "handle string, format string, landscape_angle double, section string, poly_id int, text string"


def _sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for pdf in batches:
        rows = []
        for path, value in zip(pdf["path"], pdf["value"], strict=True):
            doc = yaml.safe_load(value) or {}
            handle = re.sub(r"\s+", "_", re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]).lower().replace("%20", " "))
            text = lambda v: v if isinstance(v, str) else "\n".join(" ".join(map(str, p)) for p in v or [])
            parts = [("border", 0, doc.get("EXTENTS")), ("root", -1, doc.get("SUBSTATIONS")), ("terminal", -1, doc.get("TURBINES"))]
            parts += [("obstacle", k + 1, o) for k, o in enumerate(doc.get("OBSTACLES") or [])]
            angle = doc.get("LANDSCAPE_ANGLE")
            rows += [(handle, doc.get("COORDINATE_FORMAT") or "latlon", float(angle) if angle is not None else None, s, k, text(t)) for s, k, t in parts if t]
        yield pd.DataFrame(rows, columns=["handle", "format", "landscape_angle", "section", "poly_id", "text"])


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of all YAML sites that `path` (a file, folder or glob) matches: handle, section, poly_id, seq, tag, x, y.

    Files are small; each is read whole, and Spark spreads them. Planar coordinates are taken as they
    are, others projected; a site whose points lie in more than one zone is refused.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    s = files.mapInPandas(_sections, SECTIONS)
    key = F.concat_ws("|", "handle", "section", F.col("poly_id").cast("string"))
    planar = s.filter("format = 'planar'").select(key.alias("name"), F.col("text"))
    from .coordinates import entries

    p = planar.select("name", F.posexplode(entries(F.col("text"))).alias("seq", "e")).select("name", F.col("seq").cast("long").alias("seq"), F.col("e.tag").alias("tag"), F.lit(0).cast("long").alias("zone"), F.col("e.a").cast("double").alias("x"), F.col("e.b").cast("double").alias("y"))
    g = located(s.filter("format <> 'planar'").select(key.alias("name"), "text"))
    part = F.split("name", r"\|")
    both = p.unionByName(g).select(part[0].alias("handle"), part[1].alias("section"), part[2].cast("int").alias("poly_id"), "seq", "tag", "zone", "x", "y")
    zones = both.groupBy("handle").agg(F.count_distinct("zone").alias("zones"))
    return both.join(zones, "handle").withColumn("x", F.when(F.col("zones") == 1, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("more than one UTM zone: "), F.col("handle"))).cast("double"))).drop("zone", "zones")


def write_sites(vertices: DataFrame, folder: str) -> DataFrame:
    """A YAML file with planar coordinates for each handle in `folder`; returns their paths. vertices: as `read_sites` gives them, but for tag."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.fs as pafs

        def lines(part: pd.DataFrame, indent: str) -> str:
            return "".join(f"{indent}{float(x)!r} {float(y)!r}\n" for x, y in part.sort_values("seq")[["x", "y"]].itertuples(index=False))

        name = pdf["handle"].iloc[0]
        text = "COORDINATE_FORMAT: planar\n"
        for key, section in (("EXTENTS", "border"), ("SUBSTATIONS", "root"), ("TURBINES", "terminal")):
            text += f"{key}: |\n" + lines(pdf[pdf["section"] == section], "  ")
        holes = pdf[pdf["section"] == "obstacle"].groupby("poly_id")
        text += "OBSTACLES:\n" + "".join("  - |\n" + lines(part, "    ") for _, part in holes) if len(holes) else ""
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{name}.yaml") as f:
            f.write(text.encode())
        return pd.DataFrame({"path": [f"{folder}/{name}.yaml"]})

    return vertices.groupBy("handle").applyInPandas(run, "path string")


def numbered(vertices: DataFrame, site_id: str = "handle") -> DataFrame:
    """Canonical ids: terminals from 0, then border and obstacles, roots from -R to -1 in order."""
    from pyspark.sql import Window

    group = F.when(F.col("section") == "terminal", 0).when(F.col("section") == "border", 1).when(F.col("section") == "obstacle", 2).otherwise(3)
    rn = F.row_number().over(Window.partitionBy(site_id).orderBy(group, "poly_id", "seq"))
    total = F.count("*").over(Window.partitionBy(site_id))
    return vertices.select("*", F.when(group == 3, rn - total - 1).otherwise(rn - 1).cast("long").alias("n"))


def read_windio(spark: SparkSession, site_path: str, layout_path: str) -> DataFrame:
    """Nested descriptions (site with boundaries, layout with coordinates) as section, seq, x, y."""
    import yaml

    def load(path: str):
        """The document at `path`, with what it includes read from beside it. Descriptions are small files."""

        class Loader(yaml.SafeLoader):
            pass

        Loader.add_constructor("!include", lambda loader, node: load(f"{path.rsplit('/', 1)[0]}/{loader.construct_scalar(node)}"))
        return yaml.load("".join(r.value for r in spark.read.text(path, wholetext=True).collect()), Loader)

    site, farm = load(site_path), load(layout_path)
    farm = farm.get("wind_farm", farm)
    site = site.get("site", site)
    layout = farm["layouts"]["initial_layout"]["coordinates"]
    oss = farm["electrical_substations"]["coordinates"]
    border = site["boundaries"]["polygons"][0]
    parts = [("terminal", layout), ("root", oss), ("border", border)]
    nested = spark.createDataFrame([(s, [float(v) for v in c["x"]], [float(v) for v in c["y"]]) for s, c in parts], "section string, xs array<double>, ys array<double>")
    return nested.select("section", F.posexplode(F.arrays_zip("xs", "ys")).alias("seq", "p")).select("section", "seq", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))

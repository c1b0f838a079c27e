"""Map extracts in the PBF format, as a table of elements, and sites assembled from them.

A file is a sequence of blobs. One task for each file lists where they begin, by their headers; the
blobs then spread over tasks, each of which reads and decodes its own. The format is public
(wiki.openstreetmap.org/wiki/PBF_Format); only the fields used here are decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .coordinates import utm, utm_zone

ELEMENTS = "kind string, id long, lat double, lon double, refs array<long>, tags map<string,string>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message's fields: whole numbers, or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} isn't part of the format")
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        x, at = _varint(data, at)
        out.append(x)
    return out


def signed(x: int) -> int:
    return (x >> 1) ^ -(x & 1)


def running(data: bytes) -> list[int]:
    """Packed signed differences, summed."""
    return np.cumsum([signed(x) for x in packed(data)], dtype=np.int64).tolist() if data else []


def blob(data: bytes) -> bytes:
    got = dict(fields(data))
    if 1 in got:
        return got[1]
    if 3 in got:
        return zlib.decompress(got[3])
    raise ValueError("a blob is neither raw nor compressed by zlib")


def elements(block: bytes) -> Iterator[tuple]:
    """(kind, id, lat, lon, refs, tags) of a block's nodes, ways and relations; refs of a relation are its members'."""
    texts: list[str] = []
    grain, lat0, lon0, groups = 100, 0, 0, []
    for number, value in fields(block):
        if number == 1:
            texts = [s.decode("utf-8", "replace") for _, s in fields(value)]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            grain = value
        elif number in (19, 20):
            offset = value - (1 << 64) if value >> 63 else value
            lat0, lon0 = (offset, lon0) if number == 19 else (lat0, offset)
    place = lambda a, o: ((lat0 + grain * a) * 1e-9, (lon0 + grain * o) * 1e-9)
    tags = lambda got: dict(zip((texts[k] for k in packed(got.get(2, b""))), (texts[k] for k in packed(got.get(3, b""))), strict=True))
    for group in groups:
        for number, value in fields(group):
            got = dict(fields(value))
            if number == 1:
                yield "node", signed(got[1]), *place(signed(got[8]), signed(got[9])), [], tags(got)
            elif number == 2:
                marks = iter(packed(got.get(10, b"")))
                for i, a, o in zip(running(got[1]), running(got[8]), running(got[9]), strict=True):
                    own = {}
                    while (k := next(marks, 0)):
                        own[texts[k]] = texts[next(marks)]
                    yield "node", i, *place(a, o), [], own
            elif number == 3:
                yield "way", got[1], None, None, running(got.get(8, b"")), tags(got)
            elif number == 4:
                yield "relation", got[1], None, None, running(got.get(9, b"")), tags(got)


def _blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as pafs

    for pdf in batches:
        for uri in pdf["path"]:
            fs, path = pafs.FileSystem.from_uri(uri)
            rows = []
            with fs.open_input_file(path) as f:
                at, end = 0, f.size()
                while at < end:
                    size = struct.unpack(">I", f.read_at(4, at))[0]
                    head = dict(fields(f.read_at(size, at + 4)))
                    begin = at + 4 + size
                    if head[1] == b"OSMData":
                        rows.append((uri, begin, head[3]))
                    at = begin + head[3]
            yield pd.DataFrame(rows, columns=["path", "begin", "size"])


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as pafs

    for pdf in batches:
        for uri, begin, size in pdf.itertuples(index=False):
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                block = blob(f.read_at(size, begin))
            rows = list(elements(block))
            yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=t) for k, (c, t) in enumerate([("kind", object), ("id", "int64"), ("lat", "float64"), ("lon", "float64"), ("refs", object), ("tags", object)])})


def read_pbf(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The elements of extracts, given by URIs."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    blobs = files.mapInPandas(_blobs, "path string, begin long, size long")
    return blobs.repartition("path", "begin").mapInPandas(_decoded, ELEMENTS)


def assemble(found: DataFrame) -> DataFrame:
    """One site's vertices (section, seq, tag, x, y) from elements: generators are terminals, substations and transformers roots, a plant's way the border.

    A feature that is a way stands at the mean of its nodes, the closing node once. Positions are projected
    to the zone of the first longitude.
    """
    power = F.col("tags")["power"]
    section = F.when(power == "generator", "terminal").when(power.isin("substation", "transformer"), "root").when(power == "plant", "border")
    marked = found.withColumn("section", section).filter("section IS NOT NULL").withColumn("tag", F.coalesce(F.col("tags")["ref"], F.col("tags")["name"]))
    nodes = found.filter("kind = 'node'").select(F.col("id").alias("ref"), "lat", "lon")
    single = marked.filter("kind = 'node' AND section <> 'border'").select("section", "tag", F.col("id").alias("a"), F.lit(0).alias("b"), "lat", "lon")
    ways = marked.filter("kind = 'way'").withColumn("refs", F.when(F.element_at("refs", 1) == F.element_at("refs", -1), F.slice("refs", F.lit(1), F.size("refs") - 1)).otherwise(F.col("refs")))
    at = ways.select("id", "section", "tag", F.posexplode("refs").alias("b", "ref")).join(nodes, "ref")
    middle = at.filter("section <> 'border'").groupBy("id", "section", "tag").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).select("section", "tag", F.col("id").alias("a"), F.lit(0).alias("b"), "lat", "lon")
    ring = at.filter("section = 'border'").select("section", "tag", F.col("id").alias("a"), "b", "lat", "lon")
    every = single.unionByName(middle).unionByName(ring)
    zone = every.agg(F.min("lon").alias("west"))
    j = every.crossJoin(F.broadcast(zone))  # one row
    # Longitudes beyond the first one's zone are projected as if they lay in it.
    x, y = utm(F.col("lat"), F.col("lon"), utm_zone(F.col("west")))
    seq = F.row_number().over(Window.partitionBy("section").orderBy("a", "b")) - 1
    return j.select("section", seq.cast("long").alias("seq"), "tag", x.alias("x"), y.alias("y"))


def landscape_angle(ring) -> float:
    """Degrees by which the least rectangle around a ring's points is turned, from -45 to 45."""
    from ..operators.kernels import convex_ring, points

    xy = np.asarray(ring, float)
    hull = xy[convex_ring(points(xy))]
    best = (np.inf, 0.0)
    for a, b in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        d = (b - a) / np.hypot(*(b - a))
        along, across = hull @ d, hull @ np.array([-d[1], d[0]])
        area = float((along.max() - along.min()) * (across.max() - across.min()))
        turn = (np.degrees(np.arctan2(d[1], d[0])) + 45) % 90 - 45
        best = min(best, (area, float(turn)))
    return best[1]

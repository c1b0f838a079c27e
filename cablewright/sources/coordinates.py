"""Coordinate texts as Columns: tagged entries, degrees and minutes, and the UTM projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of WGS 84 and of UTM.
RADIUS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def entries(text: Column) -> Column:
    """The lines of a coordinate list as (tag, a, b) structs: '[TAG] a b', with blanks, commas or semicolons between and optional brackets."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    parts = lambda x: F.filter(F.split(F.translate(x, "[]()", ""), r"[,;\s]+"), lambda y: y != "")
    entry = lambda p: F.struct(F.when(F.size(p) > 2, p[0]).alias("tag"), F.element_at(p, -2).alias("a"), F.element_at(p, -1).alias("b"))
    return F.transform(lines, lambda x: entry(parts(x)))


def degrees(text: Column) -> Column:
    """Signed degrees of a text like 11°22.333'N: minutes are sixtieths, south and west negative."""
    pattern = r"^\s*(\d+)°\s*([\d.]+)'\s*([NSEW])\s*$"
    value = F.regexp_extract(text, pattern, 1).cast("double") + F.regexp_extract(text, pattern, 2).cast("double") / 60
    return F.when(F.rlike(text, F.lit(pattern)), F.when(F.regexp_extract(text, pattern, 3).isin("S", "W"), -value).otherwise(value))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("long")


def utm(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing in the zone given, or else in the longitude's, by Krueger's series to the third order; south of the equator 10,000 km are added."""
    n = FLATTENING / (2 - FLATTENING)
    radius = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    phi, turn = F.radians(lat), F.radians(lon - ((utm_zone(lon) if zone is None else zone) * 6 - 183))
    atanh = lambda x: F.lit(0.5) * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - k * atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(turn)), atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + SCALE * radius * east, SCALE * radius * north + F.when(lat < 0, 10000000.0).otherwise(0.0)


def located(texts: DataFrame) -> DataFrame:
    """Rows (name, text) of latitude-longitude lists as name, seq, tag, zone, x, y."""
    e = texts.select("name", F.posexplode(entries(F.col("text"))).alias("seq", "e"))
    d = e.select("name", F.col("seq").cast("long").alias("seq"), F.col("e.tag").alias("tag"), degrees(F.col("e.a")).alias("lat"), degrees(F.col("e.b")).alias("lon"))
    x, y = utm(F.col("lat"), F.col("lon"))
    return d.select("name", "seq", "tag", utm_zone(F.col("lon")).alias("zone"), x.alias("x"), y.alias("y"))

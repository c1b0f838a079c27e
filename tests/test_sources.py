"""Site files, coordinates, stores and replay."""

import pytest
from pyspark.sql import functions as F

from cablewright.sources import coordinates, sites, store, synthetic
from cablewright.sources.fixtures import vertices
from cablewright.streaming import replay

SF = "/root/testdata/sf0.001"
PLANAR = """
OPERATOR: none
LANDSCAPE_ANGLE: 12.5
COORDINATE_FORMAT: planar
EXTENTS: |-
  0 0
  10 0
  10 10
  0 10
SUBSTATIONS: |-
  OSS 5, 5
TURBINES:
  - [1, 2]
  - [3, 4]
OBSTACLES:
  - |-
    6 6
    6 7
    7 7
"""
LATLON = """
EXTENTS: |-
  56°30.0'N 11°11.0'E
  56°31.0'N 11°12.0'E
  56°30.0'N 11°12.0'E
SUBSTATIONS: |-
  56°30.2'N 11°11.5'E
TURBINES: |-
  A1 56°30.3'N 11°11.6'E
  A2 56°30.4'N 11°11.7'E
"""


def test_yaml_sites(spark, tmp_path):
    (tmp_path / "Flat Site.yaml").write_text(PLANAR)
    (tmp_path / "Sea.yaml").write_text(LATLON)
    got = sites.read_sites(spark, f"file://{tmp_path}/*.yaml")
    n = {(r.handle, r.section): r["count"] for r in got.groupBy("handle", "section").count().collect()}
    assert n == {("flat_site", "border"): 4, ("flat_site", "root"): 1, ("flat_site", "terminal"): 2, ("flat_site", "obstacle"): 3, ("sea", "border"): 3, ("sea", "root"): 1, ("sea", "terminal"): 2}
    ids = {(r.section, r.seq): r.n for r in sites.numbered(got.filter("handle = 'flat_site'")).collect()}
    assert ids["terminal", 0] == 0 and ids["border", 0] == 2 and ids["obstacle", 2] == 8 and ids["root", 0] == -1
    sea = got.filter("handle = 'sea' AND section = 'terminal'").orderBy("seq").collect()
    assert [r.tag for r in sea] == ["A1", "A2"] and 630000 < sea[0].x < 640000 and 6.2e6 < sea[0].y < 6.3e6


def test_two_zones_are_refused(spark, tmp_path):
    (tmp_path / "wide.yaml").write_text(LATLON.replace("A2 56°30.4'N 11°11.7'E", "A2 56°30.4'N 17°11.7'E"))
    with pytest.raises(Exception, match="more than one UTM zone"):
        sites.read_sites(spark, f"file://{tmp_path}/wide.yaml").select("x").collect()


def test_utm(spark):
    """A meridian's northing is the scaled arc of the ellipsoid; the centre of a zone is at 500 km."""
    d = spark.createDataFrame([(0.0, 3.0), (45.0, 9.0), (-45.0, 9.0)], "lat double, lon double")
    x, y = coordinates.utm(F.col("lat"), F.col("lon"))
    got = d.select(F.round(x, 2).alias("x"), F.round(y, 2).alias("y")).collect()
    assert (got[0].x, got[0].y) == (500000.0, 0.0)
    assert got[1].x == 500000.0 and abs(got[1].y - 0.9996 * 4984944.378) < 0.01
    assert abs(got[2].y - (1e7 - got[1].y)) < 0.02


def test_windio(spark, tmp_path):
    (tmp_path / "site.yaml").write_text("site:\n  boundaries:\n    polygons:\n      - x: [0, 1, 1]\n        y: [0, 0, 1]\n")
    (tmp_path / "farm.yaml").write_text("wind_farm:\n  layouts:\n    initial_layout:\n      coordinates: {x: [0.1, 0.2], y: [0.1, 0.1]}\n  electrical_substations:\n    coordinates: {x: [0.5], y: [0.4]}\n")
    got = sites.read_windio(spark, f"file://{tmp_path}/site.yaml", f"file://{tmp_path}/farm.yaml")
    assert {r.section: r["count"] for r in got.groupBy("section").count().collect()} == {"terminal": 2, "root": 1, "border": 3}


def test_toy_and_lattice(spark):
    assert synthetic.toy(spark).select("x", "y").distinct().count() == 13
    p = synthetic.lattice(spark, 500, 100)
    assert p.filter("x2 * x2 + 3 * y3 * y3 > 4 * 500 * 500").count() == 0 and p.count() == 91


def test_load_by_capacity(spark):
    from cablewright.operators.trees import seed_forest

    v = vertices(spark, SF)
    path = store.folder(spark)
    store.add_absent(spark, store.node_sets(v), f"{path}/nodesets", ["digest"])
    for c in (5, 8):
        assert store.add_absent(spark, store.route_sets(seed_forest(v), v, c, "seed"), f"{path}/routesets", ["nodes", "method", "capacity"]) == 10
    assert store.load(spark, path, [8]).count() == 10 and store.load(spark, path, method="other").count() == 0 and store.load(spark, path).count() == 20


def test_two_writers_add_a_key_once(spark, monkeypatch):
    v = vertices(spark, SF)
    path = f"{store.folder(spark)}/nodesets"
    rows, plain, others = store.node_sets(v), store._publish, []

    def late(*a):
        # Another writer takes the version that this one is about to publish.
        if not others:
            others.append(None)
            others[0] = store.add_absent(spark, rows.filter("site_id < 4"), path, ["digest"])
        return plain(*a)

    monkeypatch.setattr(store, "_publish", late)
    assert store.add_absent(spark, rows, path, ["digest"]) == 6 and others == [4]
    assert store.table(spark, path).count() == 10 == store.table(spark, path).select("digest").distinct().count()
    assert store.add_absent(spark, rows, path, ["digest"]) == 0 and store._snapshot(spark, path)[0] == 1
    fs, at = store._file_system(spark, path)
    assert sorted(f.getPath().getName()[:5] for f in fs.listStatus(at)) == ["_comm", "data-", "data-"]


def test_stream_replay(spark, tmp_path):
    from cablewright.operators.trees import seed_forest

    log = replay.star_log(seed_forest(vertices(spark, SF)))
    folder = f"file://{tmp_path}/log"
    log.filter("iteration < 20").write.parquet(folder)
    log.filter("iteration >= 20").write.mode("append").parquet(folder)
    q = replay.replay_stream(spark, folder).writeStream.format("memory").queryName("edges").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in replay.replay(log).collect()}
    assert {tuple(r) for r in spark.table("edges").collect()} == want and want


def test_included_sections_are_read(spark, tmp_path):
    from cablewright.sources import sites

    (tmp_path / "site.yaml").write_text("boundaries: !include border.yaml\n")
    (tmp_path / "border.yaml").write_text("polygons: [{x: [0, 4, 4], y: [0, 0, 3]}]\n")
    (tmp_path / "farm.yaml").write_text("wind_farm:\n  layouts:\n    initial_layout:\n      coordinates: {x: [1, 2.5], y: [1, 0.5]}\n  electrical_substations:\n    coordinates: {x: [3], y: [1]}\n")
    got = {(r.section, r.seq, r.x, r.y) for r in sites.read_windio(spark, f"file://{tmp_path}/site.yaml", f"file://{tmp_path}/farm.yaml").collect()}
    assert got == {("border", 0, 0.0, 0.0), ("border", 1, 4.0, 0.0), ("border", 2, 4.0, 3.0), ("terminal", 0, 1.0, 1.0), ("terminal", 1, 2.5, 0.5), ("root", 0, 3.0, 1.0)}


def test_records_of_the_store(spark, tmp_path):
    from cablewright.sources import store

    r = store.machine(spark).first()
    assert r["name"] and '"cores"' in r["attributes"]
    d = spark.createDataFrame([(1, None), (2, "2024-01-02 03:04:05")], "k int, t string").selectExpr("k", "cast(t as timestamp) AS timestamp")
    out = {x.k: x.timestamp for x in store.stamped(d).collect()}
    assert out[1] is not None and str(out[2]) == "2024-01-02 03:04:05"
    assert store.stamped(d.select("k")).columns == ["k", "timestamp"]


def test_logs_go_to_two_streams():
    import subprocess
    import sys
    from pathlib import Path

    code = "from cablewright.logs import to_streams as t; t(); l = t(); l.info('low'); l.warning('high'); l.debug('none')"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parent.parent)
    assert said.stdout == "INFO cablewright: low\n" and said.stderr == "WARNING cablewright: high\n"


def _pbf(path, nodes, ways, dense=True):
    """A small extract: nodes (id, lat, lon, tags), ways (id, refs, tags)."""
    import struct
    import zlib

    def var(x):
        out = b""
        while True:
            out += bytes([x & 0x7F | (0x80 if x > 0x7F else 0)])
            x >>= 7
            if not x:
                return out

    zig = lambda x: var(x << 1 if x >= 0 else (-x << 1) - 1)
    num, raw = lambda n, x: var(n << 3) + var(x), lambda n, b: var(n << 3 | 2) + var(len(b)) + b
    texts = [b""]

    def code(s):
        if s.encode() not in texts:
            texts.append(s.encode())
        return texts.index(s.encode())

    def steps(xs):
        return b"".join(zig(b - a) for a, b in zip([0, *xs], xs, strict=False))

    grid = [(i, round(a * 1e7), round(o * 1e7), t) for i, a, o, t in nodes]
    keys = lambda t: raw(2, b"".join(var(code(k)) for k in t)) + raw(3, b"".join(var(code(v)) for v in t.values()))
    if dense:
        marks = b"".join(b"".join(var(code(k)) + var(code(v)) for k, v in t.items()) + b"\0" for *_, t in grid)
        group = raw(2, raw(1, steps([g[0] for g in grid])) + raw(8, steps([g[1] for g in grid])) + raw(9, steps([g[2] for g in grid])) + raw(10, marks))
    else:
        group = b"".join(raw(1, var(1 << 3) + zig(i) + keys(t) + var(8 << 3) + zig(a) + var(9 << 3) + zig(o)) for i, a, o, t in grid)
    more = b"".join(raw(3, num(1, i) + keys(t) + raw(8, steps(refs))) for i, refs, t in ways)
    block = raw(1, b"".join(raw(1, s) for s in texts)) + raw(2, group) + raw(2, more)
    with open(path, "wb") as f:
        for kind, body in ((b"OSMHeader", raw(1, b"")), (b"OSMData", num(2, len(block)) + raw(3, zlib.compress(block)))):
            head = raw(1, kind) + num(3, len(body))
            f.write(struct.pack(">I", len(head)) + head + body)


def test_map_extracts(spark, tmp_path):
    import numpy as np

    from cablewright.sources import pbf

    nodes = [(10, 54.5, 7.5, {"power": "generator", "ref": "A1"}), (11, 54.51, 7.52, {"power": "generator"}), (-3, 54.49, 7.49, {}), (20, 54.4, 7.4, {}), (21, 54.4, 7.6, {}), (22, 54.6, 7.6, {}), (23, 54.6, 7.4, {"man_made": "x"})]
    ways = [(5, [20, 21, 22, 23, 20], {"power": "plant", "name": "farm"}), (6, [20, 21, 20], {"power": "substation"})]
    paths = []
    for dense in (True, False):
        paths.append(f"file://{tmp_path}/{dense}.osm.pbf")
        _pbf(paths[-1][7:], nodes, ways, dense)
        got = {(r.kind, r.id): r for r in pbf.read_pbf(spark, paths[-1:]).collect()}
        for i, a, o, t in nodes:
            r = got["node", i]
            assert abs(r.lat - a) < 1e-7 and abs(r.lon - o) < 1e-7 and r.tags == t
        assert got["way", 5].refs == [20, 21, 22, 23, 20] and got["way", 6].tags == {"power": "substation"} and len(got) == 9
    assert pbf.read_pbf(spark, paths).count() == 18
    site = {(r.section, r.seq): r for r in pbf.assemble(pbf.read_pbf(spark, paths[:1])).collect()}
    assert sorted(site) == [("border", 0), ("border", 1), ("border", 2), ("border", 3), ("root", 0), ("terminal", 0), ("terminal", 1)]
    assert site["terminal", 0].tag == "A1" and 400_000 < site["terminal", 0].x < 410_000 and 6_030_000 < site["terminal", 0].y < 6_050_000
    turned = np.array([[0, 0], [4, 0], [4, 2], [0, 2]]) @ np.array([[np.cos(0.3), np.sin(0.3)], [-np.sin(0.3), np.cos(0.3)]])
    assert abs(pbf.landscape_angle(turned) - np.degrees(0.3)) < 1e-9

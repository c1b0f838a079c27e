"""Registered queries of texts, options and made-up sites, each fed from the tables: texts are put together from a site's points and read back.

A text's SQL never parses: it states what the points say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import joins, mesh, obstacles, polygons, trees
from ..sources import coordinates, routing, store, synthetic
from .catalogue import _BASE, _C1, _KNN, _LOADS, _PAIRS, _PTS, _TRI, _meet, _with, query
from .more import _BOX, _IN_NOTCH, _NOTCH
from .records import _N, _R, _TERM


def _joined(by: list[str], order: str, line, sep: str = "\n"):
    """An aggregate: the lines in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda s: s["line"]), sep)


# Coordinate lists: five terminals a text, in three ways of writing them.
def _entries(v: DataFrame) -> DataFrame:
    x, y = (F.col(c).cast("string") for c in "xy")
    line = F.when(F.col("n") % 3 == 0, F.concat(F.lit("T"), F.col("n"), F.lit(" "), x, F.lit(", "), y, F.lit("\n"))).when(F.col("n") % 3 == 1, F.concat(F.lit("["), x, F.lit("; "), y, F.lit("]"))).otherwise(F.concat(F.lit("  X"), F.col("n"), F.lit(" ("), x, F.lit(" "), y, F.lit(") ")))
    texts = v.filter("n >= 0").withColumn("k", F.floor(F.col("n") / 5)).groupBy("site_id", "k").agg(_joined([], "n", line).alias("text"))
    return texts.select("site_id", "k", F.posexplode(coordinates.entries(F.col("text"))).alias("seq", "e")).select("site_id", "k", F.col("seq").cast("long").alias("seq"), "e.tag", "e.a", "e.b")


query("src2_entries", f"{_with(_C1)} SELECT site_id, n // 5 AS k, n % 5 AS seq, CASE n % 3 WHEN 0 THEN 'T' || n WHEN 2 THEN 'X' || n END AS tag, CAST(x AS VARCHAR) AS a, CAST(y AS VARCHAR) AS b FROM v WHERE n >= 0")(lambda spark, v, d: _entries(v))


def _angle(whole, thousandths, letter):
    """A text like 11°22.333'N."""
    return F.concat(whole.cast("string"), F.lit("°"), F.floor(thousandths / 1000).cast("string"), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0"), F.lit("'"), letter)


def _minutes(c: str):
    """Thousandths of minutes, from a coordinate."""
    return F.abs(F.col(c)) * 7919 % 60000


query("src3_degrees", f"{_with(_C1)} SELECT site_id, n, CASE WHEN n % 7 <> 3 THEN CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * (abs(x) % 90 + (abs(y) * 7919 % 60000) / 1000.0::DOUBLE / 60) END AS degrees FROM v WHERE n >= 0")(
    lambda spark, v, d: v.filter("n >= 0").select("site_id", "n", coordinates.degrees(F.when(F.col("n") % 7 == 3, "north").otherwise(_angle(F.abs("x") % 90, _minutes("y"), F.when(F.col("n") % 4 == 0, "N").when(F.col("n") % 4 == 1, "S").when(F.col("n") % 4 == 2, "E").otherwise("W")))).alias("degrees"))
)


# Krueger's series over each site's list of terminals.
def _utm(v: DataFrame) -> DataFrame:
    south = F.col("site_id") % 2 == 1
    lat = _angle(50 + F.abs("x") % 9, _minutes("y"), F.when(south, "S").otherwise("N"))
    lon = _angle(F.abs("y") % 30, _minutes("x"), F.when(F.col("n") % 2 == 1, "W").otherwise("E"))
    texts = v.filter("n >= 0").groupBy("site_id").agg(_joined([], "n", F.concat(F.lit("T"), F.col("n"), F.lit(" "), lat, F.lit(" "), lon)).alias("text"))
    out = coordinates.located(texts.select(F.concat(F.lit("site_"), F.col("site_id")).alias("name"), "text"))
    return out.withColumn("x", F.round("x", 2)).withColumn("y", F.round("y", 2))


query("src4_utm", f"""{_with(_C1)}, p AS (SELECT 'site_' || site_id AS name, n AS seq, 'T' || n AS tag, CASE WHEN site_id % 2 = 1 THEN -1 ELSE 1 END * (50 + abs(x) % 9 + (abs(y) * 7919 % 60000) / 1000.0::DOUBLE / 60) AS lat,
  CASE WHEN n % 2 = 1 THEN -1 ELSE 1 END * (abs(y) % 30 + (abs(x) * 7919 % 60000) / 1000.0::DOUBLE / 60) AS lon FROM v WHERE n >= 0),
z AS (SELECT *, CAST(floor((lon + 180) / 6) + 1 AS BIGINT) AS zone, radians(lat) AS phi FROM p), y AS (SELECT *, radians(lon - (zone * 6 - 183)) AS turn, {2 * _N**0.5 / (1 + _N)!r} AS k FROM z),
x AS (SELECT *, sinh(atanh(sin(phi)) - k * atanh(k * sin(phi))) AS t FROM y), w AS (SELECT *, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM x)
SELECT name, seq, tag, zone, round(500000 + {_R!r} * (eta + {_TERM.format('cos', 'sinh')}), 2) AS x, round({_R!r} * (xi + {_TERM.format('sin', 'cosh')}) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 2) AS y FROM w""")(lambda spark, v, d: _utm(v))


# Made-up sites, laid where the tables' sites lie.
def _corners(v: DataFrame) -> DataFrame:
    return v.groupBy("site_id").agg(*[F.min(c).alias(f"{c}0") for c in "xy"], *[F.max(c).alias(f"{c}1") for c in "xy"])


query("src14_toy", f"{_with(_C1)}, c AS (SELECT site_id, min(x) AS x0, min(y) AS y0 FROM v GROUP BY site_id), t AS (SELECT CAST(i AS BIGINT) AS n, i % 4 * 900 + i // 4 % 2 * 300 AS x, i // 4 * 800 AS y FROM range(0, 12) t(i) UNION ALL VALUES (-1, 1500, -700)) SELECT site_id, n, CAST(x + x0 AS BIGINT) AS x, CAST(y + y0 AS BIGINT) AS y FROM c, t")(
    # Thirteen points.
    lambda spark, v, d: _corners(v).crossJoin(F.broadcast(synthetic.toy(spark).drop("site_id"))).select("site_id", "n", (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"))
)
_LATTICE = "x2 / 2 + mx BETWEEN x0 AND x1 AND y3 * 0.8660254037844386::DOUBLE + my BETWEEN y0 AND y1"
query("src16_lattice", f"{_with(_C1)}, c AS (SELECT site_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, floor(avg(x)) AS mx, floor(avg(y)) AS my FROM v GROUP BY site_id), l AS (SELECT i, j, 500 * (2 * i + j) AS x2, 500 * j AS y3 FROM range(-41, 42) a(i), range(-41, 42) b(j) WHERE (500 * (2 * i + j)) * (500 * (2 * i + j)) + 3 * (500 * j) * (500 * j) <= 4 * 5000 * 5000) SELECT site_id, i, j, x2, y3 FROM c, l WHERE {_LATTICE}")(
    # As many points as the lattice's parameters say.
    lambda spark, v, d: _corners(v).join(v.groupBy("site_id").agg(F.floor(F.avg("x")).alias("mx"), F.floor(F.avg("y")).alias("my")), "site_id").crossJoin(F.broadcast(synthetic.lattice(spark, 5000, 500))).filter("x2 / 2 + mx BETWEEN x0 AND x1 AND y3 * 0.8660254037844386D + my BETWEEN y0 AND y1").select("site_id", "i", "j", "x2", "y3")
)
query("src18_terminal_count", f"{_with(_C1)}, c AS (SELECT site_id, n, abs(x) % 1000 / 1000.0::DOUBLE AS u, sqrt(0.6::DOUBLE / pi()) AS c, 0.045::DOUBLE AS b FROM v), a AS (SELECT *, 4 * c * sqrt(69.5000001::DOUBLE) - b * 69.5000001 AS low, 4 * c * sqrt(200.5::DOUBLE) - b * 200.5 AS high FROM c) SELECT site_id, n, CAST(round_even(pow((2 * c - sqrt(4 * c * c - b * (low + u * (high - low)))) / b, 2), 0) AS BIGINT) AS terminals FROM a")(
    lambda spark, v, d: v.select("site_id", "n", synthetic.terminal_count(F.abs("x") % 1000 / 1000.0, 70, 200, 0.6, 0.045).alias("terminals"))
)
query("src15_convex_border", f"{_with(_C1, _TRI)}, h AS (SELECT site_id, u, v FROM sd GROUP BY site_id, u, v HAVING count(*) = 1) SELECT h.site_id, h.u, h.v, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM h JOIN v a ON a.site_id = h.site_id AND a.n = h.u JOIN v b ON b.site_id = h.site_id AND b.n = h.v")(
    lambda spark, v, d: mesh.with_points(mesh.hull_edges(mesh.triangles(v)), v).select("site_id", "u", "v", "ux", "uy", "vx", "vy")
)


# The store and its records.
def _schema(spark: SparkSession, v: DataFrame) -> DataFrame:
    """Columns of the store's tables, and how many rows they have once the sites' node sets are in."""
    path = store.folder(spark)
    store.create(spark, path)
    store.add_absent(spark, store.node_sets(v), f"{path}/nodesets", ["digest"])
    out = None
    for t in store.SCHEMAS:
        rows = store.table(spark, f"{path}/{t}")
        columns = spark.createDataFrame([(t, k, f.name, f.dataType.simpleString()) for k, f in enumerate(rows.schema)], "table string, position int, column string, type string")
        part = columns.crossJoin(F.broadcast(rows.agg(F.count("*").alias("rows"))))  # one row
        out = part if out is None else out.unionByName(part)
    return out


_FIELDS = ", ".join(str((t, k, c, y)) for t, ddl in store.SCHEMAS.items() for k, (c, y) in enumerate(x.strip().split(" ") for x in ddl.split(",")))
query("src22_schema", f"{_with(_C1)} SELECT t.*, CASE WHEN \"table\" = 'nodesets' THEN (SELECT count(DISTINCT site_id) FROM v) ELSE 0 END AS rows FROM (VALUES {_FIELDS}) t(\"table\", position, \"column\", type)")(lambda spark, v, d: _schema(spark, v))


def _added(spark: SparkSession, v: DataFrame) -> DataFrame:
    """The table after the sites below 6 and then all were added, with how many were new the second time."""
    path = f"{store.folder(spark)}/nodesets"
    store.add_absent(spark, store.node_sets(v).filter("site_id < 6"), path, ["digest"])
    second = store.add_absent(spark, store.node_sets(v), path, ["digest"])
    return store.table(spark, path).select("site_id", "digest", "T", "R", F.lit(second).cast("long").alias("added"))


query("snk2_add_absent", f"{_with(_C1)} SELECT site_id, sha256(string_agg(n || ':' || x || ':' || y, ';' ORDER BY n)) AS digest, count(*) FILTER (WHERE n >= 0) AS T, count(*) FILTER (WHERE n < 0) AS R, (SELECT count(DISTINCT site_id) FROM v WHERE site_id >= 6) AS added FROM v GROUP BY site_id")(lambda spark, v, d: _added(spark, v))
query("snk4_methods", f"""{_with(_C1)}, m AS (SELECT 'savings_' || site_id % 3 AS s, '{{"capacity":"' || count(*) || '","gates_limit":"given","seed":"' || max(x) || '"}}' AS o FROM v GROUP BY site_id) SELECT sha256(s || '|' || o) AS digest, s AS solver_name, o AS options FROM m""")(
    lambda spark, v, d: store.digested(v.groupBy("site_id").agg(F.count("*").alias("k"), F.max("x").alias("x")).select(F.concat(F.lit("savings_"), F.col("site_id") % 3).alias("solver_name"), F.create_map(F.lit("seed"), F.col("x").cast("string"), F.lit("gates_limit"), F.lit("given"), F.lit("capacity"), F.col("k").cast("string")).alias("o")))
)

# Names and options.
query("sf2_handle", "SELECT s_suppkey, lower(replace(s_name, '#', ' no ')) AS name, replace(lower(replace(s_name, '#', ' no ')), ' ', '_') AS handle FROM supplier")(
    lambda spark, v, d: spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.lower(F.replace("s_name", F.lit("#"), F.lit(" no "))).alias("name"), X.handle(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "!site!").otherwise(""), F.replace("s_name", F.lit("#"), F.lit(" No ")))).alias("handle"))
)
query("sf8_options", f"""{_with(_C1)} SELECT site_id, '{{"points":"' || count(*) || '","x":"' || max(x) || '"}}' AS options FROM v GROUP BY site_id""")(
    lambda spark, v, d: v.groupBy("site_id").agg(F.count("*").cast("string").alias("k"), F.max("x").cast("string").alias("x")).select("site_id", X.options_json(F.create_map(F.lit("x"), F.col("x"), F.lit("secret"), F.lit("y"), F.lit("points"), F.col("k")), ["secret"]).alias("options"))
)
_SOLVERS = ("cbc", "highs", "scip", "other")
query("ml6_option_names", f"SELECT s_suppkey, solver, CASE solver WHEN 'cbc' THEN 'ratioGap' WHEN 'highs' THEN 'mip_rel_gap' WHEN 'scip' THEN 'limits/gap' ELSE 'mipgap' END AS gap, CASE solver WHEN 'cbc' THEN 'seconds' WHEN 'highs' THEN 'time_limit' WHEN 'scip' THEN 'limits/time' ELSE 'timelimit' END AS seconds FROM (SELECT s_suppkey, {list(_SOLVERS)}[CAST(s_nationkey % 4 + 1 AS INTEGER)] AS solver FROM supplier) q")(
    lambda spark, v, d: spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.array(*map(F.lit, _SOLVERS))[(F.col("s_nationkey") % 4).cast("int")].alias("solver")).select("s_suppkey", "solver", *routing.option_columns(F.col("solver")))
)


# Arrays: four terminals each, one taken out, the path turned so that its head comes first.
def _arrays(v: DataFrame) -> DataFrame:
    s = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    g = v.filter("n >= 0").withColumn("k", F.floor(F.col("n") / 4)).groupBy("site_id", "k").agg(F.array_sort(F.collect_list("n")).alias("a"))
    turned = X.turned_to(F.col("a"), F.when(F.col("k") % 2 == 0, F.element_at("a", -1)).otherwise(F.element_at("a", 1)))
    return g.select("site_id", "k", s(X.without(F.col("a"), 4 * F.col("k") + 2)).alias("without"), s(turned).alias("turned"), s(F.slice(turned, 2, 2)).alias("part"))


_TURN = "ORDER BY CASE WHEN n // 4 % 2 = 0 THEN -n ELSE n END"
query("sf7_arrays", f"{_with(_C1)}, a AS (SELECT site_id, n // 4 AS k, n, row_number() OVER (PARTITION BY site_id, n // 4 {_TURN}) AS z FROM v WHERE n >= 0) SELECT site_id, k, coalesce(string_agg(n, ',' ORDER BY n) FILTER (WHERE n % 4 <> 2), '') AS without, string_agg(n, ',' {_TURN}) AS turned, coalesce(string_agg(n, ',' {_TURN}) FILTER (WHERE z IN (2, 3)), '') AS part FROM a GROUP BY site_id, k")(lambda spark, v, d: _arrays(v))

# Ranks of a site's terminals against a span of ranks that its number gives.
_SPAN = "site_id % 3 + 2 AS low, site_id % 3 + 20 AS high"
query("geo18_rank_within", f"{_with(_C1)} SELECT site_id, n, n BETWEEN low AND high AS inside, n <= low OR n >= high AS wrapped, n > low AND n < high AS strict FROM (SELECT *, {_SPAN} FROM v WHERE n >= 0) q")(
    lambda spark, v, d: v.filter("n >= 0").selectExpr("site_id", "n", *_SPAN.split(", ")).select("site_id", "n", *[G.rank_within(F.col("n"), F.col("low"), F.col("high"), F.lit(wraps), touch).alias(c) for c, wraps, touch in (("inside", False, True), ("wrapped", True, True), ("strict", False, False))])
)


# A solver's log: a step for each terminal, at the least x so far; and its summary.
def _logs(v: DataFrame) -> DataFrame:
    best = F.min("x").over(Window.partitionBy("site_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) + 20000
    line = F.concat(F.lit("it "), F.col("n"), F.lit(" t "), (F.col("n") * 1.5).cast("string"), F.lit(" cost "), F.col("best"), F.lit(".25"))
    logs = v.filter("n >= 0").withColumn("best", best).groupBy("site_id").agg(_joined([], "n", line).alias("log"), F.min("best").alias("best"))
    logs = logs.withColumn("log", F.when(F.col("site_id") % 4 == 3, "no result").otherwise(F.concat("log", F.lit("\nfinal cost "), "best", F.lit(".25"))))
    lines = logs.select("site_id", F.regexp_extract("log", r"final cost ([\d.]+)", 1).alias("final"), F.explode(F.split("log", "\n")).alias("line"))
    hit = lines.select("site_id", "final", F.regexp_extract("line", r"t ([\d.]+) cost", 1).alias("t"), F.regexp_extract("line", r"t [\d.]+ cost ([\d.]+)", 1).alias("c"))
    first = hit.filter("final <> '' AND c = final").groupBy("site_id").agg(F.min(F.col("t").cast("double")).alias("seconds"), F.max(F.col("c").cast("double")).alias("cost"))
    return logs.select("site_id").join(first, "site_id", "left").select("site_id", "seconds", "cost")


query("sf3_log_parse", f"{_with(_C1)}, r AS (SELECT site_id, n, min(x) OVER (PARTITION BY site_id ORDER BY n) + 20000 AS best FROM v WHERE n >= 0) SELECT site_id, CASE WHEN site_id % 4 <> 3 THEN min(n) * 1.5::DOUBLE END AS seconds, CASE WHEN site_id % 4 <> 3 THEN min(best) + 0.25::DOUBLE END AS cost FROM r WHERE (site_id, best) IN (SELECT site_id, min(best) FROM r GROUP BY site_id) GROUP BY site_id")(lambda spark, v, d: _logs(v))


def _summaries(v: DataFrame) -> DataFrame:
    text = "Successes/Runs = 0/3\nCost.min = %d, Cost.avg = 131.5, Cost.max = %d\nGap.min = 0.0%%%%\n%sTrials.min = %d, Trials.avg = 9.0, Trials.max = 12\nTime.min = 0.25 sec., Time.avg = 0.5 sec., Time.max = %d.75 sec."
    g = v.groupBy("site_id").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("k"), F.min("y").alias("c"))
    penalty = F.when(F.col("site_id") % 2 == 0, F.concat(F.lit("Penalty.min = 0, Penalty.avg = 0.33, Penalty.max = "), F.abs("c"), F.lit("\n"))).otherwise("")
    return g.select("site_id", F.format_string(text.replace("%%%%", "%%"), "a", "b", penalty, "k", F.abs("c")).alias("s")).select("site_id", *X.summary_extrema(F.col("s")))


query("sf4_summary", f"{_with(_C1)} SELECT site_id, CAST(min(x) AS DOUBLE) AS cost_min, CAST(max(x) AS DOUBLE) AS cost_max, CASE WHEN site_id % 2 = 0 THEN 0.0::DOUBLE END AS penalty_min, CASE WHEN site_id % 2 = 0 THEN CAST(abs(min(y)) AS DOUBLE) END AS penalty_max, CAST(count(*) AS DOUBLE) AS trials_min, 12.0::DOUBLE AS trials_max, 0.25::DOUBLE AS time_min, abs(min(y)) + 0.75::DOUBLE AS time_max FROM v GROUP BY site_id")(lambda spark, v, d: _summaries(v))


# A tour over a site's terminals, from the last to the first, with a copy of the depot behind the tenth of them and every tenth after.
def _tours(v: DataFrame) -> DataFrame:
    g = v.filter("n >= 0").groupBy("site_id").agg(F.array_sort(F.collect_list("n")).alias("ns"), F.count("*").alias("k"))
    node = lambda n, i: F.when((i % 10 == 0) & (i > 0), F.concat((F.col("k") + 1 + F.floor(i / 10)).cast("string"), F.lit("\n"), (n + 2).cast("string"))).otherwise((n + 2).cast("string"))
    # Written from the middle on, so that reading has to turn it to the depot.
    body = F.array_join(F.transform(F.reverse("ns"), node), "\n")
    texts = g.select("site_id", F.concat(F.lit("NAME : t\nDIMENSION : "), F.col("k") + 1 + F.floor((F.col("k") - 1) / 10), F.lit("\nTOUR_SECTION\n1\n"), body, F.lit("\n-1\nEOF")).alias("tour"))
    return routing.tours(texts, g.select("site_id", F.col("k").alias("terminals"))).select("site_id", F.col("route").cast("long").alias("route"), F.col("seq").cast("long").alias("seq"), F.col("n").cast("long").alias("n"))


query("vr3_tour", f"{_with(_C1)}, o AS (SELECT site_id, n, row_number() OVER (PARTITION BY site_id ORDER BY n DESC) - 1 AS i FROM v WHERE n >= 0) SELECT site_id, i // 10 AS route, i % 10 AS seq, n FROM o")(lambda spark, v, d: _tours(v))


# Poisson discs in the notched border, off the obstacle and the roots: SQL takes the candidates one by one.
_DISC, _AWAY, _WANT, _TRIES = 1500, 800, 40, 15
_AT = "{0}0 + CAST('0x' || substr(md5('1:' || site_id || ':' || k), {1}, 8) AS BIGINT) % ({0}1 - {0}0 + 1) AS {0}"
query("src17_poisson_disc", f"""{_with(_C1, _BOX, _NOTCH, recursive=True)}, ca AS (SELECT site_id, k AS n, {_AT.format('x', 1)}, {_AT.format('y', 9)}, x1, y1, x0, xm, ym FROM nm, range(0, {_WANT * _TRIES}) t(k)),
fr AS (SELECT site_id, ca.n, ca.x, ca.y, row_number() OVER (PARTITION BY site_id ORDER BY ca.n) AS i FROM ca JOIN bx USING (site_id) WHERE NOT (x BETWEEN cx - 300 AND cx + 300 AND y BETWEEN cy - 300 AND cy + 300) {_IN_NOTCH}
  AND NOT EXISTS (SELECT 1 FROM v r WHERE r.site_id = ca.site_id AND r.n < 0 AND (r.x - ca.x) * (r.x - ca.x) + (r.y - ca.y) * (r.y - ca.y) < {_AWAY * _AWAY})),
rec AS (SELECT site_id, 0 AS i, []::STRUCT(n BIGINT, x BIGINT, y BIGINT)[] AS got FROM nm UNION ALL
  SELECT rec.site_id, rec.i + 1, CASE WHEN len(list_filter(got, lambda p: (p.x - fr.x) * (p.x - fr.x) + (p.y - fr.y) * (p.y - fr.y) < {_DISC * _DISC})) = 0 AND len(got) < {_WANT} THEN list_append(got, {{'n': fr.n, 'x': CAST(fr.x AS BIGINT), 'y': CAST(fr.y AS BIGINT)}}) ELSE got END
  FROM rec JOIN fr ON fr.site_id = rec.site_id AND fr.i = rec.i + 1)
SELECT site_id, p.n AS n, p.x AS x, p.y AS y FROM (SELECT site_id, unnest(arg_max(got, i)) AS p FROM rec GROUP BY site_id) q""")(
    lambda spark, v, d: synthetic.poisson_disc(polygons.notched_border(v).unionByName(polygons.box_obstacle(v)), v.filter("n < 0").select("site_id", "x", "y"), _WANT, _DISC, _AWAY, tries=_TRIES)
)


# Shortest ways around the obstacle: SQL goes by its four corners, three of which suffice.
_CORNERS = """co AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY sx, sy) AS k, sx AS x, sy AS y FROM ob),
wa AS (SELECT site_id, sx, sy, tx, ty FROM ob UNION ALL SELECT a.site_id, a.x, a.y, b.x, b.y FROM co a JOIN co b ON a.site_id = b.site_id AND (a.k, b.k) IN ((1, 4), (2, 3))),
nd AS (SELECT site_id, n AS id, x, y FROM v UNION ALL SELECT site_id, 1000000 + k, x, y FROM co),
lg AS (SELECT p.site_id, p.id AS a, q.id AS b, p.x AS ux, p.y AS uy, q.x AS vx, q.y AS vy FROM nd p JOIN nd q ON p.site_id = q.site_id AND p.id < q.id AND (q.id > 1000000 OR (p.id < 0 AND q.id >= 0)))"""
_AROUND = "SELECT site_id, root, c, min(w) AS w FROM (SELECT * FROM {0} UNION ALL SELECT {0}.site_id, root, cc.b, {0}.w + cc.w FROM {0} JOIN cc ON cc.site_id = {0}.site_id AND cc.a = c) q GROUP BY site_id, root, c"
query("mesh12_free_distances", f"""{_with(*_BASE, _BOX, _CORNERS)}, fr AS (SELECT site_id, a, b, sqrt(CAST((ux - vx) * (ux - vx) + (uy - vy) * (uy - vy) AS DOUBLE)) AS w FROM lg WHERE NOT EXISTS (SELECT 1 FROM wa WHERE wa.site_id = lg.site_id AND {_meet('u', 'v', 's', 't')})),
cc AS (SELECT site_id, a, b, w FROM fr WHERE a > 1000000 UNION ALL SELECT site_id, b, a, w FROM fr WHERE a > 1000000), r0 AS (SELECT site_id, a AS root, b AS c, w FROM fr WHERE a < 0 AND b > 1000000),
r1 AS ({_AROUND.format('r0')}), r2 AS ({_AROUND.format('r1')}), r3 AS ({_AROUND.format('r2')}),
al AS (SELECT site_id, a AS root, b AS n, w FROM fr WHERE a < 0 AND b BETWEEN 0 AND 1000000 UNION ALL SELECT fr.site_id, root, fr.a, fr.w + r3.w FROM fr JOIN r3 ON r3.site_id = fr.site_id AND r3.c = fr.b WHERE fr.a BETWEEN 0 AND 1000000)
SELECT d.site_id, d.n, d.root, CAST(round(min(w) * 1000) AS BIGINT) AS length FROM d LEFT JOIN al ON al.site_id = d.site_id AND al.n = d.n AND al.root = d.root GROUP BY d.site_id, d.n, d.root""")(
    lambda spark, v, d: obstacles.root_distances(v, polygons.box_border(v).unionByName(polygons.box_obstacle(v)))
)


# Validation: crossings of the nearest-neighbour edges, and terminals at which a way from the terminal before to the one behind parts the edges.
_VIEW = "atan2((ax - ox) * ({0}y - oy) - (ay - oy) * ({0}x - ox), (ax - ox) * ({0}x - ox) + (ay - oy) * ({0}y - oy))"
query("val1_violations", f"""{_with(_C1, _KNN, _PAIRS.format('e'), _PTS.format('pr'))}, nb AS (SELECT site_id, u AS o, v AS m FROM e UNION ALL SELECT site_id, v, u FROM e),
pw AS (SELECT nb.site_id, nb.o, nb.m, a.x AS ax, a.y AS ay, o.x AS ox, o.y AS oy, b.x AS bx, b.y AS by_, m.x AS mx, m.y AS my FROM nb JOIN v o ON o.site_id = nb.site_id AND o.n = nb.o JOIN v a ON a.site_id = nb.site_id AND a.n = nb.o - 1 JOIN v b ON b.site_id = nb.site_id AND b.n = nb.o + 1 JOIN v m ON m.site_id = nb.site_id AND m.n = nb.m WHERE nb.o > 0),
an AS (SELECT site_id, o, m, {_VIEW.format('b').replace('by ', 'by_ ').replace('by)', 'by_)')} AS w, {_VIEW.format('m')} AS p FROM pw),
sp AS (SELECT site_id, o, min(m) FILTER (WHERE CASE WHEN w >= 0 THEN p > 1e-3 AND p < w - 1e-3 ELSE p < -1e-3 AND p > w + 1e-3 END) AS s, min(m) FILTER (WHERE CASE WHEN w >= 0 THEN p < -1e-3 OR p > w + 1e-3 ELSE p > 1e-3 OR p < w - 1e-3 END) AS t FROM an GROUP BY site_id, o)
SELECT site_id, u, v, s, t FROM p4 WHERE {_meet('u', 'v', 's', 't')} UNION ALL SELECT site_id, o, o, s, t FROM sp WHERE s IS NOT NULL AND t IS NOT NULL""")(
    lambda spark, v, d: trees.violations(joins.knn_edges(v), v, v.filter("n > 0").select("site_id", (F.col("n") - 1).alias("a"), F.col("n").alias("d"), (F.col("n") + 1).alias("b")))
)


# The mesh's rim within the notched border.
_AT_BORDER = (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("xm", "ym"), ("x0", "y1"))
_RING = "bd AS (" + " UNION ALL ".join(f"SELECT site_id, {a} AS sx, {b} AS sy, {c} AS tx, {d} AS ty FROM nm" for (a, b), (c, d) in zip(_AT_BORDER, _AT_BORDER[1:] + _AT_BORDER[:1], strict=True)) + ")"
query("mesh6_concave_hull", f"""{_with(_C1, _TRI, _NOTCH, _RING, recursive=True)}, se AS (SELECT DISTINCT sd.site_id, sd.u, sd.v, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM sd JOIN v a ON a.site_id = sd.site_id AND a.n = sd.u JOIN v b ON b.site_id = sd.site_id AND b.n = sd.v),
sc AS MATERIALIZED (SELECT DISTINCT se.site_id, u, v FROM se JOIN bd ON bd.site_id = se.site_id WHERE {_meet('u', 'v', 's', 't')}),
ts AS MATERIALIZED (SELECT site_id, u, v, list_sort([u, v, w]) AS k FROM sd), hs AS (SELECT site_id, u, v FROM sd GROUP BY site_id, u, v HAVING count(*) = 1),
op AS MATERIALIZED (SELECT ts.* FROM ts JOIN sc ON sc.site_id = ts.site_id AND sc.u = ts.u AND sc.v = ts.v),
pe AS (SELECT op.site_id, op.k FROM op JOIN hs ON hs.site_id = op.site_id AND hs.u = op.u AND hs.v = op.v
  UNION SELECT o.site_id, o.k FROM pe JOIN op s ON s.site_id = pe.site_id AND s.k = pe.k JOIN op o ON o.site_id = s.site_id AND o.u = s.u AND o.v = s.v)
SELECT site_id, u, v FROM ts WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.site_id = ts.site_id AND pe.k = ts.k) GROUP BY site_id, u, v HAVING count(*) = 1""")(
    lambda spark, v, d: obstacles.concave_hull(mesh.triangles(v), v, polygons.notched_border(v))
)


# Stored lengths against those of the stored parents: every third site's was made longer by a hundredth.
def _mismatched(spark: SparkSession, v: DataFrame) -> DataFrame:
    path = store.folder(spark)
    routes = store.route_sets(trees.seed_forest(v), v, 5, "seed", {"seed": "1", "author": "test"})
    store.add_absent(spark, store.node_sets(v), f"{path}/nodesets", ["digest"])
    store.add_absent(spark, routes.withColumn("length", F.when(F.col("site_id") % 3 == 0, F.col("length") + F.floor(F.col("length") / 100)).otherwise(F.col("length"))), f"{path}/routesets", ["nodes", "method", "capacity"])
    return store.mismatched(store.load(spark, path), v).select("site_id", "length", "found", "differs", "misc")


query("src20_length_mismatch", f"""{_LOADS}, s AS (SELECT site_id, CAST(sum(length) AS BIGINT) AS found FROM len GROUP BY site_id) SELECT site_id, CASE WHEN site_id % 3 = 0 THEN found + found // 100 ELSE found END AS length, found, site_id % 3 = 0 AS differs, '{{"author": "test", "seed": "1"}}' AS misc FROM s""")(lambda spark, v, d: _mismatched(spark, v))


# The hull once flat triangles at the rim have gone.
_FLAT = 6.0
_SIDE2 = "({0}x - {1}x) * ({0}x - {1}x) + ({0}y - {1}y) * ({0}y - {1}y)"
query("mesh4_pruned_hull", f"""{_with(_C1, _TRI, recursive=True)}, fl AS MATERIALIZED (SELECT t.site_id, [a.n, b.n, c.n] AS k FROM tri t JOIN v a ON a.site_id = t.site_id AND a.n = t.a JOIN v b ON b.site_id = t.site_id AND b.n = t.b JOIN v c ON c.site_id = t.site_id AND c.n = t.c
  WHERE greatest({_SIDE2.format('a.', 'b.')}, {_SIDE2.format('b.', 'c.')}, {_SIDE2.format('c.', 'a.')}) * {3**0.5 / 2!r}::DOUBLE > {_FLAT} * abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))),
hs AS (SELECT site_id, u, v FROM sd GROUP BY site_id, u, v HAVING count(*) = 1), ts AS MATERIALIZED (SELECT site_id, u, v, list_sort([u, v, w]) AS k FROM sd),
op AS MATERIALIZED (SELECT ts.* FROM ts JOIN fl ON fl.site_id = ts.site_id AND list_sort(fl.k) = ts.k),
pe AS (SELECT op.site_id, op.k FROM op JOIN hs ON hs.site_id = op.site_id AND hs.u = op.u AND hs.v = op.v
  UNION SELECT o.site_id, o.k FROM pe JOIN op s ON s.site_id = pe.site_id AND s.k = pe.k JOIN op o ON o.site_id = s.site_id AND o.u = s.u AND o.v = s.v)
SELECT site_id, u, v FROM ts WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.site_id = ts.site_id AND pe.k = ts.k) GROUP BY site_id, u, v HAVING count(*) = 1""")(
    lambda spark, v, d: mesh.hull_edges(mesh.pruned(mesh.triangles(v), v, _FLAT))
)

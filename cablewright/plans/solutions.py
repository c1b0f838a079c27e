"""Registered queries about solutions: the heuristics row by row, exact and bounded costs, gates and detours.

The savings heuristics are stated a second time in SQL (`_savings`): a recursive query whose state is, for
each instance, the subtree of every terminal, each subtree's tail, and the edges used. One step lists all
edges between subtrees that may be merged, lets each subtree choose one by its method's rule, and makes
the merge of the least tradeoff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mesh, sets, solvers, trees
from ..sources.store import work_table
from . import flagship
from .catalogue import _ANC, _BASE, _C1, _FOREST, _PAIRS, _PTS, _TRI, _TWO, _meet, _with, query

CAPACITIES = (3, 5, 8)
_AVAILABLE = "av AS (SELECT DISTINCT site_id, u, v FROM sd UNION SELECT site_id, s, t FROM dg)"
_COMPLETE = "av AS (SELECT a.site_id, a.n AS u, b.n AS v FROM v a JOIN v b ON a.site_id = b.site_id AND a.n < b.n AND a.n >= 0)"


def _savings(method: str, capacities) -> tuple[str, ...]:
    """The parts of a query whose last, wk, has site_id, capacity, n and parent."""
    rule = {"uncrossed": True, "gates_block": False, "path": False, "rootlust": 0.0} | solvers.SAVINGS[method]
    kept = "k.w <= 1.02 * k.least" if rule["rule"] == "margin" else "true"
    order = {"weight": "w, od", "margin": "od, w", "bins": "round_even(20 * w / least, 0), od, w"}[rule["rule"]]
    none = "SELECT e, [0::BIGINT] AS {} FROM ed WHERE false"
    met = f"""SELECT p.e, list(q.e) AS met FROM ed p
  JOIN (SELECT e, site_id, u AS s, v AS t, ux AS sx, uy AS sy, vx AS tx, vy AS ty FROM ed) q ON p.site_id = q.site_id
  WHERE {_meet('u', 'v', 's', 't')} GROUP BY p.e"""
    held = f"SELECT e, list(gt.n) AS held FROM ed JOIN gt USING (site_id) WHERE {_meet('u', 'v', 's', 't')} GROUP BY e"
    ends = "AND (hg.u = comp[hg.u + 1] OR hg.u = tail[comp[hg.u + 1] + 1]) AND hg.v = tail[comp[hg.v + 1] + 1]" if rule["path"] else ""
    blocked = "AND len(list_filter(hg.held, lambda x: comp[x + 1] = x AND len(list_filter(comp, lambda y: y = x)) = capacity)) = 0" if rule["gates_block"] else ""
    lust = rule["rootlust"]
    edges = (_TRI, _TWO, _AVAILABLE) if rule["uncrossed"] else (_COMPLETE,)
    return (
        *_BASE,
        *edges,
        """ed AS (SELECT row_number() OVER (ORDER BY av.site_id, av.u, av.v) AS e, av.site_id, av.u, av.v, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy,
    sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS w
  FROM av JOIN v a ON a.site_id = av.site_id AND a.n = av.u JOIN v b ON b.site_id = av.site_id AND b.n = av.v WHERE av.u >= 0)""",
        "gt AS (SELECT d.site_id, d.n, d.root, sqrt(CAST(d.d2 AS DOUBLE)) AS g, d.x AS sx, d.y AS sy, d.rx AS tx, d.ry AS ty FROM d JOIN near USING (site_id, n, root))",
        f"cx AS ({met if rule['uncrossed'] else none.format('met')})",
        f"gx AS ({held if rule['gates_block'] else none.format('held')})",
        """hg AS (SELECT q.e, q.site_id, q.u, q.v, q.w, least(q.u, q.v) AS a, greatest(q.u, q.v) AS b, coalesce(met, []) AS met, coalesce(held, []) AS held, gt.g AS od
  FROM (SELECT e, site_id, u, v, w FROM ed UNION ALL SELECT e, site_id, v, u, w FROM ed) q
  LEFT JOIN cx ON cx.e = q.e LEFT JOIN gx ON gx.e = q.e JOIN gt ON gt.site_id = q.site_id AND gt.n = q.v)""",
        f"""rec AS (SELECT site_id, capacity, 0 AS step, list(n ORDER BY n) AS comp, list(n ORDER BY n) AS tail, list(g ORDER BY n) AS gates, []::BIGINT[] AS used
  FROM gt, (VALUES {', '.join(f'({c})' for c in capacities)}) c(capacity) GROUP BY site_id, capacity
  UNION ALL SELECT site_id, capacity, step + 1, list_transform(comp, lambda x: CASE WHEN x = h THEN o ELSE x END),
    list_transform(range(len(tail)), lambda i: CASE WHEN i = o THEN CASE WHEN u = h THEN tail[h + 1] ELSE h END ELSE tail[i + 1] END), gates, list_append(used, e)
  FROM (SELECT *, row_number() OVER (PARTITION BY site_id, capacity ORDER BY t, a, b, h) AS z FROM (
    SELECT *, w - gates[h + 1] * (1 + {lust} * own / capacity) AS t, row_number() OVER (PARTITION BY site_id, capacity, h ORDER BY {order}, a, b, u) AS y FROM (
      SELECT *, min(w) OVER (PARTITION BY site_id, capacity, h) AS least FROM (
        SELECT r.*, hg.e, hg.u, hg.w, hg.a, hg.b, hg.od, comp[hg.u + 1] AS h, comp[hg.v + 1] AS o, len(list_filter(comp, lambda x: x = comp[hg.u + 1])) AS own
        FROM rec r JOIN hg ON hg.site_id = r.site_id
        WHERE comp[hg.u + 1] <> comp[hg.v + 1] AND hg.w <= gates[comp[hg.u + 1] + 1] * (1 + {lust}) AND NOT list_has_any(used, hg.met)
          AND len(list_filter(comp, lambda x: x = comp[hg.u + 1] OR x = comp[hg.v + 1])) <= capacity {ends} {blocked}
      ) q) k WHERE {kept}) k WHERE y = 1 AND t <= 0) k WHERE z = 1)""",
        "fin AS (SELECT site_id, capacity, arg_max(comp, step) AS comp, arg_max(used, step) AS used FROM rec GROUP BY site_id, capacity)",
        "lk AS (SELECT f.site_id, f.capacity, hg.u, hg.v FROM (SELECT site_id, capacity, unnest(used) AS e FROM fin) f JOIN hg ON hg.e = f.e)",
        """wk AS (SELECT site_id, capacity, h AS n, root AS parent FROM (SELECT DISTINCT site_id, capacity, unnest(comp) AS h FROM fin) q JOIN gt USING (site_id) WHERE gt.n = h
  UNION ALL SELECT lk.site_id, lk.capacity, lk.v, lk.u FROM wk JOIN lk ON lk.site_id = wk.site_id AND lk.capacity = wk.capacity AND lk.u = wk.n AND lk.v <> wk.parent)""",
    )


#: Loads and lengths of wk's links.
_PRICED = (
    """up AS (SELECT site_id, capacity, n AS node, parent FROM wk
  UNION ALL SELECT up.site_id, up.capacity, wk.n, wk.parent FROM up JOIN wk ON wk.site_id = up.site_id AND wk.capacity = up.capacity AND wk.n = up.parent)""",
    "lo AS (SELECT site_id, capacity, node AS n, parent, count(*) AS load FROM up GROUP BY ALL)",
    """pc AS (SELECT lo.*, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS w, CAST(round(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) * 1000) AS BIGINT) AS length
  FROM lo JOIN v a ON a.site_id = lo.site_id AND a.n = lo.n JOIN v b ON b.site_id = lo.site_id AND b.n = lo.parent)""",
    f"cb(cable, most, cost) AS (VALUES {', '.join(map(str, flagship.CABLES))})",
)
_COSTS = "SELECT site_id, {} count(*) AS terminals, count(*) FILTER (WHERE parent < 0) AS gates, CAST(sum(length) AS BIGINT) AS length, CAST(sum(length * (SELECT min(cost) FROM cb WHERE most >= load)) AS BIGINT) AS cost FROM pc GROUP BY site_id, capacity"

for _name, _method in (("ew1_presolver", "presolver"), ("ew2_classic", "classic"), ("ew3_crossing_preventing", "crossing_preventing"), ("ew4_non_branching", "non_branching"), ("ew5_obstacle_bypassing", "obstacle_bypassing")):
    query(_name, f"{_with(*_savings(_method, CAPACITIES), recursive=True)} SELECT site_id, capacity, n, parent FROM wk")(
        lambda spark, v, d, m=_method: solvers.solve(v, [m], list(CAPACITIES)).select("site_id", "capacity", "n", "parent")
    )

query("flagship_route_costs", f"{_with(*_savings('presolver', (5, 8)), *_PRICED, recursive=True)} {_COSTS.format('CAST(capacity AS BIGINT) AS capacity,')}")(lambda spark, v, d: flagship.route_costs(spark, d))
query("ew7_costs", f"{_with(*_savings('non_branching', (5,)), *_PRICED, recursive=True)} {_COSTS.format('')}")(lambda spark, v, d: flagship.route_costs(spark, d, (5,), "non_branching").drop("capacity"))


# Minimum spanning forests: an edge belongs to it unless shorter edges join its ends, all roots being one node.
_MSF = (
    """ms AS (SELECT DISTINCT sd.site_id, sd.u, sd.v, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS l2, greatest(sd.u, -1) AS p, sd.v AS q
  FROM sd JOIN v a ON a.site_id = sd.site_id AND a.n = sd.u JOIN v b ON b.site_id = sd.site_id AND b.n = sd.v WHERE sd.v >= 0)""",
    "mb AS (SELECT site_id, u, v, l2, p, q FROM ms UNION ALL SELECT site_id, u, v, l2, q, p FROM ms)",
    """mr AS (SELECT site_id, u, v, l2, p AS k FROM ms UNION
  SELECT mr.site_id, mr.u, mr.v, mr.l2, mb.q FROM mr JOIN mb ON mb.site_id = mr.site_id AND mb.p = mr.k AND (mb.l2, mb.u, mb.v) < (mr.l2, mr.u, mr.v))""",
    "mf AS (SELECT site_id, u, v, l2 FROM ms WHERE NOT EXISTS (SELECT 1 FROM mr WHERE mr.site_id = ms.site_id AND mr.u = ms.u AND mr.v = ms.v AND mr.k = ms.q))",
)
query("gr1_spanning_forest", f"{_with(_C1, _TRI, *_MSF, recursive=True)} SELECT site_id, u, v, l2 FROM mf")(lambda spark, v, d: mesh.spanning_forest(v))
query("agg12_gap", f"{_with(*_savings('presolver', CAPACITIES), *_PRICED, *_MSF, recursive=True)}, lb AS (SELECT site_id, sum(sqrt(CAST(l2 AS DOUBLE))) AS bound FROM mf GROUP BY site_id) SELECT site_id, capacity, round(bound, 3) AS bound, round(sum(w), 3) AS objective, round(1 - bound / sum(w), 6) AS gap FROM pc JOIN lb USING (site_id) GROUP BY site_id, capacity, bound")(lambda spark, v, d: solvers.gaps(solvers.solve(v, ["presolver"], list(CAPACITIES)), v).drop("method"))


# The least cost of every six terminals of a site: all partitions into sets within the capacity, each with its least tree.
_SIX = (
    "t6 AS (SELECT v.site_id, v.n // 6 AS k, CAST(v.n % 6 AS INTEGER) AS p, v.x, v.y, sqrt(CAST(near.d2 AS DOUBLE)) AS g FROM v JOIN near USING (site_id, n))",
    "h6 AS (SELECT a.site_id, a.k, a.p, b.p AS q, a.g AS g, b.g AS f, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS w FROM t6 a JOIN t6 b ON a.site_id = b.site_id AND a.k = b.k AND a.p < b.p)",
    """s6 AS (SELECT site_id, k, 1 << p AS mask, 1 AS size, g AS cost FROM t6
  UNION ALL SELECT site_id, k, (1 << p) | (1 << q), 2, w + least(g, f) FROM h6
  UNION ALL SELECT a.site_id, a.k, (1 << a.p) | (1 << a.q) | (1 << b.q), 3, a.w + b.w + c.w - greatest(a.w, b.w, c.w) + least(a.g, a.f, b.f)
    FROM h6 a JOIN h6 b ON a.site_id = b.site_id AND a.k = b.k AND a.q = b.p JOIN h6 c ON a.site_id = c.site_id AND a.k = c.k AND a.p = c.p AND b.q = c.q)""",
    """p6 AS (SELECT site_id, k, capacity, CAST(sum(1 << p) AS INTEGER) AS rest, CAST(0 AS DOUBLE) AS cost FROM t6, (VALUES (2), (3)) c(capacity) GROUP BY site_id, k, capacity
  UNION ALL SELECT p6.site_id, p6.k, capacity, rest - mask, p6.cost + s6.cost FROM p6 JOIN s6 ON s6.site_id = p6.site_id AND s6.k = p6.k AND size <= capacity AND (rest & mask) = mask AND (mask & (rest & -rest)) <> 0 WHERE rest > 0)""",
)
query("ml1_exact_small", f"{_with(*_BASE, *_SIX, recursive=True)} SELECT site_id, k, capacity, round(min(cost), 3) AS cost FROM p6 WHERE rest = 0 GROUP BY site_id, k, capacity")(lambda spark, v, d: _exact(v, "exact", [2, 3]))
_POWER = [x.replace("1 AS size, g AS cost FROM t6", "h AS size, g AS cost FROM t6").replace("2, w + least(g, f)", "h + j, w + least(g, f)").replace("3, a.w + b.w", "a.h + a.j + b.j, a.w + b.w") for x in _SIX]
_POWER[0] = _POWER[0].replace("v.x, v.y", "v.x, v.y, CASE WHEN n % 7 = 0 THEN 3 ELSE 1 END AS h")
_POWER[1] = _POWER[1].replace("a.g AS g", "a.h AS h, b.h AS j, a.g AS g")
query("ml1_exact_power", f"{_with(*_BASE, *_POWER, recursive=True)} SELECT site_id, k, capacity, round(min(cost), 3) AS cost FROM p6 WHERE rest = 0 AND capacity = 3 GROUP BY site_id, k, capacity")(lambda spark, v, d: _exact(v.withColumn("power", F.when(F.col("n") % 7 == 0, 3)), "exact_power", [3]))
_GATES = [x.replace("CAST(0 AS DOUBLE) AS cost", "CAST(0 AS DOUBLE) AS cost, 0 AS gates, count(*) AS t").replace("p6.cost + s6.cost", "p6.cost + s6.cost, gates + 1, t") for x in _SIX]
query("ml1_least_gates", f"{_with(*_BASE, *_GATES, recursive=True)} SELECT site_id, k, capacity, round(min(cost), 3) AS cost FROM p6 WHERE rest = 0 AND gates <= ceil(t / CAST(capacity AS DOUBLE)) GROUP BY site_id, k, capacity")(lambda spark, v, d: _exact(v, "exact_least_gates", [2, 3]))


def _exact(v: DataFrame, method: str = "exact", capacities=(2, 3)) -> DataFrame:
    """The cost of the exact forest of each six terminals of a site, with all its roots."""
    sets_of = v.filter("n >= 0").select("site_id", F.floor(F.col("n") / 6).alias("k")).distinct()
    small = v.join(sets_of, "site_id").filter("n < 0 OR floor(n / 6) = k").select((F.col("site_id") * (1 << 20) + F.col("k")).alias("site_id"), "n", "x", "y", *[c for c in v.columns if c == "power"])
    s = solvers.costs(solvers.solve(small, [method], list(capacities)), small)
    return s.select(F.floor(F.col("site_id") / (1 << 20)).alias("site_id"), (F.col("site_id") % (1 << 20)).alias("k"), "capacity", F.round("cost", 3).alias("cost"))


# Gates that cross links. Gates to nearest roots don't cross each other.
_CROSSED = f"""gl AS (SELECT g.site_id, g.capacity, g.n, g.parent, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM wk g JOIN v a ON a.site_id = g.site_id AND a.n = g.n JOIN v b ON b.site_id = g.site_id AND b.n = g.parent WHERE g.parent < 0),
ll AS (SELECT g.site_id, g.capacity, a.x AS sx, a.y AS sy, b.x AS tx, b.y AS ty FROM wk g JOIN v a ON a.site_id = g.site_id AND a.n = g.n JOIN v b ON b.site_id = g.site_id AND b.n = g.parent WHERE g.parent >= 0),
xg AS (SELECT DISTINCT gl.site_id, gl.capacity, n, parent FROM gl JOIN ll ON ll.site_id = gl.site_id AND ll.capacity = gl.capacity WHERE {_meet('u', 'v', 's', 't')})"""
query("pf2_detours", f"{_with(*_savings('presolver', (5,)), _CROSSED, recursive=True)} SELECT site_id, count(*) AS gates, (SELECT count(*) FROM xg WHERE xg.site_id = gl.site_id) AS tentative, CAST(0 AS BIGINT) AS crossings FROM gl GROUP BY site_id")(lambda spark, v, d: solvers.route_detours(solvers.solve(v, ["presolver"], [5]), v).select("site_id", "gates", "tentative", "crossings"))
query("gr4_undetoured", f"{_with(*_savings('presolver', (5,)), _CROSSED, recursive=True)} SELECT site_id, n, parent FROM xg")(lambda spark, v, d: solvers.undetoured(solvers.ways(solvers.solve(v, ["presolver"], [5]), v)).select("site_id", "n", "parent"))
_KINDS = "ak AS (SELECT DISTINCT site_id, u, v, 'delaunay' AS kind FROM sd UNION ALL SELECT site_id, s, t, 'extended' FROM dg)"
query("gr2_routeset", f"{_with(*_savings('presolver', (5,)), _CROSSED, _KINDS, recursive=True)} SELECT wk.site_id, wk.n, wk.parent, CASE WHEN wk.parent >= 0 THEN coalesce(kind, 'rogue') WHEN xg.n IS NOT NULL THEN 'tentative' ELSE 'gate' END AS kind FROM wk LEFT JOIN ak ON ak.site_id = wk.site_id AND ak.u = least(wk.n, wk.parent) AND ak.v = greatest(wk.n, wk.parent) LEFT JOIN xg ON xg.site_id = wk.site_id AND xg.n = wk.n")(lambda spark, v, d: _routeset(v))
query("mesh15_flipped", f"""{_with(*_savings('presolver', (5,)), recursive=True)}, us AS (SELECT DISTINCT dg.* FROM dg JOIN wk ON wk.site_id = dg.site_id AND dg.s = least(wk.n, wk.parent) AND dg.t = greatest(wk.n, wk.parent) AND wk.parent >= 0),
nw AS (SELECT site_id, list_sort([s, t, u]) AS k FROM us UNION ALL SELECT site_id, list_sort([s, t, v]) FROM us UNION ALL SELECT site_id, [a, b, c] FROM tri WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.site_id = tri.site_id AND us.u IN (a, b, c) AND us.v IN (a, b, c) AND (us.s IN (a, b, c) OR us.t IN (a, b, c))))
SELECT site_id, k[1] AS a, k[2] AS b, k[3] AS c FROM nw""")(lambda spark, v, d: _flipped(v))


def _routeset(v: DataFrame) -> DataFrame:
    s = work_table(solvers.solve(v, ["presolver"], [5]), "solution")  # read three times
    return sets.routeset(s.select("site_id", "n", "parent"), mesh.available_edges(mesh.triangles(v), v), solvers.crossed_gates(s, v))


def _flipped(v: DataFrame) -> DataFrame:
    t = mesh.triangles(v)
    links = work_table(solvers.solve(v, ["presolver"], [5]), "solution").filter("parent >= 0").select("site_id", F.col("n").alias("u"), F.col("parent").alias("v"))
    return mesh.flipped(t, mesh.diagonals(t, v), links)


query("pf2_routeset")(lambda spark, v, d: solvers.routesets(solvers.solve(v, ["presolver"], [5]), v))


# Shortest ways over the mesh's sides: rounds in which each point takes the best of its neighbours.
_WAYS = (
    """ss AS (SELECT DISTINCT q.site_id, q.u, q.v, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS w FROM (SELECT site_id, u, v FROM sd UNION SELECT site_id, v, u FROM sd) q
  JOIN v a ON a.site_id = q.site_id AND a.n = q.u JOIN v b ON b.site_id = q.site_id AND b.n = q.v UNION ALL SELECT site_id, n, n, 0.0 FROM v)""",
    """rd AS (SELECT site_id, n AS root, n, CAST(0 AS DOUBLE) AS d, 0 AS k FROM v WHERE n < 0
  UNION ALL SELECT site_id, root, m, min(d), k + 1 FROM (SELECT rd.site_id, rd.root, ss.v AS m, rd.d + ss.w AS d, rd.k FROM rd JOIN ss ON ss.site_id = rd.site_id AND ss.u = rd.n WHERE rd.k < 60) q GROUP BY site_id, root, m, k)""",
    "rf AS (SELECT site_id, root, n, min(d) AS d FROM rd GROUP BY site_id, root, n)",
)
query("mesh12_root_distances", f"{_with(_C1, _TRI, *_WAYS, recursive=True)} SELECT site_id, n, root, CAST(round(d * 1000) AS BIGINT) AS length FROM rf WHERE n >= 0")(lambda spark, v, d: mesh.root_distances(mesh.triangles(v), v))
query("pf3_best_paths", f"{_with(_C1, _TRI, *_WAYS, recursive=True)}, rn AS (SELECT site_id, n, arg_min(root, (round(d * 1000), root)) AS root, CAST(min(round(d * 1000)) AS BIGINT) AS length FROM rf WHERE n >= 0 GROUP BY site_id, n) SELECT rn.site_id, rn.n, rn.root, rn.length, arg_min(ss.v, (round((ss.w + rf.d) * 1000), ss.v)) AS step FROM rn JOIN ss ON ss.site_id = rn.site_id AND ss.u = rn.n AND ss.v <> rn.n JOIN rf ON rf.site_id = rn.site_id AND rf.root = rn.root AND rf.n = ss.v GROUP BY ALL")(lambda spark, v, d: mesh.best_paths(mesh.triangles(v), v))

_AVP = f"{_AVAILABLE}, {_PAIRS.format('av')}, {_PTS.replace('p4 AS', 'p5 AS').format('pr')}, ex AS (SELECT site_id, u, v, s, t FROM p5 WHERE {_meet('u', 'v', 's', 't')})"
query("mesh1_build", f"""{_with(_C1, _TRI, _TWO, _AVP, *_WAYS, recursive=True)}, ak AS (SELECT DISTINCT site_id, u, v, 'delaunay' AS kind FROM sd UNION ALL SELECT site_id, s, t, 'extended' FROM dg)
SELECT site_id, 'triangle' AS kind, a, b, c, CAST(NULL AS BIGINT) AS value FROM tri
UNION ALL SELECT ak.site_id, kind, u, v, NULL, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) FROM ak JOIN v a ON a.site_id = ak.site_id AND a.n = ak.u JOIN v b ON b.site_id = ak.site_id AND b.n = ak.v
UNION ALL SELECT site_id, 'hull', u, v, NULL, NULL FROM sd GROUP BY site_id, u, v HAVING count(*) = 1
UNION ALL SELECT site_id, 'exclusive', u, v, s, t FROM ex
UNION ALL SELECT site_id, 'way', n, root, NULL, CAST(round(d * 1000) AS BIGINT) FROM rf WHERE n >= 0""")(lambda spark, v, d: mesh.build(v))

# Subtrees fed from their node nearest to the root: links between the old hook and the new one turn round.
_HOOKS = "hk AS (SELECT site_id, root, subtree, hook FROM (SELECT l.site_id, l.root, l.subtree, l.n AS hook, row_number() OVER (PARTITION BY l.site_id, l.root, l.subtree ORDER BY d.d2, l.n) AS k FROM l JOIN d ON d.site_id = l.site_id AND d.n = l.n AND d.root = l.root) q WHERE k = 1)"
query("gr5_rehooked", f"""{_with(*_BASE, _FOREST, _ANC, _HOOKS, recursive=True)}, pt AS (SELECT a.site_id, a.node, a.parent FROM anc a JOIN hk ON hk.site_id = a.site_id AND hk.hook = a.leaf),
np AS (SELECT site_id, n, root, parent FROM f WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.site_id = f.site_id AND pt.node = f.n) UNION ALL SELECT pt.site_id, pt.parent, f.root, pt.node FROM pt JOIN f ON f.site_id = pt.site_id AND f.n = pt.node WHERE pt.parent >= 0 UNION ALL SELECT site_id, hook, root, root FROM hk),
un AS (SELECT site_id, n AS node, parent FROM np UNION ALL SELECT un.site_id, np.n, np.parent FROM un JOIN np ON np.site_id = un.site_id AND np.n = un.parent)
SELECT np.site_id, np.n, np.root, np.parent, (SELECT count(*) FROM un WHERE un.site_id = np.site_id AND un.node = np.n) AS load FROM np""")(lambda spark, v, d: trees.rehooked(trees.seed_forest(v), trees.hooked_to_nearest(trees.seed_forest(v), v)))

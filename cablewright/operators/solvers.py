"""Solvers over instances: a row of `instances` is a site, a method and a capacity, and one call of a kernel.

Instances are independent, so they spread over tasks; a site's points are sent once for each instance,
with the solution's rows beside them where there is one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .mesh import site
from .tiles import spread

#: Methods: kernel options of the savings family.
SAVINGS = {
    "presolver": {"rule": "margin"},
    "classic": {"rule": "weight", "uncrossed": False},
    "crossing_preventing": {"rule": "bins", "gates_block": True},
    "non_branching": {"rule": "bins", "path": True},
    "obstacle_bypassing": {"rule": "bins", "gates_block": True, "rootlust": 0.6},
}
ROUTES = ("routes", "routes_repaired", "routes_iterated")
SOLUTION = "site_id long, method string, capacity int, n long, parent long"


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, xy = site(pdf)
    method, capacity, where = pdf["method"].iloc[0], int(pdf["capacity"].iloc[0]), pdf["site_id"].iloc[0]
    if method == "classic":
        parent = K.classic(ids, xy, capacity)
    elif method in SAVINGS:
        parent = K.esau_williams(ids, xy, K.available(xy), capacity, **SAVINGS[method])
    elif method in ROUTES:
        routes = K.iterated_routes(ids, xy, capacity) if method == "routes_iterated" else K.savings_routes(ids, xy, capacity)
        parent = K.routes_to_parents(ids, xy, K.repair(ids, xy, routes) if method == "routes_repaired" else routes)
    elif method in ("exact", "exact_path"):
        parent = K.exact_forest(ids, xy, capacity, method == "exact")[1]
    elif method == "exact_power":
        fed = pdf[(pdf["n"] >= 0) & pdf["power"].notna()]
        parent = K.exact_forest(ids, xy, capacity, power=dict(zip(fed["n"].tolist(), fed["power"].astype(int).tolist(), strict=True)))[1]
    elif method == "exact_least_gates":
        parent = K.exact_forest(ids, xy, capacity, gates=-(-sum(i >= 0 for i in ids) // capacity))[1]
    elif method == "improved":
        parent = K.improved_forest(ids, xy, capacity, K.esau_williams(ids, xy, K.available(xy), capacity, **SAVINGS["presolver"]))
    else:
        raise ValueError(f"no method {method!r}")
    rows = [(where, method, capacity, n, p) for n, p in sorted(parent.items())]
    return pd.DataFrame(rows, columns=["site_id", "method", "capacity", "n", "parent"])


def solve(v: DataFrame, methods: list[str], capacities: list[int]) -> DataFrame:
    """The parent of each terminal under each method and capacity. exact_power reads what a terminal feeds in from v's column `power` (1 where null)."""
    if "exact_power" in methods and "power" not in v.columns:
        raise ValueError("exact_power needs a column power")
    spark: SparkSession = v.sparkSession
    grid = spark.createDataFrame([(m, c) for m in methods for c in capacities], "method string, capacity int")
    return spread(v.crossJoin(F.broadcast(grid)), "site_id", "method", "capacity").applyInPandas(_solve, SOLUTION)


def _beside(solution: DataFrame, v: DataFrame) -> DataFrame:
    """The points of each instance of the solution, with the parent of those that have one."""
    keys = ["site_id", "method", "capacity"]
    points = solution.select(*keys).distinct().join(v.select("site_id", "n", "x", "y"), "site_id")
    return spread(points.join(solution, [*keys, "n"], "left"), *keys)


def _read(pdf: pd.DataFrame):
    """(key, ids, coordinates, parents) of an instance."""
    pdf = pdf.sort_values("n")
    ids, xy = site(pdf)
    have = pdf[pdf["parent"].notna()]
    key = (int(pdf["site_id"].iloc[0]), pdf["method"].iloc[0], int(pdf["capacity"].iloc[0]))
    return key, ids, xy, dict(zip(have["n"].astype(int).tolist(), have["parent"].astype(int).tolist(), strict=True))


def check(solution: DataFrame, v: DataFrame) -> DataFrame:
    """For each instance: terminals missing, links, overloads, crossings of links with links and with gates, terminals of degree over 2, length in thousandths, gates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from .trees import loads_of

        key, ids, xy, parent = _read(pdf)
        at = {n: k for k, n in enumerate(ids)}
        loads = loads_of(parent)
        links = [(at[a], at[b]) for a, b in parent.items() if b >= 0]
        gates = [(at[a], at[b]) for a, b in parent.items() if b < 0]
        degree = pd.Series([k for a, b in parent.items() for k in (a, b) if k >= 0]).value_counts()
        total = sum(round(float(K.length(xy, at[a], at[b])) * 1000) for a, b in parent.items())
        missing = sum(i >= 0 for i in ids) - len(parent)
        row = (*key, missing, len(parent), int(sum(x[0] > key[2] for x in loads.values())), K.count_crossings(xy, links), K.count_crossings(xy, links + gates) - K.count_crossings(xy, links), int((degree > 2).sum()), total, len(gates))
        return pd.DataFrame([row], columns=["site_id", "method", "capacity", "missing", "links", "overloads", "crossings", "gate_crossings", "branchings", "length", "gates"])

    ddl = "site_id long, method string, capacity int, missing long, links long, overloads long, crossings long, gate_crossings long, branchings long, length long, gates long"
    return _beside(solution, v).applyInPandas(run, ddl)


def costs(solution: DataFrame, v: DataFrame) -> DataFrame:
    """The summed length of each instance."""
    p = v.select("site_id", "n", "x", "y")
    hop = solution.join(p, ["site_id", "n"]).join(p.select("site_id", F.col("n").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py")), ["site_id", "parent"])
    return hop.groupBy("site_id", "method", "capacity").agg(F.sum(F.sqrt(F.pow((F.col("x") - F.col("px")).cast("double"), 2) + F.pow((F.col("y") - F.col("py")).cast("double"), 2))).alias("cost"))


def gaps(solution: DataFrame, v: DataFrame) -> DataFrame:
    """The length of each instance (objective), the length of the site's minimum spanning forest, which no solution goes below (bound), and 1 - bound / objective."""
    from .mesh import spanning_forest

    bound = spanning_forest(v).groupBy("site_id").agg(F.sum(F.sqrt(F.col("l2").cast("double"))).alias("bound"))
    j = costs(solution, v).join(bound, "site_id")
    return j.select("site_id", "method", "capacity", F.round("bound", 3).alias("bound"), F.round("cost", 3).alias("objective"), F.round(1 - F.col("bound") / F.col("cost"), 6).alias("gap"))


def route_detours(solution: DataFrame, v: DataFrame) -> DataFrame:
    """For each instance: gates, those that crossed something, ways found, hooks left without, crossings left but for theirs, and the ways' extra length in thousandths."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, ids, xy, parent = _read(pdf)
        at = {n: k for k, n in enumerate(ids)}
        ways, failed = K.detours(ids, xy, parent)
        after = [(at[a], at[b]) for a, b, _, _ in K.rerouted(ids, parent, ways) if a not in failed or b >= 0]
        size = lambda w: sum(float(K.length(xy, at[a], at[b])) for a, b in zip(w, w[1:], strict=False))
        extra = sum(size(w) - float(K.length(xy, at[a], at[parent[a]])) for a, w in ways.items())
        gates = sum(b < 0 for b in parent.values())
        row = (*key, gates, len(ways) + len(failed), len(ways), len(failed), K.count_crossings(xy, after), round(extra * 1000))
        return pd.DataFrame([row], columns=["site_id", "method", "capacity", "gates", "tentative", "detoured", "failed", "crossings", "extra"])

    ddl = "site_id long, method string, capacity int, gates long, tentative long, detoured long, failed long, crossings long, extra long"
    return _beside(solution, v).applyInPandas(run, ddl)


def routesets(solution: DataFrame, v: DataFrame) -> DataFrame:
    """The hops of each instance with its detours made: n, parent, load, kind (link, gate, detour, or tentative for a gate left without a way)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, ids, xy, parent = _read(pdf)
        ways, failed = K.detours(ids, xy, parent)
        rows = [(*key, a, b, load, "tentative" if kind == "gate" and a in failed else kind) for a, b, load, kind in K.rerouted(ids, parent, ways)]
        return pd.DataFrame(rows, columns=["site_id", "method", "capacity", "n", "parent", "load", "kind"])

    return _beside(solution, v).applyInPandas(run, "site_id long, method string, capacity int, n long, parent long, load long, kind string")


def crossed_gates(solution: DataFrame, v: DataFrame) -> DataFrame:
    """Gates of each instance that cross one of its links: site_id, method, capacity, n, parent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, ids, xy, parent = _read(pdf)
        at = {n: k for k, n in enumerate(ids)}
        gates = [(a, b) for a, b in parent.items() if b < 0]
        hit = K.crossed(xy, np.array([(at[a], at[b]) for a, b in gates], int).reshape(-1, 2), [(at[a], at[b]) for a, b in parent.items() if b >= 0])
        return pd.DataFrame([(*key, *g) for g, h in zip(gates, hit.tolist(), strict=True) if h], columns=["site_id", "method", "capacity", "n", "parent"])

    return _beside(solution, v).applyInPandas(run, SOLUTION)


def ways(solution: DataFrame, v: DataFrame) -> DataFrame:
    """The ways found for gates that crossed something: a row (instance, hook, nodes from the subtree to the root) for each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, ids, xy, parent = _read(pdf)
        found, _ = K.detours(ids, xy, parent)
        return pd.DataFrame([(*key, a, w) for a, w in sorted(found.items())], columns=["site_id", "method", "capacity", "hook", "nodes"])

    return _beside(solution, v).applyInPandas(run, "site_id long, method string, capacity int, hook long, nodes array<long>")


def undetoured(found: DataFrame) -> DataFrame:
    """The straight gates that the ways stand for."""
    return found.select("site_id", "method", "capacity", F.col("hook").alias("n"), F.element_at("nodes", -1).alias("parent"))


def pool_choice(solution: DataFrame, v: DataFrame) -> DataFrame:
    """Of each site's and capacity's solutions, the one whose length with detours is least; those with gates left without a way come last."""
    length = check(solution, v).select("site_id", "method", "capacity", "length")
    extra = route_detours(solution, v).select("site_id", "method", "capacity", "failed", "extra")
    rated = length.join(extra, ["site_id", "method", "capacity"])
    best = F.min(F.struct("failed", (F.col("length") + F.col("extra")).alias("total"), "method")).alias("b")
    return rated.groupBy("site_id", "capacity").agg(best, F.count("*").alias("pool")).select("site_id", "capacity", F.col("b.method").alias("method"), F.col("b.total").alias("length"), F.col("b.failed").alias("failed"), "pool")

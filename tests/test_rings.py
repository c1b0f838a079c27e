"""Searches by cells and by buckets of ranks against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cablewright.operators import joins, trees


def _site(kind, n=160):
    r = np.random.default_rng(8)
    if kind == "crowd and strays":
        p = np.concatenate([r.normal(0, 9, (n, 2)), r.normal(0, 20000, (12, 2))]).round()
    elif kind == "line":
        p = np.array([(7 * k, 0) for k in range(n)])
    else:
        p = r.integers(0, 3000, (n, 2))
    p = np.unique(p.astype(int), axis=0)
    r.shuffle(p)
    return pd.DataFrame({"site_id": 3, "n": range(-2, len(p) - 2), "x": p[:, 0], "y": p[:, 1]})


@pytest.mark.parametrize("kind", ["crowd and strays", "line"])
def test_nearest_of_a_crowd(spark, kind):
    pdf = _site(kind)
    more = pd.DataFrame([(4, -1, 0, 0), (5, -1, 0, 0), (5, 0, 9, 9)], columns=pdf.columns)
    v = spark.createDataFrame(pd.concat([pdf, more]))
    xy, ids = pdf[["x", "y"]].to_numpy(), pdf["n"].to_numpy()
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    want = {(5, -1, 0, 162)}
    for a in range(len(ids)):
        for b in sorted((b for b in range(len(ids)) if b != a), key=lambda b: (d2[a, b], ids[b]))[:4]:
            want.add((3, *sorted((int(ids[a]), int(ids[b]))), int(d2[a, b])))
    assert {tuple(r) for r in joins.knn_edges(v).collect()} == want
    own = lambda b: min((d2[b, c], ids[c]) for c in range(len(ids)) if ids[c] < 0)[1]
    forest = {r.n: (r.root, r.parent, r.l2) for r in trees.seed_forest(v).filter("site_id = 3").collect()}
    for a in range(len(ids)):
        if ids[a] >= 0:
            root = own(a)
            far = lambda b, root=root: d2[b, list(ids).index(root)]
            best = min([(d2[a, list(ids).index(root)], root)] + [(d2[a, b], ids[b]) for b in range(len(ids)) if ids[b] >= 0 and own(b) == root and far(b) < far(a)])
            assert forest[int(ids[a])] == (root, best[1], best[0])


def test_gates_by_buckets_of_ranks(spark, monkeypatch):
    pdf = _site("even")
    v = spark.createDataFrame(pdf)
    edges = joins.knn_edges(v).select("site_id", "u", "v")
    gates = v.filter("n >= 0").select("site_id", "n", F.explode(F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"))).alias("root"))
    found = []
    for buckets in (1, 5, 1024):
        monkeypatch.setattr(joins, "BUCKETS", buckets)
        rows = [tuple(r) for r in joins.gate_crossings(gates, edges, v).collect()]
        assert len(rows) == len(set(rows))
        found.append(set(rows))
    assert found[0] == found[1] == found[2] and found[0]


def test_poisson_disc_takes_candidates_as_if_one_by_one(spark, monkeypatch):
    from cablewright.sources import synthetic

    monkeypatch.setattr(synthetic, "FIRST", 16)
    ring = [(0, 0), (900, 0), (900, 900), (0, 900)]
    rows = [(s, 0, k, x, y + 5000 * s) for s in (1, 2) for k, (x, y) in enumerate(ring)]
    borders = spark.createDataFrame(rows, "site_id long, poly_id int, seq int, x long, y long")
    away = spark.createDataFrame([(1, 450, 5450)], "site_id long, x long, y long")
    for count in (5, 500):
        got = {tuple(r) for r in synthetic.poisson_disc(borders, away, count, 150, 200, tries=60 // count + 1).collect()}
        want = set()
        all_ = sorted(map(tuple, synthetic.candidates(borders, 0, count * (60 // count + 1), 1).collect()))
        for site in (1, 2):
            mine = []
            for s, n, x, y in all_:
                far = site == 2 or (x - 450) ** 2 + (y - 5450) ** 2 >= 200**2
                if s == site and len(mine) < count and far and all((x - a) ** 2 + (y - b) ** 2 >= 150**2 for _, a, b in mine):
                    mine.append((n, x, y))
            want |= {(site, *p) for p in mine}
        assert got == want

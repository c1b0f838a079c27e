"""Vector codes against plain loops over whole numbers, and the tree against all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from cablewright.llm import vectors


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, lab, [math.floor(scale * float(x)) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(kept[0][2]) if kept else 0
    width = -(-size // parts)
    cut = lambda v: [(v + [0] * (-size % parts))[p * width : (p + 1) * width] for p in range(parts)]
    fit = [(i, lab, cut(v)) for i, lab, v in kept if len(v) == size]
    books = [[r[2][p] for r in fit[:entries]] for p in range(parts)]
    nearest = lambda u, b: min((sum((x - y) ** 2 for x, y in zip(u, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            to = {}
            for r in fit:
                to.setdefault(nearest(r[2][p], books[p])[1], []).append(r[2][p])
            for k, us in to.items():
                books[p][k] = [sum(c) // len(us) for c in zip(*us, strict=True)]
    coded = [(i, lab, *zip(*(nearest(u, b) for u, b in zip(us, books, strict=True)), strict=True)) for i, lab, us in fit]
    coded = [(i, lab, "".join(f"{k:02x}" for k in ks), sum(ds)) for i, lab, ds, ks in coded] + [(i, lab, None, None) for i, lab, v in kept if len(v) != size]
    total = {}
    for _, lab, _, e in coded:
        if e is not None:
            total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, total.get(lab), sha) for i, lab, c, e in coded), key=str)


def _rows(size, n):
    rng = random.Random(size)
    rows = [(k * 3 % n - 5, rng.choice((0, 1, 1, None)), [rng.choice((rng.uniform(-1, 1), 0.25, -0.5)) for _ in range(size)]) for k in range(n)]
    rows += [(7, 1, None), (8, 1, [None] * size), (9, None, [math.nan] + [0.0] * (size - 1)), (10, 2, [0.5] * (size - 1) + [-math.inf])]
    rows += [rows[0], rows[0], (rows[1][0], 0, rows[2][2]), (None, 0, rows[3][2]), (None, 5, [1.0] * size), (77, 6, [0.1] * (size + 1)), (78, 6, []), (79, 1, [3000.0] * size)]
    return rows


@pytest.mark.parametrize("size,n,entries,rounds", [(8, 120, 30, 4), (6, 60, 256, 2), (4, 400, 256, 1)])
def test_against_loops(spark, size, n, entries, rounds):
    rows = _rows(size, n)
    d = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, label int, embedding array<double>, code string, error int, of double").repartition(3)
    got = vectors.compress(d, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, entries=entries, rounds=rounds)


@pytest.mark.parametrize("rows", [[], [(1, 0, None)], [(1, 0, [math.nan])], [(1, None, []), (2, None, [])], [(5, 1, [1.0]), (5, 1, [1.0])]])
def test_few_rows(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert sorted(map(tuple, vectors.compress(d).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("high", [3, 1000, 2**27])
def test_tree_finds_the_lowest_index_of_the_nearest(high):
    rng = np.random.default_rng(high)
    for n in (1, 7, 60, 256):
        entries = rng.integers(-high, high, (n, 5))
        entries[n // 2 :: 3] = entries[0]
        q = np.concatenate([rng.integers(-high, high, (500, 5)), entries])
        index, d = vectors.nearest(vectors.vantage_tree(entries), q)
        every = ((q[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        assert (every.min(1) == d).all() and (every.argmin(1) == index).all()


def test_tree_leaves_entries_out():
    rng = np.random.default_rng(1)
    entries = rng.integers(-1000, 1000, (256, 2))
    seen, plain = [], vectors._distances
    try:
        vectors._distances = lambda q, e: seen.append(len(q) * len(e)) or plain(q, e)
        tree = vectors.vantage_tree(entries)
        seen.clear()
        vectors.nearest(tree, entries)
    finally:
        vectors._distances = plain
    assert sum(seen) < 256 * 256 / 4

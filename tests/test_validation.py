"""Crossings, and ways that part a branch."""

from cablewright.operators import trees


def test_an_edge_over_a_node_parts_its_neighbours(spark):
    at = {-1: (0, 0), 0: (10, 0), 1: (20, 0), 2: (20, 10), 3: (20, -10), 4: (30, 0), 5: (25, 12), 6: (10, 40), 7: (30, 40), 8: (20, 40), 9: (20, 50), 10: (26, 50), 11: (10, 60), 12: (20, 70)}
    v = spark.createDataFrame([(1, n, *p) for n, p in at.items()], "site_id long, n long, x long, y long")
    # 0-4 goes over 1, between 2 and 3; 6-7 goes over 8, both of whose neighbours lie above.
    edges = [(0, 4), (1, 2), (1, 3), (2, 5), (6, 7), (8, 9), (8, 10), (11, 12)]
    e = spark.createDataFrame([(1, *x) for x in edges], "site_id long, u long, v long")
    (row,) = trees.violations(e, v).collect()
    assert (row.u, row.v, {row.s, row.t}) == (0, 4, {2, 3})
    crossed = spark.createDataFrame([(1, 0, 5), (1, 1, 2)], "site_id long, u long, v long")
    assert {tuple(r)[1:] for r in trees.violations(crossed, v).collect()} == {(0, 5, 1, 2)}


def test_bends(spark):
    at = {0: (0, 0), 1: (10, 0), 2: (0, 10), 3: (5, 5), 4: (-5, -5), 5: (6, 4)}
    v = spark.createDataFrame([(1, n, *p) for n, p in at.items()], "site_id long, n long, x long, y long")
    bend = spark.createDataFrame([(1, 1, 0, 2)], "site_id long, a long, d long, b long")
    links = lambda *m: spark.createDataFrame([(1, 0, k) for k in m], "site_id long, u long, v long")
    rows = lambda *m: [tuple(r) for r in trees.splits(bend, links(*m), v).collect()]
    assert rows(3, 4) == [(1, 1, 0, 2, 3, 4)] and rows(3, 5) == [] and rows(4) == [] and rows(1, 2, 3) == []

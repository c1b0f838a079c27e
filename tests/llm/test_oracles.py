"""The llm queries that have SQL, against it, on the small tables."""

import duckdb
import pytest

from cablewright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: round(v, 8) if isinstance(v, float) else v
    assert sorted(tuple(map(plain, r)) for r in df.select(*names).collect()) == sorted(tuple(map(plain, r)) for r in cur.fetchall())

"""The entry module, without a session and with one."""

import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_without_a_session():
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q)"], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["site_id", "capacity", "terminals", "gates", "length", "cost"] and df.count() == 20

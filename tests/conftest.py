import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pagelens.session import build_session

    s = build_session("local[4]", partitions=4, app="pagelens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ["pages", "documents", "lineitem"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF0001}/{t}.parquet'")
    return con

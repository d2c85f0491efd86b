import __spark_entry__ as E
import duckdb
import pytest
from pagelens.llm import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations", "embeddings")


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_sql_parity(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = E.queries()[name](spark, SF)
    want = con.sql(E.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_all_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))

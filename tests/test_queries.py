"""Every registered query runs at sf0.001 and matches its DuckDB oracle
(the driver's check, at the smallest scale)."""

import duckdb
import pytest

import __spark_entry__ as E
from kestrel.sources.tables import TABLES
from tools.oracle_check import rows_of, type_diff

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["n_prompts", "n_pass", "pass_rate"] and df.count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        return
    assert type_diff(df.schema, con.sql(ORACLE[name])) == {}
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, got) == rows_of(dcols, cur.fetchall())

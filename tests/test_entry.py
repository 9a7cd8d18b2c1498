import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry_module.oracle_sql() if not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def norm(v):
    return repr(float(v) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    got = sorted(tuple(map(norm, r)) for r in df.select(sorted(df.columns)).collect())
    c = duck.execute(entry_module.oracle_sql()[name])
    cols = [x[0] for x in c.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    assert sorted(df.columns) == sorted(cols)
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in c.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_is_sql_of_a_query():
    found = entry_module.oracle_sql()
    assert all(isinstance(sql, str) for sql in found.values()) and set(found) <= set(entry_module.queries())

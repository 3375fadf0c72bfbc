import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [f[:-8] for f in os.listdir(SF) if f.endswith(".parquet")] if os.path.isdir(SF) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    expected = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    norm = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert norm(got) == norm(expected)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_the_others_run(spark, name):
    rows = entry.queries()[name](spark, SF)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

"""Every query that has a SQL text returns the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SF
from worklens.plans import oracle, registry

TABLES = ("orders", "lineitem")
QUERIES, ORACLE = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    clean = lambda v: None if v is None or v != v else (v.item() if hasattr(v, "item") else v)
    return sorted((tuple(clean(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_text_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 8

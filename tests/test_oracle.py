"""Every registered query against its DuckDB oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from ledgerline.plans import registry
from tests.compare import same

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
# The document operators have tests of their own (not all of them can be told in SQL).
QUERIES = registry.queries()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(SQL[name])
    problem = same(df.columns, rows, rel.columns, rel.fetchall())
    assert problem is None, problem
    duck = dict(zip(rel.columns, map(str, rel.types)))
    types = [(f.name, f.dataType.simpleString(), duck.get(f.name)) for f in df.schema.fields
             if SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) != duck.get(f.name)]
    assert not types, f"column types differ: {types}"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "ebitda" in df.columns

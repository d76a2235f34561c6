"""Every query against its SQL, run by DuckDB on the same files."""

from __future__ import annotations

import os

import duckdb
import pytest

import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = """region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in cursor.description]
    expected = [dict(zip(names, row)) for row in cursor.fetchall()]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    got = sorted(repr([row[c] for c in columns]) for row in df.collect())
    assert got == sorted(repr([row[c] for c in columns]) for row in expected)
    assert got


def test_plans_have_no_cartesian_product(spark):
    for name, run in catalog.QUERIES.items():
        plan = run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_entry(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).collect()
    assert {r["metric"] for r in rows} == {"cer", "wer"}
    assert set(contract.oracle_sql()) <= set(contract.queries())

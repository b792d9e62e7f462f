"""Every registered query against its SQL in DuckDB."""

import glob
import os

import pytest

from conftest import SF_DIR
from hostweave.plans.oracle import oracle_sql
from hostweave.plans.queries import registered

duckdb = pytest.importorskip("duckdb")

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert registered().keys() == oracle_sql().keys()


def test_entry_is_the_use_of_each_node(spark):
    import __spark_entry__ as entry_point

    assert registered().keys() <= entry_point.oracle_sql().keys() <= entry_point.queries().keys()
    df = entry_point.entry(spark)
    assert df.columns == ["node_name", "mounts", "total_bytes", "used_bytes", "avail_bytes",
                          "used_percent", "severity"]
    assert df.count() == 4


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_matches_sql(spark, database, name):
    df = registered()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = database.execute(oracle_sql()[name])
    found = {c[0]: (i, str(c[1])) for i, c in enumerate(result.description)}
    assert sorted(found) == columns
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == {c: t for c, (_, t) in found.items()}
    expected = sorted(repr(tuple(r[found[c][0]] for c in columns)) for r in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected

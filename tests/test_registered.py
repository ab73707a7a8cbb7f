"""Every registered query against its SQL, run by DuckDB on the same files."""

import os
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as registered
from oracles.sql import ORACLES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
# The text operators are tested in a folder of their own.
QUERIES = {name: query for name, query in registered.queries().items() if name in ORACLES}
# Plans that leave the JVM or pair every row with every other.
AVOIDED = ("CartesianProduct", "NestedLoopJoin", "ArrowEvalPython", "BatchEvalPython")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield connection
    connection.close()


def _rows(table: pa.Table) -> list[tuple]:
    columns = [table[name].to_pylist() for name in sorted(table.column_names)]
    return sorted(zip(*columns), key=repr)


def _kinds(table: pa.Table) -> dict[str, str]:
    def kind(type_):
        if pa.types.is_large_string(type_) or pa.types.is_string_view(type_):
            return pa.string()
        return type_

    return {field.name: str(kind(field.type)) for field in table.schema}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    actual = df.toArrow()
    expected = duck.sql(ORACLES[name]).to_arrow_table()
    assert _kinds(actual) == _kinds(expected)
    assert actual.num_rows > 0
    assert _rows(actual) == _rows(expected)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in AVOIDED if word in plan]


def test_entry(spark):
    assert registered.entry(spark).count() == 7

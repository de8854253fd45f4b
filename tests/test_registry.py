"""Every registered query against its SQL in an independent engine."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry
from conftest import TESTDATA
from gatesift.plans.oracles import SQL
from gatesift.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for path in glob.glob(f"{TESTDATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def value(cell):
    return f"{cell:.9g}" if isinstance(cell, float) else str(cell)


def rows(table, columns):
    return sorted(tuple(value(row[c]) for c in columns) for row in table)


SPARK_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
               "int": "INTEGER"}


def test_every_query_has_an_oracle():
    assert set(REGISTRY) == set(SQL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, engine, name):
    df = REGISTRY[name](spark, TESTDATA)
    result = engine.sql(SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    types = {f.name: SPARK_TYPES[f.dataType.simpleString()] for f in df.schema.fields}
    assert types == dict(zip(result.columns, map(str, result.types)))
    expected = [dict(zip(result.columns, row)) for row in result.fetchall()]
    columns = sorted(df.columns)
    assert rows([r.asDict() for r in df.collect()], columns) == rows(expected, columns)


def test_entry(spark):
    out = entry(spark)
    assert out.columns == ["status", "reason", "n_docs"] and not out.isEmpty()

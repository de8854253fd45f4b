"""The registered queries of this subpackage against their SQL."""

import glob
import os

import duckdb
import pytest
from test_registry import SPARK_TYPES, rows

from conftest import TESTDATA
from gatesift.llm.queries import REGISTRY
from gatesift.llm.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    engine = duckdb.connect()
    for path in glob.glob(f"{TESTDATA}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        engine.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    df = REGISTRY[name](spark, TESTDATA)
    result = engine.sql(SQL[name])
    assert {f.name: SPARK_TYPES[f.dataType.simpleString()] for f in df.schema.fields} == \
        dict(zip(result.columns, map(str, result.types)))
    expected = [dict(zip(result.columns, r)) for r in result.fetchall()]
    columns = sorted(df.columns)
    assert rows([r.asDict() for r in df.collect()], columns) == rows(expected, columns)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))

"""The operators that SQL can express give the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from panelweave.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_in_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, db.execute(f"select {quoted} from ({SQL[name]})").fetchall()))

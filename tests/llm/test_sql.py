"""The queries that SQL can express, against DuckDB over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tanpura.llm import queries
from tests.test_queries import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for file in Path(small).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    same(queries.queries()[name](spark, small).toPandas(), con.sql(queries.oracle_sql()[name]).df())

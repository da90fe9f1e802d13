"""Every registered query against its DuckDB SQL over the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tanpura.plans.oracles import oracle_sql
from tanpura.plans.queries import queries


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for file in Path(small).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        different = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        assert not different.any(), (c, a[c][different].head(3).tolist(), b[c][different].head(3).tolist())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, small, con, name):
    same(queries()[name](spark, small).toPandas(), con.sql(oracle_sql()[name]).df())


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

"""Every accounting query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tallyforge.plans.queries import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]) or "date" in c or "day" in c or c == "newest":
            df[c] = df[c].map(lambda x: None if pd.isna(x) else str(x)[:10])
        elif pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6) + 0.0
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=repr)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries()[name](spark, SF).toPandas(), duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and len(got) > 0
    assert plain(got.copy()) == plain(want.copy())


def test_journal_balances(spark):
    assert all(abs(r["balance"]) < 0.0101 for r in queries()["journal_totals"](spark, SF).collect())

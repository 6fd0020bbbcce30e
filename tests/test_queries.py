"""Every bar query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from barspark.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NaT or (not isinstance(value, (list, dict)) and pd.isna(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ in ("bool", "bool_"):
        return bool(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype") and value.dtype.kind in "iuf":
        return float(f"{float(value):.9g}") + 0.0
    return str(value)


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame = frame.assign(**{c: frame[c].astype("datetime64[us]").astype(str).where(frame[c].notna(), None)})
    return sorted(([plain(x) for x in r] for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), connection.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every catalogue query against its SQL on the small fixture, where it is there."""

import os

import pandas as pd
import pytest

from passbook.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def plain(v):
    if v is None or (not isinstance(v, (list, str)) and pd.isna(v)):
        return "null"
    return f"{float(v):.9g}" if not isinstance(v, (list, str)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_corrections_of_payments_that_share_a_number(spark, tmp_path):
    """Order 16 of a customer isn't event 16 of a user: the event's later correction says nothing about the customer."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    at = "TIMESTAMP '2024-01-01' + to_days(CAST(d AS INT))"
    con.execute(f"create table orders as select id as o_orderkey, 1 as o_custkey, {at} as o_orderdate from (values (16, 0), (1, 30), (24, 60)) t(id, d)")
    con.execute(f"create table events as select id as event_id, {at} as ts, 7 as user_id, 'view' as event_type, 1.0 as value from (values (16, 90), (5, 91)) t(id, d)")
    for t in ("orders", "events"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    got, want = QUERIES["sub_corrections"](spark, str(tmp_path)).toPandas(), con.execute(ORACLES["sub_corrections"]).df()
    assert rows(got) == rows(want) and got.status.tolist() == ["DISMISSED"]

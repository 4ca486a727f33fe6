"""Every registered graph query against its SQL on DuckDB, at the smallest scale."""

import datetime
import math
import os

import duckdb
import pytest

from loomgraph import queries as Q

SF = "/root/testdata/sf0.001"
#: Loops of many rounds, which other tests hold against brute force: only run where asked for.
LONG = ("ord8", "ord9", "ord11", "ord12", "cd1", "cd7", "cd8", "k1_", "k11", "k20", "k7", "k10", "k8", "k5", "ag9", "r8", "f3", "ord16")
NAMES = [n for n in sorted(Q.QUERIES) if os.environ.get("LOOM_ALL_QUERIES") or not n.startswith(LONG)]
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7)
    return str(v) if isinstance(v, datetime.datetime) else v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns and len(set(df.columns)) == len(df.columns)
    if name in Q.ORACLES:
        made = con.execute(Q.ORACLES[name])
        columns = [d[0] for d in made.description]
        assert sorted(columns) == sorted(df.columns)
        assert table(rows, df.columns) == table(made.fetchall(), columns)
    else:
        assert rows
    if {"is_bijection", "same_topology"} <= set(df.columns):
        assert rows[0]["is_bijection"] and rows[0]["same_topology"]

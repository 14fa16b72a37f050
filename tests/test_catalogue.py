"""Every query against its SQL in another engine, and the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from rosterlake.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=str)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, other, name):
    df = catalogue.queries()[name](spark, D)
    got = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if sql := catalogue.oracle_sql().get(name):
        want = other.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry_module.entry(spark).columns and set(catalogue.queries()) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_without_the_other_subpackage(monkeypatch):
    monkeypatch.setattr(entry_module, "_present", lambda name: False)
    assert set(entry_module.queries()) == set(catalogue.queries())

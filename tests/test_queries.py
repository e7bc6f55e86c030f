"""Registered queries against their SQL."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry
from crawlprism.plans.registry import load_all

sys.path.insert(0, str(entry.Path(entry.__file__).parent / "tools"))
from check import TABLES, rows_of  # noqa: E402

NAMES = list(load_all())


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, oracle, name):
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    cursor = oracle.execute(sql)
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["subsidiary_entity", "visits_a", "visits_b", "delta", "lift"]


def test_reports_come_in_order(spark, sf):
    """Both comparisons above sort rows; the order of a report is part of it."""
    rows = entry.queries()["d4_differential_entities"](spark, sf).collect()
    assert len(rows) > 1 and rows == sorted(rows, key=lambda r: (-r.lift, -r.delta, r.subsidiary_entity))

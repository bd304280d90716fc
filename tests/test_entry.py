"""The driver's contract: every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from vecloom.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_the_rest_stands_without_the_training_data_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "vecloom.llm", None)
    import __spark_entry__ as entry

    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE)


def scans(df):
    return [line for line in df._jdf.queryExecution().toString().splitlines() if "PushedFilters" in line]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_plans_push_down_and_prune(spark):
    (scan,) = scans(QUERIES["point_lookup"](spark, SF))
    for one in ("IsNotNull(vec_id)", "EqualTo(vec_id,7)"):
        assert one in scan.partition("PushedFilters")[2].partition("ReadSchema")[0], scan
    lines = scans(QUERIES["filter_eq"](spark, SF))
    assert any("EqualTo(lang,en)" in x for x in lines)
    assert all("text" not in x.partition("ReadSchema")[2] for x in lines)

"""Every relational query against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from marlstone import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in Q.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, oracle, name):
    df = Q.queries()[name](spark, SF)
    rows = df.collect()
    sql = Q.oracle_sql().get(name)
    if sql is None:
        assert name.startswith("explain") and len(rows) == 1
        return
    done = oracle.execute(sql)
    columns = [d[0] for d in done.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, rows) == _rows(columns, done.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query against its DuckDB oracle on the smallest scale factor."""

from __future__ import annotations

import math

import duckdb
import pytest

from paths import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9))
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _queries():
    """The library's own queries; the optional operators have tests of their own."""
    from typesift.plans import catalog
    return catalog.registry()


def test_every_query_has_an_oracle():
    import __spark_entry__ as E
    own = _queries()
    assert all(sql is not None for _, sql in own.values())
    assert set(own) <= set(E.queries()) and set(own) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(_queries()))
def test_query_matches_oracle(spark, duck, name):
    fn, sql = _queries()[name]
    df = fn(spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, drows)


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 18
    assert "corrected_type" in df.columns

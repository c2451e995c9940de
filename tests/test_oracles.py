"""Every registered query against its independent DuckDB oracle (sf0.001):
same column names, same row count, same order-insensitive values."""

from __future__ import annotations

import math

import pytest

from conftest import SF_SMALL

from nextbest.plans import registry
from __spark_entry__ import oracle_sql, queries


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else str(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(duck):
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(ocols, want)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_rows_only_queries_are_the_non_sql_ones():
    registry.load_all()
    rows_only = set(registry.QUERIES) - set(registry.ORACLES)
    assert rows_only == {"als_top3", "hybrid_recs_als"}

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from graphloom import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(value):
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = core.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    assert name in core.ORACLES
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({core.ORACLES[name]})").fetchall()
    rows = [tuple(map(plain, r)) for r in got.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(plain, r))) for r in expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.QUERIES) <= set(entry.queries())

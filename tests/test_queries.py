"""Every core query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from turnloom.plans.registry import core_queries, core_sql


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


def _key(row):
    return tuple(repr(_plain(v)) for v in row)


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, con, sf, name):
    df = core_queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in core_sql():
        assert rows and all(any(v is not None for v in r) for r in rows)
        return
    want = con.sql(core_sql()[name])
    assert sorted(want.columns) == columns
    assert sorted(map(_key, rows)) == sorted(map(_key, want.select(*(f'"{c}"' for c in columns)).fetchall()))


def test_every_sql_has_a_query():
    assert set(core_sql()) <= set(core_queries())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["conv_id", "pair", "question", "answer"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

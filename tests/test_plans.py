"""Every registered query against its oracle SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from quillstone.plans import registry

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else None if v != v else v

    return [columns[i] for i in at], sorted(repr(tuple(plain(r[i]) for i in at)) for r in data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert got == rows(found.columns, found.fetchall())
    else:
        assert got[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.queries())

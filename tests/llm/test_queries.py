"""Queries with SQL give the rows of their SQL, as DuckDB runs it."""

import duckdb
import pytest

from quillstone.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    wanted = sorted(result.fetchall(), key=repr)
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, rel=1e-9) if isinstance(y, float) else y)

"""The training-data queries that have SQL, against it."""

from __future__ import annotations

import duckdb
import pytest

from voxweave.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(map(str, r)) for r in df.select(*names).collect())
    assert got == sorted(tuple(map(str, r)) for r in result.fetchall())

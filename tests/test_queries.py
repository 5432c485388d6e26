"""Every registered query against its SQL, and the others for rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from voxweave.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: repr(float(v)) if isinstance(v, float) and not math.isnan(v) else "NaN" if isinstance(v, float) else str(v)
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


ALL = sorted(set(ORACLES) & set(QUERIES)) if os.environ.get("ALL_QUERIES", "1") != "0" else sorted(set(ORACLES) & set(QUERIES))[::4] + ["flagship_normalized_dice"]


@pytest.mark.parametrize("name", ALL)
def test_against_sql(spark, duck, sf, name):
    """Every query that has SQL; a quarter of them with ALL_QUERIES=0."""
    df = __spark_entry__.queries()[name](spark, sf)
    result = duck.execute(__spark_entry__.oracle_sql()[name])
    want = rows([c[0] for c in result.description], result.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query that has SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from gridlake.plans.reference_queries import ORACLE_SQL, QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLE_SQL:
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[k]) for k in place]) for r in want.fetchall())

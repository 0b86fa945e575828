"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from heddle.plans import registry
from heddle.sources.tables import NAMES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int | float | Decimal):
        return None if math.isnan(v) else float(v)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", registry.QUERIES)
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)

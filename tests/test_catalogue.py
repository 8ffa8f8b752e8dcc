"""All core queries against their SQL twins on the smallest data folder."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from codeloom.plans.catalogue import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


def test_every_twin_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, str(FOLDER))
    columns = sorted(result.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in result.collect()), key=repr)
    if name in ORACLES:
        rows = duck.sql(ORACLES[name])
        assert sorted(rows.columns) == columns
        at = [rows.columns.index(c) for c in columns]
        assert found == sorted((tuple(plain(r[i]) for i in at) for r in rows.fetchall()), key=repr)

"""Every registered query against its SQL, on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from hearthbook.plans.oracles import ORACLES
from hearthbook.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    expected = duck.sql(ORACLES[name])
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    places = [expected.columns.index(c) for c in columns]
    wanted = sorted(repr([row[p] for p in places]) for row in expected.fetchall())
    found = sorted(repr([row[c] for c in columns]) for row in frame.collect())
    assert found == wanted

"""Every registered query with a SQL twin agrees with it on the smallest tables."""

from __future__ import annotations

import pytest

from tests.compare import connect, difference
from triagemill.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE[name]).fetchdf()
    assert difference(got, want) is None


def test_names_are_complete():
    assert set(ORACLE) <= set(QUERIES)
    groups = {"src": 9, "sch": 7, "lab": 13, "txt": 16, "dup": 11, "agg": 23, "spl": 10}
    for prefix, count in groups.items():
        for i in range(1, count + 1):
            assert f"{prefix}{i}" in QUERIES
    for i in range(1, 6):
        assert f"fea{i}" in QUERIES
    for i in range(1, 24):
        assert f"mod{i}" in QUERIES
    for i in range(1, 23):
        assert f"eva{i}" in QUERIES

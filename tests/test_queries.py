"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import compare
from claimloom.plans.catalogue import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = compare.actual(QUERIES[name](spark, FOLDER))
    if name in CHECKS:
        assert compare.difference(got, compare.expected(con, CHECKS[name])) is None
    else:
        assert got[1]


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)


def test_entry(spark):
    import __spark_entry__ as entry

    result = entry.entry(spark)
    assert result.count() == 25
    assert set(entry.queries()) >= set(entry.oracle_sql())

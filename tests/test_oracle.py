"""Every registered query against its SQL check on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from workloads.check import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    result = entry.queries()[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(result, con, ORACLES[name]) is None
    else:
        assert result.count() >= 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.class_id for r in rows} <= {1, 2, 3, 12, 101, 103, 104} and rows

"""Every registered query against its SQL."""

import os

import pytest

import __spark_entry__ as entry
import compare

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert compare.diff(df, ORACLES[name], SF_DIR) is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "asset_id" and len(df.columns) == 30

"""Every named query against its SQL on the smallest tables."""

import compare
import pytest

from weirflow.plans import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    problems, *_ = compare.differences(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert not problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).collect()  # rows, not a count, which would skip the columns

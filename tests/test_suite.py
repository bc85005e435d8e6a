import os

import pytest

from larkspark.plans import coverage, suite
from tests.oracle import connect, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


QUERIES, ORACLE = suite.QUERIES | coverage.QUERIES, suite.ORACLE | coverage.ORACLE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, connection, name):
    same(QUERIES[name](spark, SF), connection, ORACLE[name])

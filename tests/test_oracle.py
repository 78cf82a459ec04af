"""Every registered query against its oracle SQL on the smallest given tables."""

import os

import pytest

from kbspark.plans import ORACLES, QUERIES
from tests.oracle import TESTDATA, compare, duck

SF = os.path.join(TESTDATA, "sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        ok, message = compare(df, con, ORACLES[name])
        assert ok, message
    else:
        assert df.count() > 0

"""Every query against its SQL on another engine, over whole tables; the others must at least run."""

import oracle
import pytest

from graphloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        problem = oracle.compare(df, con, ORACLES[name])
        assert problem is None, problem
    else:
        assert df.count() > 0

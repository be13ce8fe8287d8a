import os

import pytest
from oracle import SF, bag, sql

import quillmill.catalog  # noqa: F401
from quillmill.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert bag(ours) == bag(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0

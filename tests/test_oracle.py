"""Each query against its SQL on the smallest tables."""

import pytest
from conftest import DATA, plain

from carbonloom.queries import all_queries, all_sql


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    got = all_queries()[name](spark, DATA).toPandas()
    want = duck.sql(all_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert plain(got) == plain(want)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())

"""Every query against its SQL."""

import pytest

from pagemill.plans import catalogue
from tests.sql import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_matches_its_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE[name], con)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0

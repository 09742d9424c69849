import pytest
from oracle import compare

from quire import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) > 0


def test_every_query_without_sql_runs(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, SF).count() > 0

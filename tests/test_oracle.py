import os

import pytest

import __spark_entry__ as registry
from tests import compare


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(registry._QUERIES) == set(registry.oracles.oracle_sql())


@pytest.mark.parametrize("name", registry._QUERIES)
def test_query_matches_sql(name, spark, duck, sf_dir):
    found = registry.queries()[name](spark, sf_dir).toArrow()
    expected = duck.sql(registry.oracle_sql()[name]).to_arrow_table()
    print(name, expected.num_rows)
    assert expected.num_rows > 0
    assert compare.difference(found, expected) is None


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("driver tables not mounted")
    assert registry.entry(spark).count() > 0

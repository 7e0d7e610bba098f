import pytest

import __spark_entry__ as registry
import corpus_pipeline
from tagwise.llm import queries
from tests import compare


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_all_operators_are_registered():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_matches_sql(name, spark, duck, sf_dir):
    found = registry.queries()[name](spark, sf_dir).toArrow()
    expected = duck.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert expected.num_rows > 0
    assert compare.difference(found, expected) is None

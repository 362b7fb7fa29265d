import oracle
import pytest

from tessera.llm import queries

pytestmark = pytest.mark.skipif(not oracle.present(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_as_its_sql(spark, name):
    oracle.same(oracle.connect(), queries.SQL[name], queries.QUERIES[name](spark, oracle.DATA))


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 11))

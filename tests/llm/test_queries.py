import pytest

from tarn.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, data, compare, name):
    compare(queries.QUERIES[name](spark, data).toPandas(), duck.execute(queries.ORACLE[name]).df())


def test_one_query_for_each_operator():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}

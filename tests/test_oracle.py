"""Every catalogued query against the SQL that states the same, where there is any."""

import pytest

from tarn.plans import catalog, more, wider  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, data, compare, name):
    compare(catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_other_queries_run(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() == 1500

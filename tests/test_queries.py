import pytest

import __spark_entry__ as entry
from curavine.plans import queries as plans

from .compare import same


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    same(plans.QUERIES[name](spark, sf), duck.execute(plans.SQL[name]))


def test_entry_and_registry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_seeded_sample_is_stable(spark, sf):
    a, b = (sorted(map(tuple, plans.seeded_sample(spark, sf).collect())) for _ in range(2))
    assert a == b and len(a) == 100


@pytest.mark.parametrize("name", ["search_facets", "sorted_page", "source_quality"])
def test_filters_and_columns_reach_the_scan(spark, sf, name):
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "ReadSchema" in plan
    if name == "search_facets":
        assert "EqualTo(p_brand,Brand#13)" in plan

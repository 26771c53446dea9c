"""How often the pairs of the graph features are dealt out anew."""

import re

import pytest

from kinlode.operators import graph_features
from kinlode.plans import queries
from tests.test_normaliser_sql import compare


@pytest.fixture
def sorted_joins(spark):
    """No broadcast, as for tables that are too large for it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt(df):
    return sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString()))


def test_mass(spark, sf_dir, sorted_joins):
    """The pairs go by q while they are narrow, by r, and by q for all windows of a query; the other two are the records'."""
    assert dealt(graph_features.mass(queries.graph(spark, sf_dir))) == ["q"] * 3 + ["r"] * 2


def test_neighbour_pairs(spark, sf_dir, sorted_joins):
    """The three best come from the window of the query: no second branch makes the graph again."""
    assert dealt(graph_features.neighbour_pairs(queries.graph(spark, sf_dir))) == ["q"] * 3 + ["r"] * 2


def test_neighbour_features(spark, sf_dir, sorted_joins):
    """Names come with the candidates; the neighbours are not joined with the records."""
    found = graph_features.neighbours(queries.graph(spark, sf_dir), queries.records(spark, sf_dir))
    assert dealt(found) == ["q"] * 3 + ["r"] * 3


@pytest.mark.parametrize("name", ["mass", "neighbour_pairs"])
def test_same_as_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, name)


DECISIONS = {
    "decide_threshold": ["r"],
    "f05_entity": ["lang"] * 2 + ["q"] * 4 + ["r"],
    "f05_macro": ["lang"] * 2 + ["q"] * 4 + ["r"],
    "matching_results": ["q"] * 2 + ["r"] * 2,
    "output_check": ["q"] * 2 + ["r"] * 2 + ["source1_entity_id"],
}


@pytest.mark.parametrize("name", DECISIONS)
def test_decisions(spark, sf_dir, sorted_joins, name):
    """They start from the written candidates: nothing of blocking is dealt out again, and the pairs go by r once (a second r is the records')."""
    assert dealt(queries.queries()[name](spark, sf_dir)) == DECISIONS[name]

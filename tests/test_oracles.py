import pytest
from oracle import connect, same

import lamella.plans.flows
import lamella.plans.matches
import lamella.plans.pages
import lamella.plans.players
import lamella.plans.queries
import lamella.plans.terms  # noqa: F401
from lamella.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def test_every_query_runs(spark):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, SF).count() > 0


def test_customers_are_counted_without_a_distinct_count(spark):
    plan = QUERIES["weapon_stats"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and "Expand" not in plan and plan.count("RepartitionByExpression") == 3 and plan.count("strategy=merge") == 2

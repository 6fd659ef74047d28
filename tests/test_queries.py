"""Every registered query with check SQL gives the same rows as DuckDB; plans keep their shape."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
CHECKS = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in CHECKS if not re.match(r"op\d", n)))  # those have tests of their own
def test_matches_sql(spark, duck, name):
    assert compare(queries()[name](spark, SF), duck, CHECKS[name]) == []


def plan(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


USER_LEVEL = ["kpi_cards", "retention_d137", "lifecycle_states", "ab_period_summary_pre", "ltv_estimate"]


@pytest.mark.parametrize("name", USER_LEVEL)
def test_user_grain_needs_no_shuffle(spark, name):
    """The bucketed user-day table serves groupings and windows on the user without an exchange."""
    assert "hashpartitioning(user_id" not in plan(spark, name)


@pytest.mark.parametrize("name", ["daily_metrics", "item_metrics", "hourly_distribution", "top_items"])
def test_scans_are_pruned(spark, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert schemas and all(len(s.split(",")) <= 5 for s in schemas)


@pytest.mark.parametrize("name", sorted({n for n in queries() if not n.startswith("op") and n != "pipeline"} - {"churn_gbt", "churn_lr", "churn_model_metrics", "churn_roc_curves", "feature_importance", "als_evaluate", "als_recommend", "als_sinks", "item_factor_similarity"}))
def test_no_cartesian_product(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text

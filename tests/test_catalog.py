"""Registered queries against their SQL on the smallest tables; ALL_QUERIES=1 runs every one."""

import os

import pytest

import check_queries
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "append_new_events",
    "drop_invalid",
    "event_seq",
    "event_seq_large_cases",
    "transition_summary_distributed",
    "variant_summary",
    "case_sla_large_cases",
    "closure_compliance",
    "problem_candidates",
    "flow_worklist",
    "handoff_rollup",
    "prevention_backlog",
]


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_agrees_with_sql(spark, name):
    con = check_queries.connect(FOLDER)
    assert check_queries.compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_the_events_of_a_case_query_are_shuffled_once(spark):
    """Without broadcasts: one shuffle of each table by case, and one of the pre-aggregated groups."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["fcr_summary"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(case_id") == 2
    assert plan.count("Exchange hashpartitioning") == 3


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_counted_values_are_shuffled_once(spark):
    """Measures and percentiles read one shuffle, for which the input is evaluated once: one scan of each table."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        query = QUERIES["variant_summary"](spark, FOLDER)
        query.collect()
        plan = query._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan[: plan.index("== Initial Plan ==")]
    assert "ReusedExchange" in final
    assert final.count("Scan parquet") == 2

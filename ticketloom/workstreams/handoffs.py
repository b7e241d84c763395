"""Handoffs and moves between levels inside a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import measures as m
from ticketloom.operators import outcomes
from ticketloom.operators.scope import Scope, fill_dimensions, scope_cases

# Usual lengths of the ranked lists.
CHART_ROWS = 10
TABLE_ROWS = 12
WORKLIST_ROWS = 200

TABLE_COLUMNS = [
    "issue_type",
    "cases",
    "avg_cycle_hours",
    "met_sla_rate",
    "handoff_rate",
    "high_handoff_rate",
    "pingpong_rate",
]


def _swapped() -> Column:
    return F.col("pingpong_transitions") > 0


def handoff_rollup(scoped: DataFrame) -> DataFrame:
    """Cohorts by issue type; here a high handoff starts at two changes."""
    changes = F.col("resolver_changes")
    measures = [
        *m.core(),
        *m.handoff_means(),
        m.share(changes > 0, "handoff_rate"),
        m.share(changes >= 2, "high_handoff_rate"),
        m.share(_swapped(), "pingpong_rate"),
    ]
    cohorts = fill_dimensions(scoped, "issue_type").groupBy("issue_type").agg(*m.columns(*measures))
    return cohorts.orderBy(F.desc("pingpong_rate"), "issue_type")


def handoff_chart(scoped: DataFrame, rows: int = CHART_ROWS) -> DataFrame:
    return handoff_rollup(scoped).limit(rows).orderBy("pingpong_rate", "issue_type")


def handoff_table(scoped: DataFrame, rows: int = TABLE_ROWS) -> DataFrame:
    return handoff_rollup(scoped).limit(rows).select(*TABLE_COLUMNS)


def handoff_kpis(scoped: DataFrame) -> DataFrame:
    return scoped.agg(
        *m.columns(*m.handoff_means(), m.share(_swapped(), "pingpong_rate")),
        F.avg(F.when(_swapped(), F.col("cycle_hours"))).alias("pingpong_avg_cycle_hours"),
    )


def pingpong_worklist(scoped: DataFrame, rows: int = WORKLIST_ROWS) -> DataFrame:
    return (
        outcomes.pingpong_cases(scoped)
        .orderBy(F.desc("pingpong_transitions"), "case_id")
        .limit(rows)
    )


def worst_handoff_worklist(closed: DataFrame, scope: Scope, rows: int = WORKLIST_ROWS) -> DataFrame:
    """The first rows of the list of all cases of the scope."""
    return outcomes.worst_handoff_cases(scope_cases(closed, scope), rows)

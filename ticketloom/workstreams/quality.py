"""Closure quality inside a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import measures as m
from ticketloom.operators import outcomes
from ticketloom.operators.scope import fill_dimensions

# Fixed value: length of the worklist.
WORKLIST_ROWS = 200


def _no_feedback():
    return m.rate("closed_without_feedback", "closed_without_feedback_rate")


def _fast_reopen():
    return m.rate("reopened_within_24h", "reopened_within_24h_rate")


def _reject():
    return m.rate("has_reject", "reject_rate")


def quality_by_issue(scoped: DataFrame) -> DataFrame:
    cohorts = fill_dimensions(scoped, "issue_type").groupBy("issue_type")
    return cohorts.agg(*m.columns(*m.core(), _no_feedback(), _fast_reopen(), _reject())).orderBy(
        F.desc("closed_without_feedback_rate"), "issue_type"
    )


def quality_by_priority(scoped: DataFrame) -> DataFrame:
    cohorts = fill_dimensions(scoped, "priority").groupBy("priority")
    return cohorts.agg(*m.columns(m.cases(), _fast_reopen(), _reject(), m.avg_cycle())).orderBy(
        F.desc("reopened_within_24h_rate"), "priority"
    )


def quality_kpis(scoped: DataFrame) -> DataFrame:
    return scoped.agg(*m.columns(m.avg_csat(), m.met_sla_rate(), _no_feedback(), _fast_reopen(), _reject()))


def quality_worklist(scoped: DataFrame, rows: int = WORKLIST_ROWS) -> DataFrame:
    worst_first = [
        F.desc(c) for c in ("reopened_within_24h", "closed_without_feedback", "cycle_hours")
    ]
    return outcomes.closure_compliance(scoped).orderBy(*worst_first, "case_id").limit(rows)


def quality_outcome_pairs(scoped: DataFrame) -> DataFrame:
    """Cohorts that have both a cycle time and a satisfaction score."""
    return quality_by_issue(scoped).na.drop(subset=["avg_cycle_hours", "avg_csat"])

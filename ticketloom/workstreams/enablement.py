"""First-contact resolution and recurring problems inside a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import measures as m
from ticketloom.operators import outcomes
from ticketloom.operators.scope import Scope, fill_dimensions, scope_cases

# Usual lengths of the ranked lists.
BACKLOG_ROWS = 15
WORKLIST_ROWS = 200


def _level_share(level: str):
    return m.share(F.col("resolution_level") == level, f"{level.lower()}_rate")


def enablement_by_issue(scoped: DataFrame) -> DataFrame:
    """Cohorts by issue type, ranked by slow volume that first contact does not resolve."""
    levels = [_level_share(level) for level in ("L1", "L2", "L3")]
    cohorts = fill_dimensions(scoped, "issue_type").groupBy("issue_type").agg(
        *m.columns(*m.core(), m.rate("fcr", "fcr_rate"), *levels)
    )
    load = F.col("cases") * F.coalesce("avg_cycle_hours", F.lit(0.0))
    unresolved = 1.0 - F.coalesce("fcr_rate", F.lit(0.0))
    return cohorts.withColumn("enablement_score", load * unresolved).orderBy(
        F.desc("enablement_score"), "issue_type"
    )


def prevention_backlog(closed: DataFrame, scope: Scope, rows: int = BACKLOG_ROWS) -> DataFrame:
    """The themes with most cases, counted over all cases of the scope."""
    themes = fill_dimensions(scope_cases(closed, scope), "issue_type").groupBy(
        "issue_type", "short_description_norm"
    )
    return (
        themes.agg(*m.columns(m.cases(), m.avg_cycle()))
        .orderBy(F.desc("cases"), F.desc("avg_cycle_hours"), "issue_type", "short_description_norm")
        .limit(rows)
    )


def enablement_kpis(scoped: DataFrame) -> DataFrame:
    return scoped.agg(*m.columns(m.rate("fcr", "fcr_rate"), _level_share("L1"), m.avg_cycle(), m.avg_csat()))


def low_fcr_worklist(scoped: DataFrame, rows: int = WORKLIST_ROWS) -> DataFrame:
    return outcomes.fcr_cases(scoped).orderBy("fcr", F.desc("cycle_hours"), "case_id").limit(rows)


def problem_worklist(closed: DataFrame, scope: Scope, rows: int = WORKLIST_ROWS) -> DataFrame:
    """The longest cases of the scope."""
    problems = scope_cases(closed, scope).select(*outcomes.PROBLEM_TOP_COLUMNS)
    return problems.orderBy(F.desc("cycle_hours"), "case_id").limit(rows)

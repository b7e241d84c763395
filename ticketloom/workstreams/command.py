"""Operational health: headline numbers, cohorts to act on and the longest cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import measures as m
from ticketloom.operators.outcomes import DIMENSIONS
from ticketloom.operators.percentiles import summarize
from ticketloom.operators.scope import fill_dimensions

# Lengths of the ranked lists.
TOP_CASES = 25
ACTION_ROWS = 10
ACTION_CHART_ROWS = 8

# The columns of the list, in order.
TOP_CASE_COLUMNS = [
    "case_id",
    *DIMENSIONS,
    "cycle_hours",
    "customer_satisfaction",
    "met_sla",
    "has_reopen",
    "has_reject",
    "resolver_changes",
    "escalation_count",
]


def scope_kpis(scoped: DataFrame, in_task: bool = False) -> DataFrame:
    measures = [
        m.cases(),
        m.met_sla_rate(),
        m.avg_cycle(),
        m.known_share(F.col("has_reopen"), "reopen_rate"),
        m.rest_of(m.known_share(F.col("has_feedback"), "feedback_gap")),
    ]
    return summarize(scoped, [], measures, "cycle_hours", {"p90_cycle_hours": 0.9}, in_task)


def _cohorts(scoped: DataFrame, *dimensions: str):
    return fill_dimensions(scoped, *dimensions).groupBy(*dimensions)


def _scored(cohorts: DataFrame) -> DataFrame:
    rework = F.coalesce("reopen_rate", F.lit(0.0)) + F.coalesce("reject_rate", F.lit(0.0))
    load = F.col("cases") * F.coalesce("avg_cycle_hours", F.lit(0.0))
    return cohorts.withColumn("opportunity_score", load * (1.0 + rework))


def variant_rollup(scoped: DataFrame) -> DataFrame:
    """Cohorts by variant, the heaviest combination of volume, delay and rework first."""
    cohorts = _cohorts(scoped, "variant").agg(*m.columns(*m.core(), *m.outcome_rates(), *m.handoff_means()))
    return _scored(cohorts).orderBy(F.desc("opportunity_score"), F.desc("cases"), "variant")


def group_rollup(scoped: DataFrame, dimension: str) -> DataFrame:
    """Cohorts by any dimension, the largest first."""
    feedback = m.known_share(F.col("has_feedback"), "feedback_rate")
    cohorts = _cohorts(scoped, dimension).agg(
        *m.columns(*m.core(), *m.outcome_rates(), feedback, *m.handoff_means())
    )
    return cohorts.orderBy(F.desc("cases"), dimension)


def top_cases(scoped: DataFrame, rows: int = TOP_CASES) -> DataFrame:
    return scoped.orderBy(F.desc("cycle_hours"), "case_id").limit(rows).select(*TOP_CASE_COLUMNS)


def action_queue(scoped: DataFrame, rows: int = ACTION_ROWS) -> DataFrame:
    columns = [
        "variant",
        "cases",
        "avg_cycle_hours",
        "met_sla_rate",
        "reopen_rate",
        "reject_rate",
        "opportunity_score",
    ]
    return variant_rollup(scoped).select(*columns).limit(rows)


def action_chart(scoped: DataFrame, rows: int = ACTION_CHART_ROWS) -> DataFrame:
    """The heaviest variants, in the order of their mean cycle time."""
    return variant_rollup(scoped).limit(rows).orderBy("avg_cycle_hours", "variant")


def leader_briefing(scoped: DataFrame) -> DataFrame:
    """The values behind the briefing, folded from one row per variant."""
    cohorts = _cohorts(scoped, "variant").agg(
        *m.columns(m.cases(), m.avg_cycle(), *m.outcome_rates()),
        F.sum("cycle_hours").alias("cycle_sum"),
        F.count("cycle_hours").alias("cycle_count"),
        F.sum(F.col("has_feedback").cast("double")).alias("feedback_sum"),
        F.sum(F.col("has_reopen").cast("double")).alias("reopen_sum"),
    )
    heaviest = F.struct((-F.col("opportunity_score")).alias("s"), (-F.col("cases")).alias("c"), "variant")
    total = F.sum("cases")
    folded = _scored(cohorts).agg(
        total.alias("cases"),
        (F.sum("cycle_sum") / F.sum("cycle_count")).alias("avg_cycle_hours"),
        F.min_by(F.struct("variant", "avg_cycle_hours"), heaviest).alias("worst"),
        (1.0 - F.sum("feedback_sum") / total).alias("feedback_gap"),
        (F.sum("reopen_sum") / total).alias("reopen_rate"),
    )
    return folded.select(
        "cases",
        "avg_cycle_hours",
        F.col("worst.variant").alias("worst_variant"),
        F.col("worst.avg_cycle_hours").alias("worst_variant_hours"),
        "feedback_gap",
        "reopen_rate",
    )

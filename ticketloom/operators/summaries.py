"""Global summaries of the closed cases.

Every function takes the wide relation of closed cases, so each summary is one aggregation of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import measures as m
from ticketloom.operators.percentiles import summarize

P90_CYCLE = {"p90_cycle_hours": 0.9}


def _with_p90(closed, keys, measures, in_task):
    return summarize(closed, keys, measures, "cycle_hours", P90_CYCLE, in_task)


def variant_summary(closed: DataFrame, in_task: bool = False) -> DataFrame:
    return _with_p90(closed, ["variant"], [*m.core(), *m.outcome_rates(), *m.handoff_means()], in_task)


def handoff_summary(closed: DataFrame, in_task: bool = False) -> DataFrame:
    changes = F.col("resolver_changes")
    measures = [
        *m.core(),
        *m.handoff_means(),
        m.share(changes >= 1, "handoff_rate"),
        m.share(changes >= 3, "high_handoff_rate"),
        m.share(F.col("pingpong_transitions") > 0, "pingpong_rate"),
    ]
    return _with_p90(closed, ["variant", "issue_type"], measures, in_task)


def _closure_rates():
    return [
        m.rate("closed_without_feedback", "closed_without_feedback_rate"),
        m.rate("reopened_within_3h", "reopened_within_3h_rate"),
        m.rate("has_reject", "reject_rate"),
    ]


def cx_summary(closed: DataFrame, in_task: bool = False) -> DataFrame:
    """One row, also when there is no case."""
    within_a_day = m.rate("reopened_within_24h", "reopened_within_24h_rate")
    return _with_p90(closed, [], [*m.core(), *_closure_rates(), within_a_day], in_task)


def cx_breakdown(closed: DataFrame) -> DataFrame:
    return closed.groupBy("issue_type", "priority").agg(*m.columns(*m.core(), *_closure_rates()))


def problem_candidates(closed: DataFrame, in_task: bool = False) -> DataFrame:
    """Recurring themes with an impact score; a cohort without any SLA target counts as all missed."""
    themes = _with_p90(
        closed.filter(F.col("short_description_norm").isNotNull()),
        ["issue_type", "short_description_norm"],
        [
            *m.core(),
            *m.outcome_rates(),
            m.least("short_description_raw", "example_description"),
            m.greatest("closed_at", "last_seen_ts"),
        ],
        in_task,
    )
    missed = 1.0 - F.coalesce("met_sla_rate", F.lit(0.0))
    delay = F.coalesce("avg_cycle_hours", F.lit(0.0)) / 10.0
    rework = F.coalesce("reopen_rate", F.lit(0.0)) + F.coalesce("reject_rate", F.lit(0.0))
    return themes.withColumn("impact_score", F.col("cases") * (missed * delay + rework))


def _channel_measures():
    return [
        *m.core(),
        *m.outcome_rates(),
        *m.handoff_means(),
        m.rate("has_feedback", "feedback_rate"),
        m.rest_of(m.rate("has_feedback", "missing_feedback_rate")),
    ]


def channel_summary(closed: DataFrame, in_task: bool = False) -> DataFrame:
    return _with_p90(closed, ["report_channel"], _channel_measures(), in_task)


def channel_issue_summary(closed: DataFrame, in_task: bool = False) -> DataFrame:
    return _with_p90(closed, ["report_channel", "issue_type"], _channel_measures(), in_task)


def fcr_summary(closed: DataFrame) -> DataFrame:
    measures = [
        *m.core(),
        m.rate("fcr", "fcr_rate"),
        m.rate("reopened", "reopen_rate"),
        m.rate("escalated_to_l2", "l2_escalation_rate"),
        m.rate("escalated_to_l3", "l3_escalation_rate"),
    ]
    return closed.groupBy("issue_type").agg(*m.columns(*measures))


def kb_enablement_candidates(closed: DataFrame) -> DataFrame:
    level = F.col("resolution_level")
    measures = [
        m.cases(),
        m.share(level == "L1", "l1_solved_rate"),
        m.share(level.isin("L2", "L3"), "l2_or_l3_rate"),
        m.rate("escalated_to_l2", "escalation_to_l2_rate"),
        m.rate("reopened", "reopen_rate"),
        m.avg_cycle(),
        m.avg_csat(),
    ]
    cohorts = closed.groupBy("issue_type").agg(*m.columns(*measures))
    burden = F.col("l2_or_l3_rate") + F.col("escalation_to_l2_rate")
    return cohorts.withColumn("enablement_score", F.col("cases") * burden * (F.col("avg_cycle_hours") / 10.0))

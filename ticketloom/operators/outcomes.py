"""Case lists by outcome: handoffs, closure quality, recurring problems and first-contact resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Usual lengths of the two global lists.
WORST_HANDOFF_ROWS = 200
PROBLEM_ROWS = 500

# The columns of each list, in order.
DIMENSIONS = ["variant", "priority", "issue_type", "report_channel"]

PINGPONG_COLUMNS = [
    "case_id",
    *DIMENSIONS,
    "cycle_hours",
    "customer_satisfaction",
    "escalation_count",
    "resolver_changes",
    "pingpong_transitions",
    "has_reopen",
    "has_reject",
    "met_sla",
]

WORST_HANDOFF_COLUMNS = [
    "case_id",
    *DIMENSIONS,
    "cycle_hours",
    "customer_satisfaction",
    "met_sla",
    "escalation_count",
    "resolver_changes",
    "has_reopen",
    "has_reject",
    "has_feedback",
]

CLOSURE_COLUMNS = [
    "case_id",
    *DIMENSIONS,
    "cycle_hours",
    "customer_satisfaction",
    "met_sla",
    "has_feedback",
    "has_reopen",
    "has_reject",
    "closed_without_feedback",
    "reopen_after_close_hours",
    "reopened_within_3h",
    "reopened_within_24h",
]

PROBLEM_COLUMNS = [
    "case_id",
    "issue_type",
    "priority",
    "variant",
    "report_channel",
    "cycle_hours",
    "customer_satisfaction",
    "met_sla",
    "has_reopen",
    "has_reject",
    "has_feedback",
    "short_description_raw",
    "short_description_norm",
]

PROBLEM_TOP_COLUMNS = [c for c in PROBLEM_COLUMNS if c != "has_feedback"]

RESOLUTION_COLUMNS = [
    "case_id",
    "solved_l1",
    "solved_l2",
    "solved_l3",
    "reopened",
    "escalated_to_l2",
    "escalated_to_l3",
    "resolution_level",
]

FCR_COLUMNS = [
    "case_id",
    *DIMENSIONS,
    "cycle_hours",
    "customer_satisfaction",
    "met_sla",
    "resolution_level",
    "fcr",
]


def swapped_level(closed: DataFrame) -> DataFrame:
    """Closed cases with at least one adjacent move between the levels L2 and L3."""
    return closed.filter(F.col("pingpong_transitions") > 0)


def pingpong_cases(closed: DataFrame) -> DataFrame:
    return swapped_level(closed).select(*PINGPONG_COLUMNS)


def by_handovers(closed: DataFrame) -> DataFrame:
    """The cases in the order of the list, most handed over first."""
    return closed.orderBy(
        F.desc_nulls_first("resolver_changes"),
        F.desc_nulls_first("escalation_count"),
        F.desc_nulls_first("cycle_hours"),
        "case_id",
    )


def worst_handoff_cases(closed: DataFrame, rows: int = WORST_HANDOFF_ROWS) -> DataFrame:
    return by_handovers(closed).select(*WORST_HANDOFF_COLUMNS).limit(rows)


def closure_compliance(closed: DataFrame) -> DataFrame:
    return closed.select(*CLOSURE_COLUMNS)


def problem_candidate_cases(closed: DataFrame) -> DataFrame:
    return closed.select(*PROBLEM_COLUMNS)


def by_length(closed: DataFrame) -> DataFrame:
    """The cases in the order of the list, longest first."""
    return closed.orderBy(
        F.desc_nulls_first("cycle_hours"),
        F.desc_nulls_first("has_reopen"),
        F.desc_nulls_first("has_reject"),
        "case_id",
    )


def problem_candidate_top_cases(closed: DataFrame, rows: int = PROBLEM_ROWS) -> DataFrame:
    return by_length(closed).select(*PROBLEM_TOP_COLUMNS).limit(rows)


def resolution_level(closed: DataFrame) -> DataFrame:
    return closed.select(*RESOLUTION_COLUMNS)


def fcr_cases(closed: DataFrame) -> DataFrame:
    return closed.select(*FCR_COLUMNS)

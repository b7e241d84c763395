"""Case-level facts: lifecycle, attributes, outcomes and the SLA verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.text import plain_words
from ticketloom.functions.times import hours_between
from ticketloom.reference import (
    CLOSED,
    CREATED,
    FEEDBACK,
    MOVED_TO_L2,
    MOVED_TO_L3,
    REJECTED,
    REOPENED,
    SOLVED,
)

FIRST_VALUE_COLUMNS = ["priority", "issue_type", "report_channel"]


def _listed(*codes: str) -> str:
    return f"event_code IN ({', '.join(repr(c) for c in codes)})"


_LOG_POSITION = "struct(ts, event_key)"
_IS_LEVEL_SWAP = "event_level <> next_event_level AND least(event_level, next_event_level) = 'L2'"

# Facts whose partial results combine, so that they can be pre-aggregated before a shuffle.
MERGEABLE_FACTS = {
    "created_at": f"coalesce(min(ts) FILTER (WHERE {_listed(CREATED)}), min(ts))",
    "closed_at": f"max(ts) FILTER (WHERE {_listed(CLOSED)})",
    "event_count": "count(1)",
    "escalation_count": f"count_if({_listed(*MOVED_TO_L2, *MOVED_TO_L3)})",
    "has_feedback": f"bool_or({_listed(FEEDBACK)})",
    "has_reopen": f"bool_or({_listed(REOPENED)})",
    "has_reject": f"bool_or({_listed(REJECTED)})",
    "customer_satisfaction": "max(customer_satisfaction)",
    "short_description_raw": "max(short_description)",
    **{f"solved_{level.lower()}": f"bool_or({_listed(code)})" for level, code in SOLVED.items()},
    "escalated_to_l2": f"bool_or({_listed(*MOVED_TO_L2)})",
    "escalated_to_l3": f"bool_or({_listed(*MOVED_TO_L3)})",
    # first non-blank value in log order
    **{c: f"min_by({c}, {_LOG_POSITION}) FILTER (WHERE {c} <> '')" for c in FIRST_VALUE_COLUMNS},
}

# Facts that compare an event with the last close of its case.
AFTER_CLOSE_FACTS = {
    "first_reopen_after_close": f"min(ts) FILTER (WHERE {_listed(REOPENED)} AND ts > last_close)",
    "last_solve": f"""max_by(event_code, {_LOG_POSITION})
        FILTER (WHERE {_listed(*SOLVED.values())} AND ts <= last_close)""",
}


def _variant_rank(copies: str, last_seen: str) -> str:
    """Smallest for the most frequent variant, then the latest seen, then the first by name."""
    return f"CASE WHEN variant <> '' THEN struct(-{copies} AS c, -{last_seen} AS t, variant) END"


def _aggregates(facts: dict[str, str]) -> list[Column]:
    return [F.expr(sql).alias(name) for name, sql in facts.items()]


def case_facts(normalized: DataFrame) -> DataFrame:
    """One row per case, open ones included, from events that are partitioned by case_id.

    All windows and the aggregate share that partitioning, so nothing here shuffles. Combining
    before a shuffle would not pay: the few events of a normal case lie far apart in a log. A query
    that reads some of the facts computes only those; Catalyst prunes the other windows and
    aggregates.
    """
    in_variant = "OVER (PARTITION BY case_id, variant)"
    # The order within the case first: it serves what is taken over the whole case.
    rows = normalized.selectExpr(
        "*", "lead(event_level) OVER (PARTITION BY case_id ORDER BY ts, event_key) AS next_event_level"
    ).selectExpr(
        "*",
        f"max(CASE WHEN {_listed(CLOSED)} THEN ts END) OVER (PARTITION BY case_id) AS last_close",
        _variant_rank(f"count(1) {in_variant}", f"unix_micros(max(ts) {in_variant})") + " AS variant_rank",
    )
    in_case = {
        **MERGEABLE_FACTS,
        **AFTER_CLOSE_FACTS,
        "distinct_resolvers": "bigint(size(collect_set(nullif(resolver, ''))))",
        "variant": "min(variant_rank).variant",
        "pingpong_transitions": f"count_if({_IS_LEVEL_SWAP})",
    }
    return rows.groupBy("case_id").agg(*_aggregates(in_case)).select("case_id", *FACT_COLUMNS)


def large_case_facts(
    normalized: DataFrame, sequence: DataFrame, per_case: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The same facts for cases that are too large for one task.

    `per_case` gives a frame with a row per case the hint to broadcast it, if there are few enough.

    Every step aggregates on the map side first, so a shuffle carries at most one row per task and
    case, resolver or variant. No task ever sees the events of a whole case.
    """
    merged = normalized.groupBy("case_id").agg(*_aggregates(MERGEABLE_FACTS))
    resolvers = (
        normalized.filter("resolver <> ''")
        .groupBy("case_id")
        .agg(F.count_distinct("resolver").alias("distinct_resolvers"))
    )
    variants = (
        normalized.filter("variant <> ''")
        .groupBy("case_id", "variant")
        .agg(F.count(F.lit(1)).alias("copies"), F.max(F.unix_micros("ts")).alias("last_seen"))
        .groupBy("case_id")
        .agg(F.expr(f"min({_variant_rank('copies', 'last_seen')}).variant").alias("variant"))
    )
    closes = per_case(merged.select("case_id", F.col("closed_at").alias("last_close")))
    after_close = (
        normalized.filter(_listed(REOPENED, *SOLVED.values()))
        .join(closes, "case_id")
        .groupBy("case_id")
        .agg(*_aggregates(AFTER_CLOSE_FACTS))
    )
    swaps = (
        sequence.filter(_IS_LEVEL_SWAP)
        .groupBy("case_id")
        .agg(F.count(F.lit(1)).alias("pingpong_transitions"))
    )
    facts = merged
    for part in (resolvers, variants, after_close, swaps):
        facts = facts.join(part, "case_id", "left")
    return facts.na.fill(0, ["distinct_resolvers", "pingpong_transitions"]).select(
        "case_id", *FACT_COLUMNS
    )


# The columns of the relation, in order.
FACT_COLUMNS = [
    "variant",
    *FIRST_VALUE_COLUMNS,
    "created_at",
    "closed_at",
    "event_count",
    "distinct_resolvers",
    "escalation_count",
    "has_feedback",
    "has_reopen",
    "has_reject",
    "customer_satisfaction",
    "short_description_raw",
    "solved_l1",
    "solved_l2",
    "solved_l3",
    "escalated_to_l2",
    "escalated_to_l3",
    "first_reopen_after_close",
    "last_solve",
    "pingpong_transitions",
]

# The columns of the relation, in order.
BOUNDS_COLUMNS = [
    "case_id",
    "created_at",
    "closed_at",
    "event_count",
    "distinct_resolvers",
    "escalation_count",
    "has_feedback",
    "has_reopen",
    "has_reject",
    "customer_satisfaction",
]

# The columns of the relation, in order.
CASE_COLUMNS = [
    "case_id",
    "variant",
    "priority",
    "issue_type",
    "report_channel",
    "created_at",
    "closed_at",
    "cycle_hours",
    "event_count",
    "distinct_resolvers",
    "resolver_changes",
    "escalation_count",
    "has_feedback",
    "has_reopen",
    "has_reject",
    "customer_satisfaction",
]


def case_bounds(facts: DataFrame) -> DataFrame:
    return facts.select(*BOUNDS_COLUMNS)


def first_nonblank(facts: DataFrame) -> DataFrame:
    return facts.select("case_id", *FIRST_VALUE_COLUMNS)


def variant_mode(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("variant").isNotNull()).select("case_id", "variant")


def closed_cases(facts: DataFrame, sla_policy: DataFrame) -> DataFrame:
    """Every closed case with all derived columns; the other case relations are projections of it."""
    level = " ".join(f"WHEN '{code}' THEN '{name}'" for name, code in SOLVED.items())
    flags = ["solved_l1", "solved_l2", "solved_l3", "escalated_to_l2", "escalated_to_l3"]
    kept = [c for c in facts.columns if c not in flags]
    closed = facts.filter("closed_at >= created_at").select(
        *kept,
        hours_between(F.col("created_at"), F.col("closed_at")).alias("cycle_hours"),
        hours_between(F.col("closed_at"), F.col("first_reopen_after_close")).alias(
            "reopen_after_close_hours"
        ),
        plain_words(F.col("short_description_raw")).alias("short_description_norm"),
        F.expr("greatest(distinct_resolvers - 1, 0)").alias("resolver_changes"),
        F.expr("NOT coalesce(has_feedback, false)").alias("closed_without_feedback"),
        F.expr("coalesce(has_reopen, false)").alias("reopened"),
        F.expr(f"CASE last_solve {level} ELSE 'Unknown' END").alias("resolution_level"),
        *[F.expr(f"coalesce({c}, false)").alias(c) for c in flags],
    )
    return closed.join(sla_policy, "priority", "left").selectExpr(
        "*",
        "coalesce(reopen_after_close_hours <= 3, false) AS reopened_within_3h",
        "coalesce(reopen_after_close_hours <= 24, false) AS reopened_within_24h",
        "cycle_hours <= double(target_hours) AS met_sla",
        """resolution_level = 'L1' AND NOT reopened AND NOT escalated_to_l2
            AND NOT escalated_to_l3 AS fcr""",
    )


def case(closed: DataFrame) -> DataFrame:
    return closed.select(*CASE_COLUMNS)


def case_sla(closed: DataFrame) -> DataFrame:
    return closed.select(*CASE_COLUMNS, "target_hours", "met_sla")

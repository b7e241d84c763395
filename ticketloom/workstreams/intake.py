"""Intake channels inside a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import measures as m
from ticketloom.operators.scope import fill_dimensions
from ticketloom.workstreams.command import group_rollup

# Fixed value: length of the ranked issue mix.
ISSUE_MIX_ROWS = 20


def intake_channels(scoped: DataFrame) -> DataFrame:
    channels = group_rollup(scoped, "report_channel")
    return channels.withColumn("missing_feedback_rate", 1.0 - F.col("feedback_rate"))


def _channel_issue(scoped: DataFrame) -> DataFrame:
    pairs = fill_dimensions(scoped, "report_channel", "issue_type").groupBy("report_channel", "issue_type")
    reopen = m.known_share(F.col("has_reopen"), "reopen_rate")
    return pairs.agg(*m.columns(m.cases(), m.avg_cycle(), m.met_sla_rate(), reopen))


def intake_channel_issue(scoped: DataFrame) -> DataFrame:
    return _channel_issue(scoped).orderBy("report_channel", F.desc("cases"), "issue_type")


def intake_issue_mix(scoped: DataFrame, rows: int = ISSUE_MIX_ROWS) -> DataFrame:
    """The largest pairs of channel and issue type."""
    largest = [F.desc("cases"), "report_channel", "issue_type"]
    return _channel_issue(scoped).orderBy(*largest).limit(rows)


def intake_kpis(scoped: DataFrame) -> DataFrame:
    return scoped.agg(
        F.count_distinct("report_channel").alias("channels"),
        *m.columns(m.avg_cycle(), m.met_sla_rate(), m.rest_of(m.known_share(F.col("has_feedback"), "missing_feedback_rate"))),
    )


def intake_slowest_channel(scoped: DataFrame) -> DataFrame:
    slowest = group_rollup(scoped, "report_channel").select("report_channel", "avg_cycle_hours")
    return slowest.orderBy(F.desc_nulls_last("avg_cycle_hours"), "report_channel").limit(1)

"""Process flow inside a scope. `steps` is the sequence restricted by `scoped_steps`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.operators.scope import SCOPE_EVENT_COLUMNS, Scope, scope_cases, scope_detail, scope_rows
from ticketloom.plans.model import EventLogModel
from ticketloom.session import stored

# Lengths of the ranked lists.
DWELL_CHART_ROWS = 10
HOTSPOT_ROWS = 15
TOP_PATHS = 18

WORKLIST_COLUMNS = [
    "case_id",
    "variant",
    "priority",
    "issue_type",
    "report_channel",
    "event_steps",
    "cycle_hours",
    "met_sla",
    "has_reopen",
]


def scoped_steps(model: EventLogModel, scope: Scope) -> DataFrame:
    """Events of scoped cases that also pass the scope by their own values and day.

    The successor of an event was fixed over the whole log and stays as it is.
    """

    def of_part(sequence: DataFrame, closed: DataFrame) -> DataFrame:
        return scope_detail(sequence.select(*SCOPE_EVENT_COLUMNS), scope_cases(closed, scope), scope, "ts")

    return model.events_with_cases(of_part)


def _count():
    return F.count(F.lit(1))


def flow_transitions(steps: DataFrame) -> DataFrame:
    return (
        steps.filter(F.col("next_event").isNotNull())
        .groupBy(F.col("event").alias("from_event"), F.col("next_event").alias("to_event"))
        .agg(_count().alias("transition_count"), F.avg("delta_hours").alias("avg_delta_hours"))
    )


def flow_dwell(steps: DataFrame) -> DataFrame:
    """Dwell per event: last events count as occurrences, the mean skips them."""
    return (
        steps.groupBy("event")
        .agg(_count().alias("occurrences"), F.avg("delta_hours").alias("avg_dwell_hours"))
        .orderBy(F.desc_nulls_last("avg_dwell_hours"), "event")
    )


def flow_dwell_chart(steps: DataFrame, rows: int = DWELL_CHART_ROWS) -> DataFrame:
    return flow_dwell(steps).limit(rows).orderBy("avg_dwell_hours", "event")


def _case_edges(steps: DataFrame) -> DataFrame:
    """Uses and waiting of each edge in each case, in the partitioning that the events have by case."""
    return steps.groupBy("case_id", "event", "next_event").agg(
        _count().alias("n"), F.sum("delta_hours").alias("hours"), F.count("delta_hours").alias("waits")
    )


def flow_kpis(scoped: DataFrame, steps: DataFrame) -> DataFrame:
    """Four numbers of scoped cases and their steps; `scoped_flow_kpis` evaluates a model once for both."""
    return _kpis(scoped.select("variant").unionByName(_case_edges(steps), allowMissingColumns=True))


def scoped_flow_kpis(model: EventLogModel, scope: Scope) -> DataFrame:
    """The same of a model's scope: cases, also those without steps, meet their edges, and nothing is evaluated twice."""

    def of_part(sequence: DataFrame, closed: DataFrame) -> DataFrame:
        edges = _case_edges(scope_rows(sequence.select(*SCOPE_EVENT_COLUMNS), scope, "ts"))
        return scope_cases(closed, scope).select("case_id", "variant").distinct().join(edges, "case_id", "left")

    return _kpis(model.events_with_cases(of_part))


def _kpis(rows: DataFrame) -> DataFrame:
    """From edges within cases, and cases without any: one shuffle, grouped by variant, by case and by edge at once."""
    sets = rows.groupingSets(
        [["variant"], ["case_id"], ["event", "next_event"]], "variant", "case_id", "event", "next_event"
    ).agg(
        F.grouping_id().alias("by"), F.sum("n").alias("n"), F.sum("hours").alias("hours"), F.sum("waits").alias("waits")
    )
    # Each bit is a column that a row is not grouped by.
    variant, case, edge = (F.col("by") == F.lit(by) for by in (0b0111, 0b1011, 0b1100))
    per_event = sets.groupBy("by", "event").agg(
        F.count("variant").alias("variants"),
        F.sum("n").alias("steps"),
        F.count("n").alias("cases"),
        F.count("next_event").alias("targets"),
        (F.sum("hours") / F.nullif(F.sum("waits"), F.lit(0))).alias("dwell"),
    )
    return per_event.agg(
        F.coalesce(F.sum(F.when(variant, F.col("variants"))), F.lit(0)).alias("variants"),
        F.max(F.when(case, F.col("steps") / F.nullif(F.col("cases"), F.lit(0)))).alias("avg_steps"),
        F.coalesce(F.sum(F.when(edge, F.col("targets"))), F.lit(0)).alias("transitions"),
        F.max(F.when(edge, F.col("dwell"))).alias("slowest_dwell_hours"),
    )


def flow_hotspots(steps: DataFrame, rows: int = HOTSPOT_ROWS) -> DataFrame:
    return (
        flow_transitions(steps)
        .orderBy(F.desc_nulls_last("avg_delta_hours"), F.desc("transition_count"), "from_event", "to_event")
        .limit(rows)
    )


def flow_worklist(model: EventLogModel, scope: Scope) -> DataFrame:
    """Every scoped case with the number of its scoped events, most steps first.

    The join on the scoped cases drops all other counts, so events are not matched with cases
    before. A total order samples its input first; the rows are shuffled before it, so that the
    sample is drawn from these few columns and the joins below run once.
    """

    def of_part(sequence: DataFrame, closed: DataFrame) -> DataFrame:
        events = scope_rows(sequence.select(*SCOPE_EVENT_COLUMNS), scope, "ts")
        counts = events.groupBy("case_id").agg(_count().alias("event_steps"))
        return scope_cases(closed, scope).join(counts, "case_id", "left").select(*WORKLIST_COLUMNS)

    return (
        model.events_with_cases(of_part)
        .hint("rebalance")
        .orderBy(F.desc_nulls_last("event_steps"), F.desc("cycle_hours"), "case_id")
    )


def flow_top_paths(steps: DataFrame, rows: int = TOP_PATHS) -> DataFrame:
    """The most used edges with node numbers: sources in order of appearance, then targets."""
    ranked = (
        flow_transitions(steps)
        .orderBy(F.desc("transition_count"), "from_event", "to_event")
        .limit(rows)
    )
    # At most `rows` rows from here on, written because they are read for the edges, sources and targets.
    ranked = stored(ranked, "paths")
    by_use = Window.orderBy(F.desc("transition_count"), "from_event", "to_event")
    edges = ranked.withColumn("position", F.row_number().over(by_use))
    appearances = F.array(
        F.struct(F.col("from_event").alias("name"), F.col("position").alias("place")),
        F.struct(F.col("to_event").alias("name"), (F.col("position") + rows).alias("place")),
    )
    nodes = (
        edges.select(F.inline(appearances))
        .groupBy("name")
        .agg(F.min("place").alias("place"))
        .select("name", (F.row_number().over(Window.orderBy("place")) - 1).alias("id"))
    )
    sources = nodes.select(F.col("name").alias("from_event"), F.col("id").alias("source_id"))
    targets = nodes.select(F.col("name").alias("to_event"), F.col("id").alias("target_id"))
    return edges.join(sources, "from_event").join(targets, "to_event").select(
        "position",
        "from_event",
        "to_event",
        "source_id",
        "target_id",
        "transition_count",
        "avg_delta_hours",
    )

"""Event-level relations: canonical codes, order within a case, and the process graph."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions import measures as m
from ticketloom.functions.times import hours_between
from ticketloom.operators.percentiles import summarize
from ticketloom.reference import LEVEL_CODES
from ticketloom.session import broadcast_up_to, stored

NEXT_COLUMNS = ["ts", "event", "raw_event_name", "event_code", "event_level"]

# Rows of a slice up to which a task orders it.
SLICE_ROWS = 2_000_000


_LEVEL = "CASE {} END".format(
    " ".join(f"WHEN event_code IN ({', '.join(map(repr, codes))}) THEN '{name}'" for name, codes in LEVEL_CODES.items())
)


def event_normalized(events: DataFrame, event_alias: DataFrame) -> DataFrame:
    """Canonical code and support level per event; an unknown label is kept as it is."""
    alias = event_alias.withColumnRenamed("raw_event_name", "event")
    return events.join(alias, "event", "left").selectExpr(
        "event_key",
        "case_id",
        "variant",
        "priority",
        "reporter",
        "ts",
        "event AS raw_event_name",
        "coalesce(event_code, event) AS event",
        "event_code",
        "issue_type",
        "resolver",
        "report_channel",
        "short_description",
        "customer_satisfaction",
        f"{_LEVEL} AS event_level",
    )


def _with_next(rows: DataFrame) -> DataFrame:
    return rows.withColumn("delta_hours", hours_between(F.col("ts"), F.col("next_ts")))


def sequence_events(normalized: DataFrame) -> DataFrame:
    """Position and successor of each event within its case, one case inside one task."""
    in_case = Window.partitionBy("case_id").orderBy("ts", "event_key")
    return _with_next(
        normalized.withColumns(
            {
                "seq": F.row_number().over(in_case).cast("bigint"),
                **{f"next_{c}": F.lead(c).over(in_case) for c in NEXT_COLUMNS},
            }
        )
    )


def slices_for(rows: int, rows_per_slice: int, tasks: int) -> int:
    """Slices of about rows_per_slice rows, but no more than tasks unless slices above SLICE_ROWS would need them."""
    return max(2, min(math.ceil(rows / rows_per_slice), max(tasks, math.ceil(rows / SLICE_ROWS))))


def sequence_large_cases(normalized: DataFrame, rows_per_slice: int, large_cases: int) -> DataFrame:
    """The same relation for cases that are too large for one task.

    The events are range-partitioned on (case_id, ts, event_key). That key is unique, so the
    ranges stay even when one case, or one instant, holds all rows. The ranges are written once,
    because they rest on sampling and both uses below must see the same ones. Each slice is then
    ordered on its own, and one row per slice carries the position and the successor across.
    """
    tasks = int(normalized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = slices_for(normalized.count(), rows_per_slice, tasks)
    ranged = stored(
        normalized.repartitionByRange(slices, "case_id", "ts", "event_key").withColumn(
            "slice", F.spark_partition_id()
        ),
        "event-slices",
    )

    in_slice = Window.partitionBy("case_id", "slice").orderBy("ts", "event_key")
    local = ranged.withColumns(
        {
            "seq": F.row_number().over(in_slice).cast("bigint"),
            "following": F.lead(F.struct(*NEXT_COLUMNS)).over(in_slice),
        }
    )

    across = Window.partitionBy("case_id").orderBy("slice")
    edges = (
        ranged.groupBy("case_id", "slice")
        .agg(
            F.count(F.lit(1)).alias("slice_rows"),
            F.min(F.struct("ts", "event_key", *NEXT_COLUMNS[1:])).alias("head"),
        )
        .select(
            "case_id",
            "slice",
            F.sum("slice_rows")
            .over(across.rowsBetween(Window.unboundedPreceding, -1))
            .alias("rows_before"),
            F.lead("head").over(across).alias("next_head"),
        )
    )
    # A row per case, and one more for each end of a slice, which cuts one case at most.
    joined = local.join(broadcast_up_to(edges, large_cases + slices), ["case_id", "slice"], "left")
    return _with_next(
        joined.select(
            *normalized.columns,
            (F.col("seq") + F.coalesce("rows_before", F.lit(0))).alias("seq"),
            *[
                F.coalesce(f"following.{c}", F.when(F.col("following").isNull(), F.col(f"next_head.{c}")))
                .alias(f"next_{c}")
                for c in NEXT_COLUMNS
            ],
        )
    )


# The columns of the relation, in order.
SEQUENCE_COLUMNS = [
    "case_id",
    "variant",
    "priority",
    "reporter",
    "ts",
    "event",
    "raw_event_name",
    "event_code",
    "event_level",
    "issue_type",
    "resolver",
    "report_channel",
    "short_description",
    "customer_satisfaction",
    "seq",
    "next_ts",
    "next_event",
    "next_raw_event_name",
    "next_event_code",
    "next_event_level",
    "delta_hours",
]


def _steps(sequence: DataFrame) -> DataFrame:
    return sequence.filter(F.col("next_event").isNotNull() & (F.col("delta_hours") >= 0)).select(
        "variant",
        F.col("event").alias("from_event"),
        F.col("next_event").alias("to_event"),
        "delta_hours",
    )


def transition_summary(sequence: DataFrame, in_task: bool = False) -> DataFrame:
    """Edges of the process graph with count, mean, median and 90th percentile of the wait."""
    return summarize(
        _steps(sequence),
        ["from_event", "to_event"],
        [m.cases("transition_count"), m.mean("delta_hours", "avg_delta_hours")],
        "delta_hours",
        {"median_delta_hours": 0.5, "p90_delta_hours": 0.9},
        in_task,
    )


def dwell_by_event(sequence: DataFrame, in_task: bool = False) -> DataFrame:
    """Time until the next event of the case; the last event of a case has no dwell."""
    return summarize(
        _steps(sequence).withColumnRenamed("from_event", "event"),
        ["event"],
        [m.cases("occurrences"), m.mean("delta_hours", "avg_dwell_hours")],
        "delta_hours",
        {"median_dwell_hours": 0.5, "p90_dwell_hours": 0.9},
        in_task,
    )


def transition_by_variant(sequence: DataFrame) -> DataFrame:
    """Edges per variant of the event itself, which may differ from the variant of its case."""
    return _steps(sequence).groupBy("variant", "from_event", "to_event").agg(
        F.count(F.lit(1)).alias("transition_count"), F.avg("delta_hours").alias("avg_delta_hours")
    )

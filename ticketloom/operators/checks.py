"""Data-quality checks of the log and its dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.reference import ReferenceData


def unmapped_events(normalized: DataFrame) -> DataFrame:
    """Raw labels without a canonical code and how often they occur; empty when all are mapped."""
    unknown = normalized.filter(F.col("event_code").isNull())
    return unknown.groupBy("raw_event_name").agg(F.count(F.lit(1)).alias("events"))


def reference_counts(dims: dict[str, DataFrame]) -> DataFrame:
    """Row count per dimension; a dimension with none was not seeded."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in dims.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def alias_integrity(event_alias: DataFrame, event_catalog: DataFrame) -> DataFrame:
    """Aliases whose code is not in the catalog."""
    known = event_catalog.select(F.col("event_name").alias("event_code"))
    return event_alias.join(known, "event_code", "left_anti").select("raw_event_name", "event_code")


def policy_integrity(sla_policy: DataFrame) -> DataFrame:
    """Priorities that occur more than once or allow no time."""
    per_priority = sla_policy.groupBy("priority").agg(
        F.count(F.lit(1)).alias("policies"),
        F.count_if(F.coalesce(F.col("target_hours") <= 0, F.lit(True))).alias("bad_targets"),
    )
    broken = (F.col("policies") > 1) | (F.col("bad_targets") > 0) | F.col("priority").isNull()
    return per_priority.filter(broken)


def log_constraints(keyed: DataFrame) -> DataFrame:
    """One row: missing mandatory values, repeated keys, and the size of the largest case."""
    per_key = keyed.groupBy("event_key", "case_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(F.col("case_id").isNull()).alias("missing_case_id"),
        F.count_if(F.col("ts").isNull()).alias("missing_ts"),
        F.count_if(F.col("event").isNull()).alias("missing_event"),
    )
    per_case = per_key.groupBy("case_id").agg(
        F.sum("copies").alias("rows"),
        F.count_if(F.col("copies") > 1).alias("repeated_keys"),
        F.sum(F.col("copies") - 1).alias("surplus_rows"),
        *[F.sum(c).alias(c) for c in ("missing_case_id", "missing_ts", "missing_event")],
    )
    return per_case.agg(
        F.sum("rows").alias("events"),
        F.sum("missing_case_id").alias("missing_case_id"),
        F.sum("missing_ts").alias("missing_ts"),
        F.sum("missing_event").alias("missing_event"),
        F.sum("repeated_keys").alias("repeated_keys"),
        F.sum("surplus_rows").alias("surplus_rows"),
        F.max("rows").alias("largest_case"),
    )


def verification(normalized: DataFrame, keyed: DataFrame, reference: ReferenceData) -> DataFrame:
    """All checks as rows (check, violations, passed)."""
    dims = {
        "event_alias": reference.event_alias,
        "event_catalog": reference.event_catalog,
        "sla_policy": reference.sla_policy,
    }
    found = {
        "unmapped_events": unmapped_events(normalized).agg(F.coalesce(F.sum("events"), F.lit(0))),
        "unseeded_dimensions": reference_counts(dims).agg(F.count_if(F.col("row_count") == 0)),
        "unknown_alias_codes": alias_integrity(reference.event_alias, reference.event_catalog).agg(F.count(F.lit(1))),
        "broken_policies": policy_integrity(reference.sla_policy).agg(F.count(F.lit(1))),
        "log_constraints": log_constraints(keyed).selectExpr(
            "coalesce(missing_case_id + missing_ts + missing_event + surplus_rows, 0)"
        ),
    }
    rows = [df.toDF("violations").select(F.lit(name).alias("check"), "violations") for name, df in found.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("violations") == 0)


def require_verified(verified: DataFrame) -> None:
    """Raises a ValueError that names the failed checks, if any failed."""
    failed = [f"{r['check']}: {r['violations']}" for r in verified.where("NOT passed").orderBy("check").collect()]
    if failed:
        raise ValueError(f"verification failed, violations by check: {', '.join(failed)}")


def load_range(cases: DataFrame) -> DataFrame:
    return cases.agg(F.min("created_at").alias("min_created"), F.max("closed_at").alias("max_closed"))

"""Cases that are too large for one task are set apart, and computed in slices with the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.session import broadcast_up_to, stored
from ticketloom.sources.event_store import dedupe_events, unique_in_case

IN_TASK_ROWS = 2_000_000

# Rows of a case at the limit that a sample of the log holds on average; half of them make a candidate.
SAMPLED = 400


@dataclass(frozen=True)
class LogParts:
    """A log of unique events, its large cases set apart.

    `normal` is partitioned by case_id and holds no case that is too large for a task. `large`
    holds the others, `large_cases` of them, in any partitioning, or is None.
    """

    normal: DataFrame
    large: DataFrame | None
    in_task_rows: int
    large_cases: int = 0

    @property
    def whole(self) -> DataFrame:
        return self.normal if self.large is None else self.normal.unionByName(self.large)

    def per_large_case(self, df: DataFrame) -> DataFrame:
        """A frame with a row per large case, broadcast if there are few enough."""
        return broadcast_up_to(df, self.large_cases)


def split_log(
    rows: DataFrame,
    to_events: Callable[[DataFrame], DataFrame] = lambda part: part,
    unique: bool = True,
    in_task_rows: int = IN_TASK_ROWS,
    large_to_events: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> LogParts:
    """Split source rows by the size of their case, then turn each part into keyed events.

    `rows` has case_id and one row per event, copies included. The normal part is shuffled once, by
    case and before `to_events` widens it; all that follows, dropping of copies included, keeps
    that partitioning. `large_to_events` gets the rows of the large cases and their ids, so that it can
    add what it knows per case without gathering the rows of one; copies are dropped on the map side.
    """
    ids = large_case_ids(rows, in_task_rows)
    drop_in_case = (lambda events: events) if unique else unique_in_case
    drop_anywhere = (lambda events: events) if unique else dedupe_events

    normal, large, count = rows, None, 0
    if ids is not None:
        count = ids.count()
        ids = broadcast_up_to(ids, count)
        normal = rows.join(ids, "case_id", "left_anti")
        part = rows.join(ids, "case_id", "left_semi")
        large = drop_anywhere(large_to_events(part, ids) if large_to_events else to_events(part))
    normal = drop_in_case(to_events(normal.repartition("case_id")))
    return LogParts(normal, large, in_task_rows, count)


def large_case_ids(rows: DataFrame, in_task_rows: int) -> DataFrame | None:
    """Ids of the cases with more rows than one task should sort, or None without any.

    A sample of case_id alone names the candidates, of which there are fewer than two per in_task_rows
    rows; only their rows are counted. At a limit of two million rows a case just above it is missed
    only if 400 expected rows turn out as fewer than 200; a missed case costs time, not results.
    """
    share = min(1.0, SAMPLED / in_task_rows)
    ids = rows.select("case_id")
    if share < 1.0:
        sampled = ids.sample(share, seed=11).groupBy("case_id").count()
        candidates = stored(sampled.filter(F.col("count") * 2 >= share * in_task_rows).select("case_id"), "candidates")
        if candidates.isEmpty():
            return None
        ids = ids.join(broadcast_up_to(candidates, candidates.count()), "case_id", "left_semi")
    counted = ids.groupBy("case_id").count().filter(F.col("count") > in_task_rows)
    found = stored(counted.select("case_id"), "large-cases")
    return None if found.isEmpty() else found

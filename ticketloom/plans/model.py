"""The relations of one event log, built lazily and shared between queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.operators import cases, events
from ticketloom.plans.skew import IN_TASK_ROWS, LogParts, split_log
from ticketloom.reference import ReferenceData
from ticketloom.session import require_utc


class EventLogModel:
    """Derived relations over a log of unique events.

    `in_task` is the caller's word that no group has more different values than a task holds, for the
    percentiles of the summaries; nothing sets it by the size of the data.
    """

    def __init__(self, parts: LogParts, reference: ReferenceData | None = None, in_task: bool = False):
        spark = parts.normal.sparkSession
        require_utc(spark)
        self.parts = parts
        self.in_task = in_task
        self.reference = reference or ReferenceData.defaults(spark)

    @classmethod
    def over(
        cls, log: DataFrame, reference: ReferenceData | None = None, in_task_rows: int = IN_TASK_ROWS
    ) -> "EventLogModel":
        """A model over a stored log, in which every event_key is unique."""
        return cls(split_log(log, in_task_rows=in_task_rows), reference)

    @cached_property
    def log(self) -> DataFrame:
        if self.parts is None:
            raise ValueError("a model that was opened has no raw log")
        return self.parts.whole

    @cached_property
    def normalized(self) -> DataFrame:
        return self._normalized(self.log)

    def _normalized(self, part: DataFrame) -> DataFrame:
        return events.event_normalized(part, self.reference.event_alias)

    @cached_property
    def _large(self) -> DataFrame | None:
        return None if self.parts.large is None else self._normalized(self.parts.large)

    @cached_property
    def _sequences(self) -> list[DataFrame]:
        rows = events.sequence_events(self._normalized(self.parts.normal))
        found = [rows.select(*events.SEQUENCE_COLUMNS)]
        if self._large is not None:
            large = events.sequence_large_cases(self._large, self.parts.in_task_rows, self.parts.large_cases)
            found.append(large.select(*events.SEQUENCE_COLUMNS))
        return found

    @cached_property
    def _facts(self) -> list[DataFrame]:
        found = [cases.case_facts(self._normalized(self.parts.normal))]
        if self._large is not None:
            found.append(cases.large_case_facts(self._large, self._sequences[1], self.parts.per_large_case))
        return found

    @cached_property
    def _closed(self) -> list[DataFrame]:
        first, *large = (cases.closed_cases(f, self.reference.sla_policy) for f in self._facts)
        return [first, *[self.parts.per_large_case(c) for c in large]]

    @cached_property
    def sequence(self) -> DataFrame:
        """event_seq: position, successor and waiting time of every event."""
        return _together(self._sequences)

    @cached_property
    def facts(self) -> DataFrame:
        """One row per case, open cases included."""
        return _together(self._facts)

    @cached_property
    def closed(self) -> DataFrame:
        """One row per closed case with every derived column."""
        return _together(self._closed)

    def events_with_cases(self, build: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """`build(sequence, closed)`, for a join of events with their own cases.

        Built for each part of the log: normal cases meet their events in the partitioning that
        both have; large cases come with a hint to broadcast them if there are few enough.
        """
        return _together([build(s, c) for s, c in zip(self._sequences, self._closed)])

    def materialize(self, path: str) -> "EventLogModel":
        """Write the two relations that everything else reads, and return a model over them.

        Both are clustered by month and sorted by time, so that the statistics of the files prune
        scans by date.
        """
        _write_by_time(self.sequence, "ts", f"{path}/event_seq")
        _write_by_time(self.closed, "created_at", f"{path}/closed_cases")
        return self.open(self.parts.normal.sparkSession, path, self.reference, self.in_task)

    @classmethod
    def open(
        cls, spark: SparkSession, path: str, reference: ReferenceData | None = None, in_task: bool = False
    ) -> "EventLogModel":
        """A model over the relations that `materialize` wrote, in any session; the raw log is not needed.

        It has `sequence` and `closed` and all that is made of them, but neither log nor open cases.
        """
        stored = (spark.read.parquet(f"{path}/{name}") for name in ("event_seq", "closed_cases"))
        return cls.of_relations(*stored, reference, in_task)

    @classmethod
    def of_relations(
        cls, sequence: DataFrame, closed: DataFrame, reference: ReferenceData | None = None, in_task: bool = False
    ) -> "EventLogModel":
        """A model over its two relations, as they were computed before."""
        spark = sequence.sparkSession
        require_utc(spark)
        model = cls.__new__(cls)
        model.parts, model.in_task = None, in_task
        model.reference = reference or ReferenceData.defaults(spark)
        model._sequences, model._closed = [sequence], [closed]
        return model


def _write_by_time(df: DataFrame, time: str, path: str) -> None:
    """One shuffle without sampling; rebalance also splits a month that holds much of the log."""
    month = F.trunc(time, "month").alias("_month")
    clustered = df.select("*", month).hint("rebalance", "_month").sortWithinPartitions(time)
    clustered.drop("_month").write.mode("overwrite").parquet(path)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

"""Scoping by date and dimension, filter domains, labels and the column lists of each relation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.functions.text import or_unspecified
from ticketloom.operators import outcomes

FILTER_DIMENSIONS = ["priority", "issue_type", "variant", "report_channel"]

SCOPE_CASE_COLUMNS = [
    "case_id",
    *outcomes.DIMENSIONS,
    "created_at",
    "closed_at",
    "cycle_hours",
    "event_count",
    "escalation_count",
    "resolver_changes",
    "has_feedback",
    "has_reopen",
    "has_reject",
    "customer_satisfaction",
    "met_sla",
]

SCOPE_EVENT_COLUMNS = ["case_id", *outcomes.DIMENSIONS, "ts", "seq", "event", "next_event", "delta_hours"]


@dataclass(frozen=True)
class Scope:
    """Inclusive range of days and selected values per dimension; no selection means all."""

    start: dt.date
    end: dt.date
    priority: Sequence[str] = ()
    issue_type: Sequence[str] = ()
    variant: Sequence[str] = ()
    report_channel: Sequence[str] = ()

    def days(self, column: str) -> Column:
        """A comparison on the raw column, so that it reaches the file statistics of a scan."""
        first = dt.datetime.combine(self.start, dt.time())
        after = dt.datetime.combine(self.end + dt.timedelta(days=1), dt.time())
        return (F.col(column) >= F.lit(f"{first} UTC").cast("timestamp")) & (
            F.col(column) < F.lit(f"{after} UTC").cast("timestamp")
        )

    def selections(self) -> dict[str, list[str]]:
        chosen = {d: list(getattr(self, d)) for d in FILTER_DIMENSIONS}
        return {d: values for d, values in chosen.items() if values}

    def dimensions(self, available: Sequence[str] = FILTER_DIMENSIONS) -> Column:
        tests = [
            or_unspecified(F.col(d)).isin(values)
            for d, values in self.selections().items()
            if d in available
        ]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def fill_dimensions(df: DataFrame, *dimensions: str) -> DataFrame:
    return df.withColumns({d: or_unspecified(F.col(d)) for d in dimensions})


def _filled_where_selected(df: DataFrame, scope: Scope) -> DataFrame:
    """A selected dimension shows the fill word in its result; the others stay untouched."""
    return fill_dimensions(df, *[d for d in scope.selections() if d in df.columns])


def scope_cases(closed: DataFrame, scope: Scope) -> DataFrame:
    inside = closed.filter(scope.days("created_at") & scope.dimensions())
    return _filled_where_selected(inside, scope)


def scope_rows(detail: DataFrame, scope: Scope, date_column: str | None = None) -> DataFrame:
    """Rows of a detail relation that pass the scope by their own values and, if asked, their day."""
    tests = scope.dimensions(detail.columns)
    if date_column is not None:
        tests = tests & scope.days(date_column)
    return _filled_where_selected(detail.filter(tests), scope)


def scope_detail(
    detail: DataFrame, scoped: DataFrame, scope: Scope, date_column: str | None = None
) -> DataFrame:
    """The same, and only rows that belong to scoped cases."""
    kept = scope_rows(detail, scope, date_column)
    return kept.join(scoped.select("case_id"), "case_id", "left_semi")


def filter_dates(closed: DataFrame) -> DataFrame:
    return closed.agg(
        F.min(F.to_date("created_at")).alias("min_date"), F.max(F.to_date("created_at")).alias("max_date")
    )


def filter_values(closed: DataFrame) -> DataFrame:
    """Selectable values of all four dimensions, from one scan."""
    pairs = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), or_unspecified(F.col(d)).alias("value"))
            for d in FILTER_DIMENSIONS
        ]
    )
    return closed.select(F.inline(pairs)).distinct().orderBy("dimension", "value")


# Words for true and false by a part of the column name, tested in this order.
STATUS_WORDS = [
    ("reopen", ("Reopened", "Stable")),
    ("feedback", ("Feedback", "Feedback Missing")),
    ("reject", ("Rejected", "Accepted")),
    ("sla", ("Met", "Missed")),
]
OTHER_WORDS = ("Yes", "No")


def status_labels(df: DataFrame) -> DataFrame:
    """Boolean columns as words; a column that says feedback is absent is read the other way round."""
    labels = {}
    for field in df.schema.fields:
        if not isinstance(field.dataType, T.BooleanType):
            continue
        words = next((w for part, w in STATUS_WORDS if part in field.name), OTHER_WORDS)
        if "without_feedback" in field.name:
            words = tuple(reversed(words))
        labels[field.name] = F.when(F.col(field.name), words[0]).when(~F.col(field.name), words[1])
    return df.withColumns(labels)

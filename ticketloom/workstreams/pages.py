"""All rollups of a page of analytics in one pass over its scope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import measures as m
from ticketloom.functions.measures import Measure, columns
from ticketloom.operators.percentiles import summarize
from ticketloom.operators.scope import fill_dimensions


@dataclass(frozen=True)
class Page:
    """The rollups of a page by name, each with the dimensions it groups by, and the measures of all."""

    rollups: dict[str, tuple[str, ...]]
    measures: list[Measure]
    p90: bool = False

    @property
    def dimensions(self) -> list[str]:
        return list(dict.fromkeys(d for listed in self.rollups.values() for d in listed))


def _level(name: str) -> Measure:
    return m.share(F.col("resolution_level") == name, f"{name.lower()}_rate")


def pages() -> dict[str, Page]:
    """The pages of the scoped workstreams."""
    feedback = m.known_share(F.col("has_feedback"), "feedback_rate")
    changes = F.col("resolver_changes")
    return {
        "command": Page(
            {"all": (), "variant": ("variant",), "issue": ("issue_type",), "channel": ("report_channel",)},
            [*m.core(), *m.outcome_rates(), feedback, *m.handoff_means()],
            p90=True,
        ),
        "handoffs": Page(
            {"all": (), "issue": ("issue_type",)},
            [
                *m.core(),
                *m.handoff_means(),
                m.share(changes > 0, "handoff_rate"),
                m.share(changes >= 2, "high_handoff_rate"),
                m.share(F.col("pingpong_transitions") > 0, "pingpong_rate"),
            ],
        ),
        "quality": Page(
            {"all": (), "issue": ("issue_type",), "priority": ("priority",)},
            [
                *m.core(),
                m.rate("closed_without_feedback", "closed_without_feedback_rate"),
                m.rate("reopened_within_24h", "reopened_within_24h_rate"),
                m.rate("has_reject", "reject_rate"),
            ],
        ),
        "intake": Page(
            {"all": (), "channel": ("report_channel",), "channel_issue": ("report_channel", "issue_type")},
            [*m.core(), *m.outcome_rates(), feedback, *m.handoff_means()],
        ),
        "enablement": Page(
            {"all": (), "issue": ("issue_type",)},
            [*m.core(), m.rate("fcr", "fcr_rate"), *map(_level, ("L1", "L2", "L3"))],
        ),
    }


def roll_up(scoped: DataFrame, page: Page, in_task: bool = False) -> DataFrame:
    """A row per rollup and group: rollup, the page's dimensions (NULL where not grouped by), the measures.

    The scope is evaluated once. Every case counts once in each rollup, and is combined with others of its
    groups before the only shuffle of them.
    """
    dimensions = page.dimensions
    filled = fill_dimensions(scoped, *dimensions)
    rows = filled.withColumn("rollup", F.explode(F.array(*[F.lit(name) for name in page.rollups])))
    grouped = {
        d: F.when(F.col("rollup").isin([name for name, by in page.rollups.items() if d in by]), F.col(d))
        for d in dimensions
    }
    rows = rows.withColumns(grouped)
    keys = ["rollup", *dimensions]
    if page.p90:
        return summarize(rows, keys, page.measures, "cycle_hours", {"p90_cycle_hours": 0.9}, in_task)
    return rows.groupBy(*keys).agg(*columns(*page.measures))


def part(rolled_up: DataFrame, page: Page, rollup: str) -> DataFrame:
    """One rollup of a page."""
    others = [d for d in page.dimensions if d not in page.rollups[rollup]]
    return rolled_up.where(F.col("rollup") == rollup).drop("rollup", *others)

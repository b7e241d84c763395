"""Measures that the summaries and the scoped rollups share.

A measure is an aggregate that can be taken in two steps: parts over any share of a group's rows, and the
result over all its parts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """The count of rows, the share of those where a flag holds, or the mean, least or greatest of a value.

    `rest` is what a share or mean leaves to 1.
    """

    name: str
    kind: str
    of: Column
    rest: bool = False

    def alias(self, name: str) -> "Measure":
        return replace(self, name=name)

    def _named(self, value: Column) -> Column:
        return (F.lit(1.0) - value if self.rest else value).alias(self.name)

    def column(self) -> Column:
        """The measure over rows."""
        whole = {"count": F.count, "mean": F.avg, "min": F.min, "max": F.max}
        if self.kind == "share":
            return self._named(F.avg(F.when(self.of, 1.0).otherwise(0.0)))
        return self._named(whole[self.kind](self.of))

    def parts(self) -> dict[str, tuple[Column, str]]:
        """For each part its aggregate over rows, and the function that puts parts of one name together."""
        rows = {"_rows": (F.count(F.lit(1)), "sum")}
        if self.kind == "count":
            return rows
        if self.kind == "share":
            return rows | {f"_holds_{self.name}": (F.count_if(self.of), "sum")}
        if self.kind == "mean":
            return {f"_sum_{self.name}": (F.sum(self.of), "sum"), f"_count_{self.name}": (F.count(self.of), "sum")}
        return {f"_{self.kind}_{self.name}": (getattr(F, self.kind)(self.of), self.kind)}

    def merged(self) -> Column:
        """The measure over its parts."""
        # A group without values has a mean of NULL.
        if self.kind == "share":
            return self._named(F.try_divide(F.sum(f"_holds_{self.name}").cast("double"), F.sum("_rows")))
        if self.kind == "mean":
            return self._named(F.try_divide(F.sum(f"_sum_{self.name}"), F.sum(f"_count_{self.name}")))
        if self.kind == "count":
            return self._named(F.coalesce(F.sum("_rows"), F.lit(0)))
        (name, (_, together)), = self.parts().items()
        return self._named(getattr(F, together)(name))


def columns(*measures: Measure) -> list[Column]:
    return [measure.column() for measure in measures]


def share(flag: Column, name: str) -> Measure:
    """Share of rows where the flag holds; a missing flag counts as not holding."""
    return Measure(name, "share", flag)


def known_share(flag: Column, name: str) -> Measure:
    """Share of rows where the flag holds among the rows where it is known."""
    return Measure(name, "mean", flag.cast("double"))


def rest_of(measure: Measure) -> Measure:
    """1 minus a mean."""
    return replace(measure, rest=True)


def mean(value: str, name: str) -> Measure:
    return Measure(name, "mean", F.col(value).cast("double"))


def cases(name: str = "cases") -> Measure:
    return Measure(name, "count", F.lit(1))


def least(value: str, name: str) -> Measure:
    return Measure(name, "min", F.col(value))


def greatest(value: str, name: str) -> Measure:
    return Measure(name, "max", F.col(value))


def avg_cycle() -> Measure:
    return mean("cycle_hours", "avg_cycle_hours")


def avg_csat() -> Measure:
    return mean("customer_satisfaction", "avg_csat")


def met_sla_rate() -> Measure:
    return known_share(F.col("met_sla"), "met_sla_rate")


def rate(flag: str, name: str) -> Measure:
    return share(F.col(flag), name)


def handoff_means() -> list[Measure]:
    return [mean("escalation_count", "avg_escalations"), mean("resolver_changes", "avg_resolver_changes")]


def outcome_rates() -> list[Measure]:
    return [rate("has_reopen", "reopen_rate"), rate("has_reject", "reject_rate")]


def core() -> list[Measure]:
    return [cases(), avg_cycle(), avg_csat(), met_sla_rate()]

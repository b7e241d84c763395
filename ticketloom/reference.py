"""Reference dimensions: SLA policy, event catalog and raw-label aliases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.schema import ALIAS_COLUMNS, CATALOG_COLUMNS, SLA_COLUMNS

# Hours allowed per priority.
SLA_POLICY = [
    ("High", 8),
    ("Medium", 16),
    ("Low", 24),
]

# Canonical event codes with their meaning and owner.
EVENT_CATALOG = [
    ("ticket_created", "Ticket is created in the ITSM platform.", "Service Desk"),
    ("ticket_closed", "Ticket is formally closed in the ITSM platform.", "Service Desk"),
    ("customer_feedback_received", "Customer feedback or satisfaction is recorded.", "Service Desk"),
    ("ticket_reopened", "The incident is reopened after closure or failed resolution.", "Service Desk"),
    ("ticket_rejected", "The proposed resolution or closure is rejected.", "Service Desk"),
    ("ticket_solved_l1", "The incident is resolved by level 1 support.", "L1 Support"),
    ("ticket_solved_l2", "The incident is resolved by level 2 support.", "L2 Support"),
    ("ticket_solved_l3", "The incident is resolved by level 3 support.", "L3 Support"),
    ("escalated_to_l2", "The incident is escalated from level 1 to level 2 support.", "L1 Support"),
    ("assigned_to_l2", "The incident is assigned to level 2 support.", "Service Desk"),
    ("escalated_to_l3", "The incident is escalated from level 2 to level 3 support.", "L2 Support"),
    ("assigned_to_l3", "The incident is assigned to level 3 support.", "L2 Support"),
    ("assigned_to_l1", "The incident is assigned to level 1 support.", "Service Desk"),
    ("work_in_progress_l1", "The incident is actively being worked by level 1 support.", "L1 Support"),
    ("work_in_progress_l2", "The incident is actively being worked by level 2 support.", "L2 Support"),
    ("work_in_progress_l3", "The incident is actively being worked by level 3 support.", "L3 Support"),
]

# Raw labels of the source system and the codes they stand for.
EVENT_ALIASES = [
    ("Ticket created", "ticket_created"),
    ("Ticket closed", "ticket_closed"),
    ("Customer feedback received", "customer_feedback_received"),
    ("Ticket reopened by customer", "ticket_reopened"),
    ("Ticket reopened", "ticket_reopened"),
    ("Ticket rejected", "ticket_rejected"),
    ("Ticket rejected by customer", "ticket_rejected"),
    ("Ticket solved by level 1 support", "ticket_solved_l1"),
    ("Ticket solved by level 2 support", "ticket_solved_l2"),
    ("Ticket solved by level 3 support", "ticket_solved_l3"),
    ("Ticket escalated to level 2 support", "escalated_to_l2"),
    ("Level 1 escalates to level 2 support", "escalated_to_l2"),
    ("Ticket assigned to level 2 support", "assigned_to_l2"),
    ("Level 2 escalates to level 3 support", "escalated_to_l3"),
    ("Ticket escalated to level 3 support", "escalated_to_l3"),
    ("Ticket assigned to level 3 support", "assigned_to_l3"),
    ("Ticket assigned to level 1 support", "assigned_to_l1"),
    ("WIP - level 1 support", "work_in_progress_l1"),
    ("WIP - level 2 support", "work_in_progress_l2"),
    ("WIP - level 3 support", "work_in_progress_l3"),
    ("Ticket rejected by level 1 support", "ticket_rejected"),
    ("Level 2 support rejects the ticket", "ticket_rejected"),
]

# Canonical codes that place an event at a support level.
LEVEL_CODES = {
    "L1": ["ticket_solved_l1", "assigned_to_l1", "work_in_progress_l1"],
    "L2": ["ticket_solved_l2", "assigned_to_l2", "escalated_to_l2", "work_in_progress_l2"],
    "L3": ["ticket_solved_l3", "assigned_to_l3", "escalated_to_l3", "work_in_progress_l3"],
}

CREATED = "ticket_created"
CLOSED = "ticket_closed"
FEEDBACK = "customer_feedback_received"
REOPENED = "ticket_reopened"
REJECTED = "ticket_rejected"
SOLVED = {"L1": "ticket_solved_l1", "L2": "ticket_solved_l2", "L3": "ticket_solved_l3"}
MOVED_TO_L2 = ["escalated_to_l2", "assigned_to_l2"]
MOVED_TO_L3 = ["escalated_to_l3", "assigned_to_l3"]

# A dimension up to this many rows is sent to every executor; a larger one is joined by shuffle.
BROADCAST_DIM_ROWS = 100_000


@dataclass(frozen=True)
class ReferenceData:
    """The three dimensions as DataFrames, each marked for broadcast only once its size is known."""

    sla_policy: DataFrame
    event_catalog: DataFrame
    event_alias: DataFrame

    @classmethod
    def defaults(cls, spark: SparkSession) -> "ReferenceData":
        """The fixed values above, as constants of the plan rather than data sent from Python."""
        return cls(
            F.broadcast(_constant(spark, SLA_POLICY, SLA_COLUMNS)),
            F.broadcast(_constant(spark, EVENT_CATALOG, CATALOG_COLUMNS)),
            F.broadcast(_constant(spark, EVENT_ALIASES, ALIAS_COLUMNS)),
        )

    def replaced(self, **dims: DataFrame) -> "ReferenceData":
        """A copy with some dimensions given by the caller, whose size is checked here."""
        current = {
            "sla_policy": self.sla_policy,
            "event_catalog": self.event_catalog,
            "event_alias": self.event_alias,
        }
        current.update({name: _broadcast_if_small(df) for name, df in dims.items()})
        return ReferenceData(**current)


def _constant(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    values = ", ".join(repr(row) for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def _broadcast_if_small(dim: DataFrame) -> DataFrame:
    known = dim.limit(BROADCAST_DIM_ROWS + 1).count()
    return F.broadcast(dim) if known <= BROADCAST_DIM_ROWS else dim

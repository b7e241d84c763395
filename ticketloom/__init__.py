"""Process mining for incident event logs as PySpark DataFrame transformations."""

from ticketloom.plans.model import EventLogModel
from ticketloom.operators.scope import Scope
from ticketloom.reference import ReferenceData

__all__ = ["EventLogModel", "ReferenceData", "Scope"]

"""The content hash that identifies an event."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom.schema import TARGET_COLUMNS

# Formats and separator of the hashed text.
KEY_TIMESTAMP = "yyyy-MM-dd\'T\'HH:mm:ss.SSSSSS\'Z\'"
KEY_SEPARATOR = "|"


def _part(name: str) -> str:
    if name == "ts":
        text = f'date_format(ts, "{KEY_TIMESTAMP}")'
    elif name == "customer_satisfaction":
        text = "string(CAST(customer_satisfaction AS decimal(20,2)))"
    else:
        text = name
    return f"coalesce({text}, '')"


def event_key() -> Column:
    """Hash of the eleven columns as they are stored; text is stripped before, when it is loaded."""
    parts = ", ".join(_part(c) for c in TARGET_COLUMNS)
    return F.expr(f"md5(concat_ws('{KEY_SEPARATOR}', {parts}))")

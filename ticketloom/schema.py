"""Column names and Spark types of the event log."""

from pyspark.sql import types as T

# Target columns of the log, in the order that the event key hashes them.
TARGET_COLUMNS = [
    "case_id",
    "variant",
    "priority",
    "reporter",
    "ts",
    "event",
    "issue_type",
    "resolver",
    "report_channel",
    "short_description",
    "customer_satisfaction",
]

OPTIONAL_COLUMNS = ["resolver", "customer_satisfaction"]
REQUIRED_COLUMNS = [c for c in TARGET_COLUMNS if c not in OPTIONAL_COLUMNS]
TEXT_COLUMNS = [c for c in TARGET_COLUMNS if c not in ("ts", "customer_satisfaction")]

CSAT_TYPE = T.DecimalType(5, 2)


def _column_type(name: str) -> T.DataType:
    return {"ts": T.TimestampType(), "customer_satisfaction": CSAT_TYPE}.get(name, T.StringType())


LOG_SCHEMA = T.StructType([T.StructField(c, _column_type(c)) for c in TARGET_COLUMNS])
EVENT_SCHEMA = T.StructType([T.StructField("event_key", T.StringType()), *LOG_SCHEMA.fields])
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

SLA_COLUMNS = ["priority", "target_hours"]
CATALOG_COLUMNS = ["event_name", "description", "stakeholder_owner"]
ALIAS_COLUMNS = ["raw_event_name", "event_code"]

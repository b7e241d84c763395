"""The inputs of the registered queries, all derived by Spark from the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom import EventLogModel, Scope
from ticketloom.operators.scope import scope_cases
from ticketloom.plans.skew import IN_TASK_ROWS
from ticketloom.session import require_utc
from ticketloom.sources.event_store import keyed_events
from ticketloom.sources.order_log import order_event_log, order_lines, order_log_parts

SCOPE = Scope(
    dt.date(1996, 3, 1),
    dt.date(2000, 9, 30),
    priority=["High", "Medium", "Low"],
    variant=["Standard", "Rework", "Unspecified"],
    report_channel=["Portal", "Email", "Unspecified"],
)

WIDE_SCOPE = Scope(
    dt.date(1997, 1, 15),
    dt.date(2001, 6, 30),
    issue_type=["Access", "Email", "Network", "Unspecified"],
)

FIRST_LOAD_ENDS = "1998-07-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model(spark: SparkSession, sf_dir: str, in_task_rows: int = IN_TASK_ROWS) -> EventLogModel:
    require_utc(spark)
    lineitem, orders = (table(spark, sf_dir, t) for t in ("lineitem", "orders"))
    return EventLogModel(order_log_parts(lineitem, orders, in_task_rows))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven log columns, copies included."""
    require_utc(spark)
    return order_event_log(order_lines(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "orders"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_events(log(spark, sf_dir))


def scoped(m: EventLogModel, scope: Scope = SCOPE) -> DataFrame:
    return scope_cases(m.closed, scope)


# Header and log column of the export that `export_rows` makes.
EXPORT_HEADERS = {
    " Incident Number ": "case_id",
    "Process-Variant": "variant",
    "Severity": "priority",
    "Reported By": "reporter",
    "Timestamp": "ts",
    "Event Name": "event",
    "Category": "issue_type",
    "(Assigned To)": "resolver",
    "CHANNEL": "report_channel",
    "Summary": "short_description",
    "csat": "customer_satisfaction",
}

PLAIN_HEADERS = {
    "incident_number": "case_id",
    "process_variant": "variant",
    "severity": "priority",
    "reported_by": "reporter",
    "timestamp": "ts",
    "event_name": "event",
    "category": "issue_type",
    "assigned_to": "resolver",
    "channel": "report_channel",
    "summary": "short_description",
    "csat": "customer_satisfaction",
}


def _written_time(number: Column) -> Column:
    """The time of an event in one of several notations, chosen by the number of its order."""
    ts = F.col("ts")
    month_first = F.date_format(ts, "MM/dd/yyyy HH:mm")
    with_clock = F.date_format(ts, "dd.MM.yyyy hh:mm a")
    return (
        F.when(number % 11 == 10, "n/a")
        .when(number % 5 == 0, F.date_format(ts, "dd/MM/yyyy HH:mm"))
        .when(number % 5 == 1, F.date_format(ts, "d-M-yyyy H:mm:ss"))
        .when(number % 5 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(number % 5 == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .otherwise(F.when(F.dayofmonth(ts) > 12, month_first).otherwise(with_clock))
    )


# Notations of a time, in the order of the remainder that chooses one.
NOTATIONS = [
    "dd/MM/yy HH:mm",
    "d MMM yyyy HH:mm",
    "dd-MMM-yyyy",
    "MMMM d, yyyy hh:mm a",
    "dd/MM/yyyy HH:mm:ss'+0100'",
    "yyyy/MM/dd HH:mm",
    "yyyyMMdd",
    "yyyyMMdd'T'HHmmss'Z'",
    "EEE, d MMM yyyy HH:mm:ss ' -0330'",
    "yyyy-MMM-dd h:mm a",
    "d.M.yy H:mm' UTC'",
]


def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with each time written in a notation that the number of its order chooses."""
    number = F.substring("case_id", 4, 20).cast("bigint") % len(NOTATIONS)
    written = F.lit(None)
    for i, notation in reversed(list(enumerate(NOTATIONS))):
        written = F.when(number == i, F.date_format("ts", notation)).otherwise(written)
    return log(spark, sf_dir).withColumn("written", written)


def _written_score(number: Column) -> Column:
    score = F.col("customer_satisfaction").cast("int").cast("string")
    return F.when(
        score.isNotNull(),
        F.when(number % 4 == 0, F.concat(F.lit(" "), score))
        .when(number % 4 == 1, F.concat(score, F.lit(".50")))
        .when(number % 4 == 2, "good")
        .otherwise(F.concat(score, F.lit("e3"))),
    ).otherwise("")


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as an untidy export: odd headers, padded text, mixed notations, blank cells."""
    number = F.substring("case_id", 4, 20).cast("bigint")
    rows = log(spark, sf_dir).withColumn("number", number)

    def cell(name: str) -> Column:
        if name == "ts":
            return _written_time(F.col("number"))
        if name == "customer_satisfaction":
            return _written_score(F.col("number"))
        return F.concat(F.lit("\t "), F.coalesce(name, F.lit("")), F.lit(" \n"))

    return rows.select(*[cell(name).alias(header) for header, name in EXPORT_HEADERS.items()])


def plain_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a tidy export with ISO times, to be written as CSV."""
    written = {
        "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "customer_satisfaction": F.col("customer_satisfaction").cast("string"),
    }
    rows = log(spark, sf_dir)
    return rows.select(*[written.get(c, F.col(c)).alias(h) for h, c in PLAIN_HEADERS.items()])


def portable(df: DataFrame) -> DataFrame:
    """Plain types for comparison: 64-bit integers, doubles with six decimals, zone-free times."""

    def plain(field: T.StructField) -> str:
        name = f"`{field.name}`"
        sql = name
        if isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            sql = f"round(double({name}), 6)"
        elif isinstance(field.dataType, T.IntegerType):
            sql = f"bigint({name})"
        elif isinstance(field.dataType, T.TimestampType):
            sql = f"CAST({name} AS timestamp_ntz)"
        return f"{sql} AS {name}"

    return df.selectExpr(*[plain(f) for f in df.schema.fields])

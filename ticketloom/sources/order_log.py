"""An incident log derived from order lines: a line is an event, an order is a case."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ticketloom.plans.skew import IN_TASK_ROWS, LogParts, split_log
from ticketloom.schema import CSAT_TYPE, TARGET_COLUMNS
from ticketloom.session import broadcast_up_to, stored
from ticketloom.sources.event_store import keyed_events

# Raw labels by the position of a line and its part and supplier numbers.
MIDDLE_EVENTS = [
    "Ticket assigned to level 1 support",
    "WIP - level 1 support",
    "Level 1 escalates to level 2 support",
    "Ticket assigned to level 2 support",
    "WIP - level 2 support",
    "Level 2 escalates to level 3 support",
    "WIP - level 3 support",
    "Vendor callback",
]
SOLVING_EVENTS = [
    "Ticket solved by level 1 support",
    "Ticket solved by level 1 support",
    "Ticket solved by level 2 support",
    "Ticket solved by level 3 support",
    "Ticket rejected",
]
DESCRIPTIONS = [
    "Password reset #12",
    "VPN error 809!",
    "Laptop (2nd floor)",
    "12345",
    "Mailbox  FULL",
    "Printer-jam",
    "Account locked",
]
VARIANTS = ["Standard", "Escalated", "Rework"]
ISSUE_TYPES = ["Access", "Hardware", "Email", "Network", None]
CHANNELS = ["Portal", "Phone", "Email", ""]

MINUTES_PER_LINE = 240

LINE_COLUMNS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_returnflag",
]


def _pick(number: str, values: list[str | None]) -> str:
    """SQL that chooses among values by the remainder of a number."""
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"element_at(array({listed}), int(({number}) % {len(values)}) + 1)"


_MIX = "l_partkey * 7 + l_suppkey * 3"
_MINUTES = f"(l_linenumber - 1) * {MINUTES_PER_LINE} + 15 * (l_suppkey % 12)"

LOG_EXPRESSIONS = {
    "case_id": "case_id",
    "variant": f"""CASE WHEN l_discount >= 0.09D THEN '' WHEN l_tax >= 0.07D THEN 'Expedited'
        ELSE {_pick("l_orderkey", VARIANTS)} END""",
    "priority": """CASE WHEN l_linenumber = 5 THEN NULL
        WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High'
        WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium'
        WHEN o_orderpriority = '5-LOW' THEN 'Low'
        ELSE 'Unrated' END""",
    "reporter": "concat('U', o_custkey)",
    "ts": f"timestampadd(MINUTE, {_MINUTES}, timestamp(o_orderdate))",
    "event": f"""CASE WHEN l_linenumber = 1 THEN 'Ticket created'
        WHEN l_linenumber <= 3 THEN {_pick(_MIX, MIDDLE_EVENTS)}
        WHEN l_linenumber <= 5 THEN {_pick(_MIX, SOLVING_EVENTS)}
        WHEN l_linenumber = 6 THEN 'Ticket closed'
        WHEN l_returnflag = 'R' THEN 'Ticket reopened by customer'
        WHEN l_returnflag = 'A' THEN 'Customer feedback received'
        ELSE 'Ticket closed' END""",
    "issue_type": _pick("l_partkey", ISSUE_TYPES),
    "resolver": "CASE WHEN l_suppkey % 9 <> 0 THEN concat('R', l_suppkey % 9) END",
    "report_channel": _pick("l_orderkey", CHANNELS),
    "short_description": _pick("l_orderkey", DESCRIPTIONS),
    "customer_satisfaction": f"""CASE WHEN l_linenumber = 7 AND l_returnflag = 'A'
        THEN CAST(l_quantity % 5 + 1 AS {CSAT_TYPE.simpleString()}) END""",
}


def order_lines(lineitem: DataFrame) -> DataFrame:
    """The columns of the order lines that the log is made from, and the case of each line."""
    return lineitem.selectExpr("concat('INC', l_orderkey) AS case_id", *LINE_COLUMNS)


def order_event_log(lines: DataFrame, orders: DataFrame, large_ids: DataFrame | None = None) -> DataFrame:
    """The eleven log columns, before keys and de-duplication.

    Lines and orders meet on case_id, so lines that are partitioned by case stay where they are. With the
    ids of a few large cases only their headers are joined, and the lines of one case stay spread.
    """
    headers = orders.selectExpr(
        "concat('INC', o_orderkey) AS case_id", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    if large_ids is not None:
        headers = stored(headers.join(large_ids, "case_id", "left_semi"), "large-headers")
        headers = broadcast_up_to(headers, headers.count())
    return lines.join(headers, "case_id").selectExpr(
        *[f"{LOG_EXPRESSIONS[c]} AS {c}" for c in TARGET_COLUMNS]
    )


def order_log_parts(lineitem: DataFrame, orders: DataFrame, in_task_rows: int = IN_TASK_ROWS) -> LogParts:
    """The whole derived log, keyed and free of copies."""
    return split_log(
        order_lines(lineitem),
        lambda lines: keyed_events(order_event_log(lines, orders)),
        unique=False,
        in_task_rows=in_task_rows,
        large_to_events=lambda lines, ids: keyed_events(order_event_log(lines, orders, ids)),
    )

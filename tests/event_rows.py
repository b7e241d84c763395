"""Log rows for tests."""

from datetime import datetime, timezone
from decimal import Decimal

from ticketloom.schema import TARGET_COLUMNS


def row(case_id, ts, event, **values):
    """A log row; anything not given has a plain default."""
    base = {
        "case_id": case_id,
        "variant": "Standard",
        "priority": "High",
        "reporter": "Ava",
        "ts": datetime.fromisoformat(ts).replace(tzinfo=timezone.utc),
        "event": event,
        "issue_type": "Access",
        "resolver": "L1",
        "report_channel": "Portal",
        "short_description": "Password reset",
        "customer_satisfaction": None,
    }
    base.update(values)
    if base["customer_satisfaction"] is not None:
        base["customer_satisfaction"] = Decimal(str(base["customer_satisfaction"]))
    return tuple(base[c] for c in TARGET_COLUMNS)


def by_case(df):
    return {r["case_id"]: r for r in df.collect()}

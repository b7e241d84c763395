"""Page bundles against the rollups that they hold."""

import pytest

from event_rows import row
from ticketloom.workstreams import command, enablement, handoffs, intake, pages, quality


@pytest.fixture(scope="module")
def closed(model_of):
    rows = []
    for i in range(24):
        case, day = f"C{i:02}", f"2024-01-{i % 5 + 1:02}"
        facts = {
            "priority": ("High", "Low", None)[i % 3],
            "issue_type": ("Access", "", "Email", "Access")[i % 4],
            "report_channel": ("Portal", "Phone")[i % 2],
            "variant": ("Standard", "Rework", "")[i % 3],
        }
        rows.append(row(case, f"{day} 08:00", "Ticket created", **facts))
        rows.append(row(case, f"{day} 09:{i:02}", f"Ticket solved by level {i % 3 + 1} support", **facts))
        rows.append(row(case, f"{day} {10 + i % 9}:{i:02}", "Ticket closed", **facts))
        if i % 4 == 0:
            rows.append(row(case, f"{day} 23:00", "Ticket reopened by customer", **facts))
    return model_of(*rows).closed


def same(found, wanted):
    columns = [c for c in wanted.columns if c in found.columns]

    def rows(df):
        plain = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(columns).collect()]
        return sorted(plain, key=str)

    assert rows(found) == rows(wanted) and len(columns) > 1


ROLLUPS = [
    ("command", "variant", command.variant_rollup),
    ("command", "issue", lambda s: command.group_rollup(s, "issue_type")),
    ("command", "channel", lambda s: command.group_rollup(s, "report_channel")),
    ("command", "all", command.scope_kpis),
    ("handoffs", "issue", handoffs.handoff_rollup),
    ("quality", "issue", quality.quality_by_issue),
    ("quality", "priority", quality.quality_by_priority),
    ("quality", "all", quality.quality_kpis),
    ("intake", "channel", intake.intake_channels),
    ("intake", "channel_issue", intake.intake_channel_issue),
    ("enablement", "issue", enablement.enablement_by_issue),
    ("enablement", "all", enablement.enablement_kpis),
]


@pytest.fixture(scope="module")
def rolled_up(closed):
    return {name: pages.roll_up(closed, page) for name, page in pages.pages().items()}


@pytest.mark.parametrize("page, rollup, alone", ROLLUPS)
def test_a_page_holds_its_rollups(closed, rolled_up, page, rollup, alone):
    same(pages.part(rolled_up[page], pages.pages()[page], rollup), alone(closed))


def test_a_page_scans_each_table_once(spark):
    from catalog.queries import QUERIES

    for name in ("page_command", "page_intake"):
        query = QUERIES[name](spark, "/root/testdata/sf0.001")
        query.collect()
        plan = query._jdf.queryExecution().executedPlan().toString()
        final = plan[: plan.index("== Initial Plan ==")]
        assert final.count("Scan parquet") == 2

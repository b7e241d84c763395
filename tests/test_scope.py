"""Scoping and the scoped rollups on small hand-made logs."""

from datetime import date

import pytest

from event_rows import by_case, row
from ticketloom import Scope
from ticketloom.functions.text import UNSPECIFIED
from ticketloom.operators import outcomes, scope as scoping
from ticketloom.workstreams import command, enablement, flow, handoffs, intake, quality

CREATED, CLOSED = "Ticket created", "Ticket closed"
YEAR = Scope(date(2024, 1, 1), date(2024, 12, 31))


def case_rows(case_id, day="2024-01-10", hours=1, events=(), **values):
    steps = [CREATED, *events, CLOSED]
    stamps = [f"{day} 0{min(i, 7)}:00" for i in range(len(steps) - 1)] + [f"{day} {hours:02d}:30"]
    return [row(case_id, ts, e, **values) for ts, e in zip(stamps, steps)]


@pytest.fixture(scope="module")
def small(model_of):
    return model_of(
        *case_rows("A", hours=9, issue_type="Access"),
        *case_rows("B", hours=2, issue_type=None, report_channel=""),
        *case_rows("C", "2024-03-01", hours=4, variant=" ", priority="Low"),
        *case_rows("D", "2025-01-01", hours=1),
    )


def test_days_are_inclusive_and_no_selection_keeps_all(small):
    kept = by_case(scoping.scope_cases(small.closed, YEAR))
    assert set(kept) == {"A", "B", "C"}
    assert kept["B"].issue_type is None
    edge = Scope(date(2024, 1, 10), date(2024, 1, 10))
    assert set(by_case(scoping.scope_cases(small.closed, edge))) == {"A", "B"}


def test_missing_values_are_selectable_and_shown_when_selected(small):
    picked = Scope(YEAR.start, YEAR.end, issue_type=[UNSPECIFIED])
    kept = by_case(scoping.scope_cases(small.closed, picked))
    assert set(kept) == {"B"} and kept["B"].issue_type == UNSPECIFIED
    blank = Scope(YEAR.start, YEAR.end, variant=[UNSPECIFIED])
    assert set(by_case(scoping.scope_cases(small.closed, blank))) == {"C"}


def test_fill_keeps_other_values_untouched(spark):
    df = spark.createDataFrame([(" x ",), ("",), ("\t",), (None,)], "variant string")
    found = [r.variant for r in scoping.fill_dimensions(df, "variant").collect()]
    assert found == [" x ", UNSPECIFIED, UNSPECIFIED, UNSPECIFIED]


def test_filter_domain(small):
    dates = scoping.filter_dates(small.closed).first()
    assert (dates.min_date, dates.max_date) == (date(2024, 1, 10), date(2025, 1, 1))
    values = [(r.dimension, r.value) for r in scoping.filter_values(small.closed).collect()]
    assert ("issue_type", UNSPECIFIED) in values and ("variant", UNSPECIFIED) in values
    assert values == sorted(values) and len(values) == len(set(values))


def test_lists_are_cut_after_the_scope(model_of):
    """A case outside the scope takes no place of the list, whatever its length."""
    m = model_of(*case_rows("LONG", "2025-01-01", hours=20), *case_rows("SHORT", hours=2))
    assert [r.case_id for r in enablement.problem_worklist(m.closed, YEAR, rows=1).collect()] == ["SHORT"]
    assert [r.case_id for r in handoffs.worst_handoff_worklist(m.closed, YEAR, rows=1).collect()] == ["SHORT"]
    assert [r.cases for r in enablement.prevention_backlog(m.closed, YEAR).collect()] == [1]


def test_worst_cases_are_ranked_with_a_fixed_tiebreak(model_of):
    m = model_of(*case_rows("Z"), *case_rows("Y"), *case_rows("X", hours=5))
    assert [r.case_id for r in outcomes.worst_handoff_cases(m.closed).collect()] == ["X", "Y", "Z"]


def test_variant_rollup_ranks_by_score(small):
    first = command.variant_rollup(scoping.scope_cases(small.closed, YEAR)).first()
    assert (first.variant, first.cases) == ("Standard", 2)
    assert first.opportunity_score == pytest.approx(2 * (9.5 + 2.5) / 2)
    briefing = command.leader_briefing(scoping.scope_cases(small.closed, YEAR)).first()
    assert (briefing.cases, briefing.worst_variant, briefing.feedback_gap) == (3, "Standard", 1.0)
    assert briefing.worst_variant_hours == pytest.approx(6.0)


def test_kpis_of_an_empty_scope(small):
    none = scoping.scope_cases(small.closed, Scope(date(1990, 1, 1), date(1990, 1, 2)))
    assert command.scope_kpis(none).first().cases == 0
    assert command.leader_briefing(none).first().worst_variant is None
    assert handoffs.handoff_kpis(none).first().pingpong_rate is None


def test_two_definitions_of_a_high_handoff(model_of):
    from ticketloom.operators.summaries import handoff_summary

    start = row("C", "2024-01-10 08:00", CREATED, resolver="R1")
    m = model_of(start, row("C", "2024-01-10 08:10", "Ticket rejected", resolver="R2"),
                 row("C", "2024-01-10 08:20", CLOSED, resolver="R3"))
    assert handoff_summary(m.closed).first().high_handoff_rate == 0.0
    assert handoffs.handoff_rollup(m.closed).first().high_handoff_rate == 1.0


def test_flow_counts_last_events_but_not_their_wait(model_of):
    m = model_of(*case_rows("C", hours=2), *case_rows("D", "2024-01-11", hours=2))
    steps = flow.scoped_steps(m, YEAR)
    dwell = {r.event: (r.occurrences, r.avg_dwell_hours) for r in flow.flow_dwell(steps).collect()}
    assert dwell == {"ticket_created": (2, 2.5), "ticket_closed": (2, None)}
    kpis = flow.flow_kpis(m.closed, steps).first()
    assert (kpis.variants, kpis.avg_steps, kpis.transitions, kpis.slowest_dwell_hours) == (1, 2.0, 1, 2.5)


def test_flow_filters_events_by_their_own_values_and_day(model_of):
    m = model_of(
        row("C", "2024-01-10 23:00", CREATED),
        row("C", "2024-01-11 01:00", "Ticket assigned to level 1 support", variant="Other"),
        row("C", "2024-01-11 02:00", CLOSED),
    )
    one_day = Scope(date(2024, 1, 10), date(2024, 1, 10))
    (only,) = flow.scoped_steps(m, one_day).collect()
    assert (only.event, only.next_event) == ("ticket_created", "assigned_to_l1")
    standard = Scope(YEAR.start, YEAR.end, variant=["Standard"])
    assert flow.scoped_steps(m, standard).count() == 2


def test_worklist_keeps_cases_without_scoped_events(model_of):
    late = row("E", "2024-01-12 08:00", "Customer feedback received", variant="Other")
    m = model_of(*case_rows("C", hours=2), *case_rows("D", hours=3), late)
    listed = flow.flow_worklist(m, YEAR).collect()
    assert [(r.case_id, r.event_steps) for r in listed] == [("D", 2), ("C", 2)]
    # the case mode is Standard, but half of its events are not
    mixed = model_of(
        row("M", "2024-01-10 08:00", CREATED),
        row("M", "2024-01-10 09:00", "Ticket rejected", variant="Other"),
        row("M", "2024-01-10 10:00", CLOSED),
        row("N", "2024-01-31 23:00", CREATED, variant="Other"),
        row("N", "2024-02-01 01:00", CLOSED),
        row("N", "2024-02-01 02:00", CLOSED),
    )
    january = Scope(date(2024, 1, 1), date(2024, 1, 31), variant=["Standard"])
    listed = flow.flow_worklist(mixed, january).collect()
    assert [(r.case_id, r.event_steps) for r in listed] == [("M", 2), ("N", None)]


def test_top_paths_number_sources_before_targets(model_of):
    m = model_of(*case_rows("C", hours=8, events=["Ticket rejected", "WIP - level 1 support"]))
    paths = {(r.from_event, r.to_event): (r.source_id, r.target_id)
             for r in flow.flow_top_paths(flow.scoped_steps(m, YEAR)).collect()}
    assert paths == {
        ("ticket_created", "ticket_rejected"): (0, 1),
        ("ticket_rejected", "work_in_progress_l1"): (1, 2),
        ("work_in_progress_l1", "ticket_closed"): (2, 3),
    }


def test_slowest_channel_is_the_slowest_not_the_largest(model_of):
    m = model_of(*case_rows("A", hours=2), *case_rows("B", hours=2),
                 *case_rows("C", hours=8, report_channel="Phone"))
    assert intake.intake_slowest_channel(m.closed).first().report_channel == "Phone"


def test_quality_worklist_order(model_of):
    m = model_of(*case_rows("A", hours=2), *case_rows("B", hours=4),
                 *case_rows("C", hours=1), row("C", "2024-01-10 05:00", "Ticket reopened"))
    assert [r.case_id for r in quality.quality_worklist(m.closed).collect()] == ["C", "B", "A"]


def test_enablement_score(model_of):
    solved = ["Ticket solved by level 1 support"]
    m = model_of(*case_rows("A", hours=2, events=solved), *case_rows("B", hours=4))
    found = enablement.enablement_by_issue(m.closed).first()
    assert (found.fcr_rate, found.l1_rate) == (0.5, 0.5)
    assert found.enablement_score == pytest.approx(2 * 3.5 * 0.5)


def test_labels(spark):
    df = spark.createDataFrame(
        [(True, True, True, True, True, 1), (False, False, None, False, False, 2)],
        "has_reopen boolean, closed_without_feedback boolean, met_sla boolean, has_feedback boolean, fcr boolean, n int",
    )
    first, second = scoping.status_labels(df).collect()
    assert tuple(first) == ("Reopened", "Feedback Missing", "Met", "Feedback", "Yes", 1)
    assert tuple(second) == ("Stable", "Feedback", None, "Feedback Missing", "No", 2)


def test_stored_model_answers_the_same(model_of, tmp_path):
    m = model_of(*case_rows("A", hours=9), *case_rows("B", "2024-02-01", hours=3, events=["Ticket rejected"]))
    stored = m.materialize(str(tmp_path))
    for build in (lambda x: x.sequence, lambda x: x.closed, lambda x: flow.scoped_steps(x, YEAR)):
        columns = sorted(build(m).columns)
        a, b = (sorted(map(str, build(x).select(*columns).collect())) for x in (m, stored))
        assert a == b


def _leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_flow_kpis_evaluate_the_model_once(model_of):
    """Cases without scoped events count for the variants alone; events and cases are derived once each."""
    m = model_of(
        *case_rows("C", hours=2, events=["Ticket rejected"]),
        row("M", "2024-01-10 08:00", CREATED),
        row("M", "2024-01-10 09:00", "Ticket rejected", variant="Other"),
        row("M", "2024-01-10 10:00", CLOSED),
        row("N", "2024-01-31 23:00", CREATED, variant="Other"),
        row("N", "2024-02-01 01:00", CLOSED),
        row("N", "2024-02-01 02:00", CLOSED),
    )
    for scope in (YEAR, Scope(date(2024, 1, 1), date(2024, 1, 31), variant=["Standard"]), Scope(date(1990, 1, 1), date(1990, 1, 2))):
        steps = flow.scoped_steps(m, scope)
        once = flow.scoped_flow_kpis(m, scope)
        assert once.collect() == flow.flow_kpis(scoping.scope_cases(m.closed, scope), steps).collect()
        assert _leaves(once) <= _leaves(flow.flow_transitions(steps))
    january = Scope(date(2024, 1, 1), date(2024, 1, 31), variant=["Standard"])
    found = flow.scoped_flow_kpis(m, january).first()
    assert (found.variants, found.avg_steps, found.transitions) == (1, 2.5, 2)


def test_top_paths_evaluate_the_steps_once(model_of):
    paths = flow.flow_top_paths(flow.scoped_steps(model_of(*case_rows("C", hours=8)), YEAR))
    assert "avg(" not in paths._jdf.queryExecution().optimizedPlan().toString()

"""Rules of the case and outcome relations on small hand-made logs."""

import pytest
from pyspark.sql import functions as F

from event_rows import by_case, row
from ticketloom.operators import cases, checks, events, outcomes, summaries

CREATED, CLOSED = "Ticket created", "Ticket closed"
SOLVED_L1 = "Ticket solved by level 1 support"
SOLVED_L2 = "Ticket solved by level 2 support"
TO_L2 = "Ticket assigned to level 2 support"
TO_L3 = "Ticket assigned to level 3 support"
REOPENED = "Ticket reopened"


def only(df):
    (found,) = df.collect()
    return found


def test_case_attributes_come_from_the_whole_case(model_of):
    desk = dict(variant="Legacy", priority="Medium", resolver="Desk", report_channel="Email")
    late = dict(variant="Modern", resolver="L2")
    m = model_of(
        row("C", "2024-01-01 08:00", CREATED, **desk),
        row("C", "2024-01-01 08:05", TO_L2, **late),
        row("C", "2024-01-01 08:10", SOLVED_L2, **late, issue_type="Hardware"),
        row("C", "2024-01-01 08:15", CLOSED, **late, issue_type="Hardware", customer_satisfaction=4.5),
    )
    c = only(m.closed)
    assert (c.variant, c.priority, c.issue_type, c.report_channel) == ("Modern", "Medium", "Access", "Email")
    assert (c.escalation_count, c.event_count, c.distinct_resolvers, c.resolver_changes) == (1, 4, 2, 1)
    assert (float(c.customer_satisfaction), c.cycle_hours, c.target_hours, c.met_sla) == (4.5, 0.25, 16, True)
    assert (c.resolution_level, c.fcr, c.closed_without_feedback) == ("L2", False, True)
    assert outcomes.pingpong_cases(m.closed).count() == 0


def test_first_contact_resolution(model_of):
    m = model_of(
        row("YES", "2024-01-02 09:00", CREATED),
        row("YES", "2024-01-02 09:10", SOLVED_L1),
        row("YES", "2024-01-02 09:15", CLOSED, customer_satisfaction=4),
        row("AGAIN", "2024-01-02 10:00", CREATED),
        row("AGAIN", "2024-01-02 10:05", SOLVED_L1),
        row("AGAIN", "2024-01-02 10:10", CLOSED),
        row("AGAIN", "2024-01-02 10:20", REOPENED),
        row("AGAIN", "2024-01-02 10:25", SOLVED_L1),
        row("AGAIN", "2024-01-02 10:30", CLOSED, customer_satisfaction=3.5),
        row("UP", "2024-01-02 11:00", CREATED),
        row("UP", "2024-01-02 11:03", "Level 1 escalates to level 2 support"),
        row("UP", "2024-01-02 11:10", SOLVED_L2),
        row("UP", "2024-01-02 11:15", CLOSED, customer_satisfaction=2.5),
    )
    found = by_case(m.closed)
    levels = {c: (r.resolution_level, r.fcr) for c, r in found.items()}
    assert levels == {"YES": ("L1", True), "AGAIN": ("L1", False), "UP": ("L2", False)}
    again = found["AGAIN"]
    assert again.has_reopen and again.reopen_after_close_hours is None
    assert again.reopened_within_3h is False and again.reopened_within_24h is False


def test_reopen_counts_after_the_last_close_only(model_of):
    m = model_of(
        row("C", "2024-01-01 08:00", CREATED),
        row("C", "2024-01-01 09:00", CLOSED),
        row("C", "2024-01-01 13:00", REOPENED),
        row("C", "2024-01-01 20:00", REOPENED),
    )
    c = only(outcomes.closure_compliance(m.closed))
    assert (c.reopen_after_close_hours, c.reopened_within_3h, c.reopened_within_24h) == (4.0, False, True)


def test_open_and_reversed_cases_are_not_cases(model_of):
    m = model_of(
        row("OPEN", "2024-01-01 08:00", CREATED),
        row("BACK", "2024-01-01 08:00", CLOSED),
        row("BACK", "2024-01-01 09:00", CREATED),
        row("NOW", "2024-01-01 08:00", CREATED),
        row("NOW", "2024-01-01 08:00", CLOSED),
    )
    assert set(by_case(m.closed)) == {"NOW"}
    assert set(by_case(m.facts)) == {"OPEN", "BACK", "NOW"}


def test_unknown_labels_stay_and_are_reported(model_of):
    m = model_of(
        row("C", "2024-01-03 09:00", "Completely new raw event", priority="Low"),
        row("C", "2024-01-03 09:05", CLOSED, priority="Low"),
        row("D", "2024-01-03 09:00", "Another"),
    )
    c = only(m.closed)
    assert (c.created_at.hour, c.created_at.minute, c.resolution_level) == (9, 0, "Unknown")
    unknown = {r.raw_event_name: r.events for r in checks.unmapped_events(m.normalized).collect()}
    assert unknown == {"Completely new raw event": 1, "Another": 1}
    first = m.sequence.filter("case_id = 'C' AND seq = 1").first()
    assert (first.event, first.event_code, first.next_event) == (
        "Completely new raw event", None, "ticket_closed",
    )
    # no code at all: the flags of an open case are unknown, not false
    assert by_case(m.facts)["D"].has_feedback is None


def test_ties_in_time_follow_the_event_key(model_of):
    same = [row("C", "2024-01-01 08:00", e) for e in (CREATED, SOLVED_L1, TO_L2, CLOSED)]
    m = model_of(*same)
    keys = [r.event_key for r in m.log.orderBy("event_key").collect()]
    codes = {r.event_key: r.event for r in m.normalized.collect()}
    assert [r.event for r in m.sequence.orderBy("seq").collect()] == [codes[k] for k in keys]


@pytest.mark.parametrize(
    "variants, expected",
    [
        (["A", "B", "B"], "B"),
        (["A", "B"], "B"),
        (["", None, "Z"], "Z"),
        (["", None], None),
    ],
)
def test_variant_is_the_most_frequent_then_the_latest(model_of, variants, expected):
    rows = [row("C", f"2024-01-01 08:0{i}", CREATED, variant=v) for i, v in enumerate(variants)]
    assert only(model_of(*rows).facts).variant == expected


def test_variant_ties_in_count_and_time_go_by_name(model_of):
    rows = [row("C", "2024-01-01 08:00", CREATED, variant=v) for v in ("Beta", "Alpha")]
    assert only(model_of(*rows).facts).variant == "Alpha"


def test_sla_is_unknown_without_a_policy_and_skipped_in_rates(model_of):
    m = model_of(
        row("A", "2024-01-01 08:00", CREATED, priority="Unrated"),
        row("A", "2024-01-01 09:00", CLOSED, priority="Unrated"),
        row("B", "2024-01-01 08:00", CREATED),
        row("B", "2024-01-01 16:00", CLOSED),
        row("C", "2024-01-01 08:00", CREATED),
        row("C", "2024-01-01 16:01", CLOSED),
    )
    assert {c: r.met_sla for c, r in by_case(m.closed).items()} == {"A": None, "B": True, "C": False}
    assert only(summaries.variant_summary(m.closed)).met_sla_rate == 0.5
    assert only(summaries.problem_candidates(m.closed.filter("priority = 'Unrated'"))).impact_score == (
        pytest.approx(0.1)
    )


def test_moves_between_upper_levels_are_counted_when_adjacent(model_of):
    steps = [CREATED, TO_L2, TO_L3, TO_L2, SOLVED_L1, TO_L3, CLOSED]
    m = model_of(*[row("C", f"2024-01-01 08:0{i}", e) for i, e in enumerate(steps)])
    assert only(outcomes.pingpong_cases(m.closed)).pingpong_transitions == 2


def test_solves_after_the_close_set_flags_but_not_the_level(model_of):
    m = model_of(
        row("C", "2024-01-01 08:00", CREATED),
        row("C", "2024-01-01 08:05", SOLVED_L1),
        row("C", "2024-01-01 08:10", CLOSED),
        row("C", "2024-01-01 08:20", SOLVED_L2),
    )
    c = only(m.closed)
    assert (c.resolution_level, c.solved_l2) == ("L1", True)


@pytest.mark.parametrize(
    "text, words",
    [
        ("Password reset #12", "password reset"),
        ("12345", None),
        ("  Mailbox\t FULL!! ", "mailbox full"),
        ("", None),
    ],
)
def test_descriptions_are_reduced_to_words(model_of, text, words):
    m = model_of(
        row("C", "2024-01-01 08:00", CREATED, short_description=text),
        row("C", "2024-01-01 08:05", CLOSED, short_description=text),
    )
    assert only(m.closed).short_description_norm == words


def test_summary_of_no_cases_has_one_row(model_of):
    m = model_of(row("C", "2024-01-01 08:00", CREATED))
    for in_task in (True, False):
        summary = only(summaries.cx_summary(m.closed, in_task))
        assert (summary.cases, summary.avg_cycle_hours, summary.p90_cycle_hours) == (0, None, None)


def test_dwell_leaves_out_the_last_event(model_of):
    m = model_of(row("C", "2024-01-01 08:00", CREATED), row("C", "2024-01-01 10:00", CLOSED))
    dwell = only(events.dwell_by_event(m.sequence))
    assert (dwell.event, dwell.occurrences, dwell.avg_dwell_hours) == ("ticket_created", 1, 2.0)


def test_column_lists(model_of):
    m = model_of(row("C", "2024-01-01 08:00", CREATED), row("C", "2024-01-01 10:00", CLOSED))
    assert len(cases.case_sla(m.closed).columns) == 18
    assert len(m.sequence.columns) == 21
    assert len(m.normalized.columns) == 15
    assert m.closed.filter(F.col("case_id").isNull()).count() == 0

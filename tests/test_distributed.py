"""Plans for logs of any size give the same rows as the plans for small ones."""

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from event_rows import row
from ticketloom import EventLogModel
from ticketloom.operators import events, summaries
from ticketloom.functions import measures as m
from ticketloom.operators.percentiles import CELL_UNIT, CELLS_PER_OCTAVE, distributed_percentiles, summarize
from ticketloom.plans.skew import split_log
from ticketloom.reference import EVENT_ALIASES
from ticketloom.schema import LOG_SCHEMA
from ticketloom.session import scratch_dir
from ticketloom.sources.event_store import keyed_events
from ticketloom.sources.order_log import order_log_parts

LABELS = [label for label, _ in EVENT_ALIASES] + ["Vendor callback"]


def skewed_rows(total=900, seed=7):
    """A third of all rows in one case, a third of those at one instant, and copies of one event."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(total):
        case = "HOT" if i % 3 == 0 else f"C{rng.randrange(120)}"
        minutes = 500 if i % 9 == 0 else rng.randrange(3000)
        ts = (start + timedelta(minutes=minutes, microseconds=rng.randrange(10**6) * (i % 9 > 0))).isoformat()
        rows.append(
            row(
                case, ts[:-6], rng.choice(LABELS),
                variant=rng.choice(["A", "B", "", None]),
                priority=rng.choice(["High", "Low", "", None]),
                resolver=rng.choice(["R1", "R2", "R3", "", None]),
                issue_type=rng.choice(["X", "Y", None]),
                reporter=f"U{i}",
            )
        )
    return rows + [rows[0]] * (total // 3)


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(skewed_rows(), LOG_SCHEMA)


def model(raw, in_task_rows):
    return EventLogModel(split_log(raw, keyed_events, unique=False, in_task_rows=in_task_rows))


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("in_task_rows", [7, 60])
def test_large_cases_give_the_same_sequence_and_facts(raw, in_task_rows):
    plain, large = model(raw, 10**6), model(raw, in_task_rows)
    assert plain.parts.large is None and large.parts.large is not None
    assert rows_of(plain.sequence) == rows_of(large.sequence)
    columns = sorted(plain.closed.columns)
    assert rows_of(plain.facts) == rows_of(large.facts)
    assert rows_of(plain.closed.select(*columns)) == rows_of(large.closed.select(*columns))
    assert plain.log.count() == 900


@pytest.mark.parametrize(
    "rows, per_slice, tasks, slices",
    [(4_700_000, 9, 200, 200), (900, 60, 200, 15), (10, 9, 200, 2), (900_000_000, 2_000_000, 200, 450)],
)
def test_slices_are_no_more_than_tasks_can_use(rows, per_slice, tasks, slices):
    assert events.slices_for(rows, per_slice, tasks) == slices


def test_small_slices_do_not_multiply_with_the_log(raw):
    """A low limit marks many cases; their slices are as many as the session has tasks for."""
    large = model(raw, 1)
    assert large.parts.large_cases > 100
    sequence = large._sequences[1]
    found = [n for f in sequence.inputFiles() if (n := f.rpartition("/")[2]).startswith("part-")]
    assert len(found) <= 8 and rows_of(sequence) == rows_of(model(raw, 10**6).sequence.join(
        large.parts.large.select("case_id").distinct(), "case_id").select(*sequence.columns))


def test_a_log_without_large_cases_needs_no_second_path(raw):
    m = model(raw, 700)
    assert m.parts.large is None and m.parts.large_cases == 0


def test_events_of_large_cases_are_never_shuffled_by_case_alone(spark):
    """Headers, slices and facts of large cases: no exchange gathers a case, with broadcasts by size switched off."""
    folder = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("lineitem", "orders")]
        parts = order_log_parts(*tables, in_task_rows=5)
        assert parts.large_cases > 0
        plan = parts.large._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(case_id" not in plan and "hashpartitioning(event_key" in plan


@pytest.mark.parametrize("hours, micros", [(24, 58_000), (8766, 21_000_000)])
def test_a_cell_holds_a_bounded_number_of_microseconds(hours, micros):
    """The width of a cell around a day and a year, as the grid defines it."""
    assert hours * CELL_UNIT * math.log(2) / CELLS_PER_OCTAVE <= micros


@pytest.mark.parametrize("hours", [24, 8766])
def test_values_close_together_are_ranked_inside_a_cell(spark, hours):
    """All waits within a second of one day, or of one year: few cells of the grid."""
    rng = random.Random(3)
    values = [hours + rng.randrange(-500_000, 500_000) / 3.6e9 for _ in range(3_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = distributed_percentiles(df, [], "v", {"p50": 0.5, "p90": 0.9}).first()
    wanted = df.agg(F.percentile("v", 0.5), F.percentile("v", 0.9)).first()
    assert tuple(found) == tuple(wanted)


def test_percentiles_evaluate_their_input_once(spark):
    """One shuffle of counted values feeds all steps, and no row is shuffled again after it."""
    df = spark.range(1000).selectExpr("id % 7 AS k", "double(id % 90) AS v").repartition(4)
    plan = distributed_percentiles(df, ["k"], "v", {"p": 0.5})
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert final.count("RoundRobinPartitioning") <= 1


def test_sequence_numbers_run_without_gaps(raw):
    per_case = model(raw, 20).sequence.groupBy("case_id").agg(
        F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("seq").alias("n"),
        F.count_distinct("seq").alias("distinct"), F.count("next_ts").alias("followed"),
    )
    for r in per_case.collect():
        assert (r.low, r.high, r.distinct, r.followed) == (1, r.n, r.n, r.n - 1)


def test_transitions_add_up_to_events_minus_cases(raw):
    m = model(raw, 10**6)
    total = events.transition_summary(m.sequence).agg(F.sum("transition_count")).first()[0]
    assert total == m.log.count() - m.facts.count()


def test_results_do_not_depend_on_the_number_of_partitions(spark, raw):
    found = []
    for partitions in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        m = model(raw, 10**6)
        rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c)
                   for c, t in summaries.variant_summary(m.closed).dtypes]
        found.append(rows_of(summaries.variant_summary(m.closed).select(*rounded)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1]


NUMBERS = {
    "one": [3.5],
    "two": [1.0, 2.0],
    "same": [7.25] * 400,
    "many": [random.Random(1).expovariate(0.01) for _ in range(500)],
    "mixed": [0.0, -1.5, 2.5, -300.0, 1e6, 1e-7, 0.0],
    None: [4.0, 8.0, 15.0, 16.0, 23.0, 42.0],
}


@pytest.mark.parametrize("keys", [["k"], []])
def test_percentiles_agree_with_numpy(spark, keys):
    rows = [(k, v) for k, values in NUMBERS.items() for v in values] + [("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    wanted = {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    found = distributed_percentiles(df, keys, "v", wanted).collect()
    groups = NUMBERS if keys else {"all": [v for _, v in rows if v is not None]}
    assert len(found) == len(groups)
    for r in found:
        values = groups[r["k"] if keys else "all"]
        for name, p in wanted.items():
            assert r[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_summaries_agree_in_task_and_distributed(spark):
    rows = [(k, v) for k, values in NUMBERS.items() for v in values] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    measures = [m.cases("n"), m.mean("v", "mean"), m.least("v", "low"), m.greatest("v", "high")]
    a, b = (
        {r["k"]: r for r in summarize(df, ["k"], measures, "v", {"p": 0.9}, t).collect()}
        for t in (True, False)
    )
    for k, r in a.items():
        assert [r[c] for c in ("n", "low", "high", "p")] == [b[k][c] for c in ("n", "low", "high", "p")]
        assert r["mean"] == b[k]["mean"] or r["mean"] == pytest.approx(b[k]["mean"], rel=1e-12)
    assert a.keys() == b.keys()


def test_a_stored_model_opens_without_the_raw_log(spark, raw):
    path = scratch_dir(spark, "derived")
    m = model(raw, 20)
    m.materialize(path)
    opened = EventLogModel.open(spark.newSession(), path)
    assert rows_of(opened.sequence) == rows_of(m.sequence)
    assert rows_of(opened.closed.select(*m.closed.columns)) == rows_of(m.closed)
    # Without the mean, whose last bits depend on the order of the sum.
    found, wanted = (events.transition_summary(x.sequence).drop("avg_delta_hours") for x in (opened, m))
    assert rows_of(found) == rows_of(wanted)
    with pytest.raises(ValueError):
        opened.log

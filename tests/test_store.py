"""Loads as transactions, stored keys that stay where they are, reports of streams, life of scratch folders."""

import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from event_rows import row
from ticketloom.schema import EVENT_COLUMNS, LOG_SCHEMA
from ticketloom.session import scratch_dir, scratch_scope, stored
from ticketloom.sources import event_store
from ticketloom.sources.event_store import EventStore, keyed_events
from ticketloom.sources.version_log import SharedFiles, Version, VersionLog, VersionTaken
from ticketloom.streaming.incremental import ingest_new_files, stream_report

TIMES = [f"2024-{m:02}-{d:02} 08:00" for m in (1, 2, 3) for d in range(1, 11)]


@pytest.fixture
def store(spark):
    return EventStore(spark, scratch_dir(spark, "store"), buckets=4)


@pytest.fixture(scope="module")
def batch_of(spark):
    def make(*times, case="C"):
        return keyed_events(spark.createDataFrame([row(case, t, "Ticket created") for t in times], LOG_SCHEMA))

    return make


def times_of(df):
    return sorted(r.ts for r in df.select("ts").collect())


def failing(batch):
    """The batch, whose last partition fails when it is written, after the others were."""
    bomb = F.when(F.col("ts") > "2024-03-09", F.raise_error(F.lit("lost"))).otherwise(F.col("reporter"))
    return batch.withColumn("reporter", bomb.cast("string"))


@pytest.mark.parametrize("load", [EventStore.append_new, EventStore.replace])
def test_a_load_that_fails_midway_leaves_the_store_as_it_was(store, batch_of, load):
    store.append_new(batch_of(*TIMES[:5]))
    with pytest.raises(Exception, match="lost"):
        load(store, failing(batch_of(*TIMES)))
    assert store.version() == 1 and len(times_of(store.read())) == 5
    folders = SharedFiles(store.spark).names(store.data)
    assert len([n for n in folders if n.startswith("load=")]) == 1
    assert load(store, batch_of(*TIMES)) in (25, 30)
    assert len(times_of(store.read())) == 30


def test_a_reader_holds_on_to_its_version(store, batch_of):
    store.append_new(batch_of(*TIMES[:5]))
    before = store.read()
    store.replace(batch_of(*TIMES[20:]))
    assert len(times_of(before)) == 5 == len(times_of(store.read(1)))
    assert times_of(store.read()) == [datetime.fromisoformat(t) for t in TIMES[20:]]
    assert store.replace(batch_of()) == 0 and store.read().columns == EVENT_COLUMNS
    assert store.read().count() == 0


def interleaved(monkeypatch, store, other):
    """Runs `other` once, between the write of a load and its publication."""
    publish, ran = VersionLog.publish, []

    def late(self, version):
        if not ran:
            ran.append(True)
            other()
        publish(self, version)

    monkeypatch.setattr(VersionLog, "publish", late)


def test_two_appends_at_once_insert_each_event_once(store, batch_of, monkeypatch):
    rival = EventStore(store.spark, store.path)
    counts = []
    interleaved(monkeypatch, store, lambda: counts.append(rival.append_new(batch_of(*TIMES[:20]))))
    counts.append(store.append_new(batch_of(*TIMES[10:])))
    assert counts == [20, 10] and store.version() == 2
    assert times_of(store.read()) == [datetime.fromisoformat(t) for t in TIMES]


def test_a_replacement_at_once_with_an_append_comes_after_it(store, batch_of, monkeypatch):
    rival = EventStore(store.spark, store.path)
    store.append_new(batch_of(*TIMES[:3]))
    interleaved(monkeypatch, store, lambda: rival.append_new(batch_of(*TIMES[:20])))
    assert store.replace(batch_of(*TIMES[25:])) == 5
    assert len(times_of(store.read())) == 5 and store.version() == 3


def test_a_version_is_published_once(store):
    store.log.publish(Version(1, 4))
    with pytest.raises(VersionTaken):
        store.log.publish(Version(1, 8))
    assert store.log.latest() == Version(1, 4)


def test_compaction_and_vacuum(store, batch_of, monkeypatch):
    for at in (0, 10, 20):
        store.append_new(batch_of(*TIMES[at : at + 10]))
    rival = EventStore(store.spark, store.path)
    interleaved(monkeypatch, store, lambda: rival.append_new(batch_of("2024-05-01 08:00")))
    assert store.compact() == 30
    assert len(store.log.latest().loads) == 2 and len(times_of(store.read())) == 31
    assert store.vacuum(hours=24) == []
    assert len(store.vacuum(hours=-1)) == 3
    assert store.log.numbers() == [store.version()] and len(times_of(store.read())) == 31
    assert store.append_new(batch_of(*TIMES, "2024-05-01 08:00", "2024-06-01 08:00")) == 1


def test_stored_keys_are_not_shuffled(spark, store, batch_of):
    """Between the scan of the store and the join there is no exchange, and only touched months are listed."""
    store.append_new(batch_of(*TIMES))
    store.append_new(batch_of(*TIMES, case="D"))
    base = store.log.latest()
    batch = store._months(base).where("event_month >= DATE '2024-02-01'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with store._bucketed(base) as table:
            unseen = store._unseen(table, base, batch, ["2024-02-01", "2024-03-01"])
            plan = unseen._jdf.queryExecution().executedPlan().toString()
            assert unseen.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored_side = plan[plan.index("SortMergeJoin") :].split("+- Exchange hashpartitioning(event_key")
    scan = next(line for line in plan.splitlines() if f"spark_catalog.default.{table}" in line)
    indent = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    above = []
    for line in reversed(lines[: lines.index(scan)]):
        if indent(line) < (indent(above[-1]) if above else indent(scan)):
            above.append(line)
    between = "\n".join(above[: next(i for i, x in enumerate(above) if "SortMergeJoin" in x)])
    assert "Exchange" not in between and len(stored_side) == 2
    assert "Bucketed: true" in scan


def test_a_repeated_load_shuffles_keys_alone(store, batch_of, monkeypatch):
    """Whole rows are dealt only of months that hold unseen events."""
    store.append_new(batch_of(*TIMES))
    dealt, unseen = [], EventStore._unseen

    def watched(self, table, version, batch, months, tasks=None):
        dealt.append((sorted(batch.columns), months))
        return unseen(self, table, version, batch, months, tasks)

    monkeypatch.setattr(EventStore, "_unseen", watched)
    assert store.append_new(batch_of(*TIMES)) == 0
    assert [columns for columns, _ in dealt] == [["event_key", "event_month"]]
    assert store.append_new(batch_of(*TIMES, "2024-02-28 08:00", "2024-07-01 08:00")) == 2
    assert [months for columns, months in dealt if "case_id" in columns] == [["2024-02-01"]]
    assert len(times_of(store.read())) == 32


def test_buckets_fit_the_first_load(spark, batch_of, monkeypatch):
    """And a replacement's; a load with more rows than its buckets' tasks take is dealt over several tasks a bucket."""
    monkeypatch.setattr(event_store, "BUCKET_ROWS", 3)
    monkeypatch.setattr(event_store, "TASK_ROWS", 2)
    store = EventStore(spark, scratch_dir(spark, "store"), buckets=2)
    store.append_new(batch_of(*TIMES[:10]))
    assert store.log.latest().buckets == 4
    assert store.append_new(batch_of(*TIMES, *TIMES)) == 20 and store.log.latest().buckets == 4
    assert store.append_new(batch_of(*TIMES)) == 0
    assert store.compact() == 30 and store.append_new(batch_of(*TIMES)) == 0
    store.replace(batch_of(*TIMES[:20]))
    assert store.log.latest().buckets == 7 and store.append_new(batch_of(*TIMES)) == 10
    assert len(times_of(store.read())) == 30


def test_compaction_does_not_shuffle_and_keeps_events_without_a_time(spark, store, batch_of):
    timeless = batch_of(TIMES[0], case="N").withColumns({"ts": F.lit(None).cast("timestamp"), "event_key": F.lit("none")})
    store.append_new(batch_of(*TIMES[:10]).unionByName(timeless))
    store.append_new(batch_of(*TIMES))
    base = store.log.latest()
    with store._bucketed(base) as table:
        plan = event_store.dedupe_events(store._stored(table, base))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert store.compact() == 31 and store.read().where("ts IS NULL").count() == 1


@pytest.mark.parametrize("load", [EventStore.append_new, EventStore.replace])
def test_copies_of_one_event_are_dropped_before_they_are_dealt(store, batch_of, monkeypatch, load):
    monkeypatch.setattr(event_store, "MANY_COPIES", 20)
    monkeypatch.setattr(event_store, "SAMPLED_COPIES", 20)
    assert load(store, batch_of(*TIMES[:3], *([TIMES[4]] * 40))) == 4
    plan = event_store._few_copies(batch_of(*([TIMES[4]] * 40)))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan


HEADER = (
    "incident_number;process_variant;severity;reported_by;timestamp;event_name;category;assigned_to;"
    "channel;summary;csat"
)


def lines_of(*times, score=""):
    return [f"INC1;Standard;High;Ava;{t};Ticket created;Access;L1;Portal;Reset;{score}" for t in times]


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n")


FIRST = [*lines_of("2024-01-01 08:00:00", "2024-01-01 08:00:00", "2024-01-02 08:00:00"),
         *lines_of("2024-01-03 08:00:00", "2024-02-01 08:00:00", score="good"), *lines_of("n/a")]


def told(report):
    one = report.stats().first()
    return (one.rows_input, one.rows_valid, one.rows_dropped, one.nulled_scores, one.rows_inserted, one.rows_duplicate)


def test_the_stream_reports_what_it_loaded(spark, store, tmp_path):
    state = scratch_dir(spark, "stream")
    folder = tmp_path / "incoming"
    write(folder, "a.csv", FIRST)
    first = ingest_new_files(spark, str(folder), store, state)
    assert told(first) == (6, 5, 1, 2, 4, 1)
    write(folder, "b.csv", FIRST[:5])
    second = ingest_new_files(spark, str(folder), store, state)
    assert told(second) == (5, 5, 0, 2, 0, 5)
    assert told(first) == (6, 5, 1, 2, 4, 1)
    whole = stream_report(spark, state)
    assert told(whole) == (11, 10, 1, 4, 4, 6)
    one = whole.stats().first()
    assert (one.distinct_cases, one.distinct_events, one.min_ts, one.max_ts) == (
        1, 1, datetime(2024, 1, 1, 8), datetime(2024, 2, 1, 8),
    )
    assert [tuple(r) for r in whole.top_events().collect()] == [("Ticket created", 10)]
    sources = {(r.file.rpartition("/")[2], r.target): r.source for r in whole.mappings().collect()}
    assert len(sources) == 22 and sources["a.csv", "priority"] == "severity"
    assert told(ingest_new_files(spark, str(folder), store, state)) == (0, 0, 0, 0, 0, 0)


def test_a_repeated_batch_reports_what_it_inserted_first(spark, store, tmp_path):
    """The batch is stored, but the stream fails before its checkpoint says so."""
    state = scratch_dir(spark, "stream")
    folder = tmp_path / "incoming"
    write(folder, "a.csv", FIRST)
    told_first = told(ingest_new_files(spark, str(folder), store, state))
    version = store.version()
    commits = Path(re.sub("^file:", "", state)) / "commits"
    for file in commits.iterdir():
        file.unlink()
    again = ingest_new_files(spark, str(folder), store, state)
    assert told(again) == told_first == (6, 5, 1, 2, 4, 1)
    assert told(stream_report(spark, state)) == told_first
    assert store.version() == version and store.read().count() == 4


def test_a_scope_drops_its_folders_when_the_result_is_written(spark, tmp_path):
    with scratch_scope(spark):
        outer = stored(spark.range(5), "outer")
        with scratch_scope(spark):
            stored(outer, "inner")
            inner_folder = scratch_dir(spark, "probe").rpartition("/")[0]
            assert [n for n in SharedFiles(spark).names(inner_folder) if n.startswith("inner")]
        assert not [n for n in SharedFiles(spark).names(inner_folder) if n.startswith("inner")]
        outer.write.parquet(str(tmp_path / "result"))
    assert not [n for n in SharedFiles(spark).names(inner_folder) if n.startswith("outer")]
    assert spark.read.parquet(str(tmp_path / "result")).count() == 5


def test_a_task_that_fails_inside_a_scope_is_computed_again(spark, tmp_path):
    """The stored folder is still there when a later attempt reads it."""
    with scratch_scope(spark):
        rows = stored(spark.range(100).repartition(4), "rows")
        with pytest.raises(Exception, match="killed"):
            rows.select(F.when(F.col("id") == 50, F.raise_error(F.lit("killed"))).cast("long")).collect()
        rows.write.parquet(str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again")).count() == 100

"""Relations kept up to date by batches against those computed from the whole log."""

from datetime import datetime
from glob import glob

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from event_rows import row
from ticketloom import EventLogModel
from ticketloom.plans import refresh
from ticketloom.plans.refresh import CaseStore, Generations
from ticketloom.schema import LOG_SCHEMA
from ticketloom.session import scratch_dir, stored
from ticketloom.sources.event_store import dedupe_events, keyed_events
from ticketloom.sources.version_log import VersionLog

LABELS = ["Ticket created", "Ticket solved by level 1 support", "Ticket closed", "Ticket reopened by customer"]


def event(case, day, label, **values):
    return row(case, f"2024-01-{day:02} {len(label) % 20:02}:00", label, **values)


FIRST = [event(f"C{i}", d, LABELS[d % 3]) for i in range(12) for d in (3, 4, 5)]
SECOND = [event("C1", 9, LABELS[3], variant="Rework"), event("C1", 8, LABELS[2]), event("C99", 7, LABELS[0])]
THIRD = [event("C5", 1, LABELS[0]), *FIRST[:6], *SECOND, event("C99", 8, LABELS[2], resolver="L2")]


@pytest.fixture(scope="module")
def keyed_of(spark):
    return lambda rows: keyed_events(spark.createDataFrame(rows, LOG_SCHEMA))


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("in_task_rows", [2_000_000, 2])
def test_three_batches_equal_a_full_rebuild(spark, keyed_of, in_task_rows):
    store = CaseStore(spark, scratch_dir(spark, "cases"), groups=5, in_task_rows=in_task_rows)
    counts = [store.refresh(keyed_of(batch)) for batch in (FIRST, SECOND, THIRD)]
    assert counts == [12, 2, 2]
    whole = EventLogModel.over(dedupe_events(keyed_of([*FIRST, *SECOND, *THIRD])))
    model = store.model()
    assert rows_of(model.sequence) == rows_of(whole.sequence)
    assert rows_of(model.closed) == rows_of(whole.closed)
    assert store.refresh(keyed_of([*THIRD, *FIRST])) == 0
    earlier = EventLogModel.over(dedupe_events(keyed_of(FIRST)))
    assert rows_of(store.model(1).closed) == rows_of(earlier.closed)


def test_a_batch_is_shuffled_once_to_meet_the_stored_keys(spark, keyed_of, monkeypatch):
    """The exchange that drops copies is the one that the join on the key needs."""
    plans, keep = [], refresh.stored

    def watched(df, name):
        if name == "unseen":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(refresh, "stored", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = CaseStore(spark, scratch_dir(spark, "cases"), groups=5)
        assert [store.refresh(keyed_of(rows)) for rows in (FIRST, THIRD)] == [12, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[-1].count("Exchange hashpartitioning(event_key") == 2


def test_only_touched_groups_are_read_and_rewritten(spark, keyed_of):
    store = CaseStore(spark, scratch_dir(spark, "cases"), groups=8)
    store.refresh(keyed_of(FIRST))
    before = store.log.latest()
    store.refresh(keyed_of(SECOND))
    after = store.log.latest()
    changed = {g for g in after.folders if after.folders[g] != before.folders.get(g)}
    wanted = {r[0] for r in keyed_of(SECOND).selectExpr("pmod(xxhash64(case_id), 8)").distinct().collect()}
    assert changed == wanted and len(changed) < len(before.folders)
    files = store._read(before, "event_seq", changed).inputFiles()
    assert files and all(any(f"case_group={g}/" in f for g in changed) for f in files)


def test_a_rival_refresh_is_not_lost(spark, keyed_of, monkeypatch):
    store = CaseStore(spark, scratch_dir(spark, "cases"), groups=2)
    rival = CaseStore(spark, store.path)
    store.refresh(keyed_of(FIRST))
    publish, ran = VersionLog.publish, []

    def late(self, version):
        if not ran and isinstance(version, Generations):
            ran.append(True)
            rival.refresh(keyed_of(SECOND[:1]))
        publish(self, version)

    monkeypatch.setattr(VersionLog, "publish", late)
    store.refresh(keyed_of(SECOND[1:]))
    whole = EventLogModel.over(dedupe_events(keyed_of([*FIRST, *SECOND])))
    assert rows_of(store.model().closed) == rows_of(whole.closed)
    assert rows_of(store.model().sequence) == rows_of(whole.sequence)


def test_an_empty_store(spark, keyed_of):
    store = CaseStore(spark, scratch_dir(spark, "cases"))
    assert store.refresh(keyed_of([])) == 0
    assert store.model().closed.count() == store.model().sequence.count() == 0


def store_in_buckets(spark, **kwargs):
    return CaseStore(spark, scratch_dir(spark, "cases"), groups=2, buckets_from=0, **kwargs)


# Of 4 rows, C1 becomes too large for a task with the second batch.
@pytest.mark.parametrize("in_task_rows", [2_000_000, 4])
def test_a_store_in_buckets_equals_a_full_rebuild(spark, keyed_of, in_task_rows):
    store = store_in_buckets(spark, in_task_rows=in_task_rows)
    counts = [store.refresh(keyed_of(batch)) for batch in (FIRST, SECOND, [*THIRD, *THIRD])]
    assert counts == [12, 2, 2] and store.log.latest().buckets
    whole = EventLogModel.over(dedupe_events(keyed_of([*FIRST, *SECOND, *THIRD])))
    model = store.model()
    assert rows_of(model.sequence) == rows_of(whole.sequence)
    assert rows_of(model.closed) == rows_of(whole.closed)
    assert store.refresh(keyed_of([*THIRD, *FIRST])) == 0
    earlier = EventLogModel.over(dedupe_events(keyed_of(FIRST)))
    assert rows_of(store.model(1).sequence) == rows_of(earlier.sequence)


def test_only_rows_of_touched_cases_are_written(spark, keyed_of):
    store = CaseStore(spark, scratch_dir(spark, "cases"), groups=1)
    for batch, rows in ((FIRST, 36), (SECOND, 36 + 6)):
        store.refresh(keyed_of(batch))
        files = glob(f"{store.path}/**/event_seq/**/*.parquet", recursive=True)
        assert spark.read.parquet(*files).count() == rows


def test_events_in_buckets_are_shuffled_once(spark, keyed_of, monkeypatch):
    plans, write, insert = [], DataFrameWriter.parquet, DataFrameWriter.insertInto

    def watched(kept):
        def run(self, *args, **kwargs):
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
            return kept(self, *args, **kwargs)

        return run

    monkeypatch.setattr(DataFrameWriter, "parquet", watched(write))
    monkeypatch.setattr(DataFrameWriter, "insertInto", watched(insert))
    store = store_in_buckets(spark)
    batches = [stored(keyed_of(rows), "batch") for rows in (FIRST, THIRD)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans.clear()
        assert [store.refresh(batch, fixed=True) for batch in batches] == [12, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Samples of large cases aggregate ids before they shuffle them.
    shuffles = [p for p in plans if "Exchange hashpartitioning" in p or "rebalance" in p.lower()]
    shuffles = [p for p in shuffles if "Sample" not in p]
    assert len(shuffles) == 2 and all(p.count("Exchange hashpartitioning(case_id") == 1 for p in shuffles)
    assert all(p.count("Exchange hashpartitioning") == 1 for p in shuffles)


def test_a_store_that_grows_gets_buckets_and_few_layers(spark, keyed_of, monkeypatch):
    monkeypatch.setattr(refresh, "LAYERS", 2)
    store = CaseStore(spark, scratch_dir(spark, "cases"), groups=2, buckets_from=37)
    assert store.refresh(keyed_of(FIRST)) == 12 and not store.log.latest().buckets
    assert store.refresh(keyed_of(SECOND)) == 2 and store.log.latest().buckets
    monkeypatch.setattr(refresh, "LAYERS", 8)
    monkeypatch.setattr(refresh, "BROADCAST_ROWS", 0)
    assert store.refresh(keyed_of(THIRD)) == 2 and not store.log.latest().hidden
    whole = EventLogModel.over(dedupe_events(keyed_of([*FIRST, *SECOND, *THIRD])))
    assert rows_of(store.model().sequence) == rows_of(whole.sequence)
    assert rows_of(store.model().closed) == rows_of(whole.closed)
    assert store.refresh(keyed_of([*THIRD, *FIRST])) == 0


def test_odd_cases_and_keys_are_taken_alike_in_buckets(spark, keyed_of):
    """A case that is NULL or blank, a time that is NULL, keys that are no digests, copies of all."""
    timeless, later = [tuple(None if isinstance(v, datetime) else v for v in event("C1", 9, LABELS[i])) for i in (1, 0)]
    odd = [event(None, 3, LABELS[0]), event("", 3, LABELS[0]), event("", 4, LABELS[2]), timeless]
    first = keyed_of([*odd, *odd, *FIRST[:4]])
    named = first.withColumn("event_key", F.expr("if(case_id = 'C0', upper(concat('é', event_key)), event_key)"))
    second = named.unionByName(keyed_of([event("", 5, LABELS[3]), later]))
    stores = [CaseStore(spark, scratch_dir(spark, "cases"), groups=2, buckets_from=n) for n in (0, 10**6)]
    found = []
    for store in stores:
        counts = [store.refresh(batch) for batch in (named, second, second)]
        model = store.model()
        found.append((counts, rows_of(model.sequence), rows_of(model.closed), store.log.latest().rows))
    assert found[0] == found[1] and found[0][0][2] == 0 and found[0][1]

"""The stored event log: keys, de-duplication, idempotent append, replacement and load statistics."""

from __future__ import annotations

import math
import time
import uuid
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ticketloom.functions.keys import event_key
from ticketloom.schema import EVENT_COLUMNS, EVENT_SCHEMA, REQUIRED_COLUMNS, TARGET_COLUMNS
from ticketloom.session import CODEC, stored
from ticketloom.sources.version_log import Load, SharedFiles, Version, VersionLog, VersionTaken

MONTH = "event_month"
TOP_EVENTS = 5

# Buckets of a new store, at least: a first load of more than BUCKET_ROWS rows for each gets more of them. A bucket
# of a month is at least one file of each load that touches it.
BUCKETS = 8
BUCKET_ROWS = 500_000
# Rows up to which a task takes a whole bucket of a load.
TASK_ROWS = 2_000_000
# Copies of one event from which on they are dropped before they are shuffled, as a sample tells.
MANY_COPIES, SAMPLED_COPIES = 1_000_000, 200
PARTITIONS_AT_ONCE = 500
# How the folder of events without a time is named.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def keyed_events(log: DataFrame) -> DataFrame:
    return log.select(event_key().alias("event_key"), *TARGET_COLUMNS)


def dedupe_events(keyed: DataFrame) -> DataFrame:
    """One row per event_key, the smallest of its copies.

    Copies of a key differ at most in NULL against an empty text, and NULL is smaller, so the result does
    not depend on the order of the input. Copies are dropped on the map side first, however many there are.
    """
    smallest = keyed.groupBy("event_key").agg(F.min(F.struct(*TARGET_COLUMNS)).alias("event_row"))
    return smallest.select("event_key", "event_row.*")


def unique_in_case(keyed: DataFrame) -> DataFrame:
    """The same for rows that are partitioned by case_id already.

    A key covers case and timestamp, so copies are neighbours in the order that the sequence of a
    case needs anyway; that sort is shared and no further shuffle is needed.
    """
    rest = [c for c in TARGET_COLUMNS if c not in ("case_id", "ts")]
    in_case = Window.partitionBy("case_id").orderBy("ts", "event_key", *rest)
    return (
        keyed.withColumn("previous_key", F.lag("event_key").over(in_case))
        .filter(~F.col("event_key").eqNullSafe(F.col("previous_key")))
        .drop("previous_key")
    )


def unseen_events(batch: DataFrame, stored_events: DataFrame) -> DataFrame:
    """The events of a batch that the store does not hold yet, each once."""
    seen = stored_events.select("event_key")
    return dedupe_events(batch).join(seen, "event_key", "left_anti").select(*EVENT_COLUMNS)


def _month(ts: Column) -> Column:
    return F.trunc(ts, "month")


class EventStore:
    """A Parquet event log whose loads are transactions.

    Each load writes a folder of its own, partitioned by the UTC month of the event and bucketed by the
    hash of event_key, and then publishes a version that names it. Readers hold on to the folders of one
    version, so they see a load whole or not at all; a load that fails leaves the latest version as it was.
    A writer whose version has been taken by another one starts again from that one's version.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.data = f"{self.path}/data"
        self.files = SharedFiles(spark)
        self.log = VersionLog(self.files, f"{self.path}/versions")
        self._new_buckets = buckets

    def version(self) -> int:
        """The number of the latest version; 0 before the first load."""
        return self.log.latest().number

    def read(self, version: int | None = None) -> DataFrame:
        """The events of the latest version, or of an earlier one, whatever is loaded meanwhile."""
        return self._months(self.log.latest() if version is None else self.log.at(version)).select(*EVENT_COLUMNS)

    def _months(self, version: Version) -> DataFrame:
        schema = StructType([*EVENT_SCHEMA.fields, StructField(MONTH, DateType())])
        folders = [f"{self.data}/load={load.name}" for load in version.loads]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.data).parquet(*folders)

    def append_new(self, batch: DataFrame, origin: tuple[str, int] | None = None, fixed: bool = False) -> int:
        """Append the unseen events of a keyed batch; the number of events appended.

        A repeated load appends nothing. The key covers the timestamp, so only the stored months that the
        batch touches can hold a copy, and only those are read. For these months keys alone are shuffled first,
        into the store's buckets; whole rows are shuffled, once, only of months that hold unseen events. Stored
        keys are not shuffled.

        The batch is evaluated once, into the shared folder, unless the caller says that its rows are fixed: read
        from files that stay as they are, so that they can be read again.

        `origin` names a stream and the number of its batch. The version remembers the last one of each
        stream, so a batch that comes again gives the number that it gave first.
        """
        if origin and (known := self.log.latest().streams.get(origin[0])) and known[0] == origin[1]:
            return known[1]
        batch, months = self._with_months(batch, fixed)
        while True:
            base = self.log.latest()
            load = self._append(base, batch, months) if months else None
            if not load and not origin:
                return 0
            try:
                self._publish(base, base.loads + ((load,) if load else ()), origin, load)
                return load.rows if load else 0
            except VersionTaken:
                # What the other writer stored may hold some of these events.
                self._discard(load)

    def _with_months(self, batch: DataFrame, fixed: bool) -> tuple[DataFrame, dict[str | None, int]]:
        """The batch with its months, and its rows, copies included, per month: one row per month of its span."""
        batch = (batch if fixed else stored(batch, "batch")).withColumn(MONTH, _month(F.col("ts")))
        counts = batch.groupBy(F.col(MONTH).cast("string").alias(MONTH)).count().collect()
        return batch, {r[MONTH]: r["count"] for r in counts}

    def _append(self, base: Version, batch: DataFrame, months: dict[str | None, int]) -> Load | None:
        there = {m for load in base.loads for m in load.months}
        shared = [m for m in months if m in there]
        if shared:
            with self._bucketed(base) as table:
                keys = _of_months(batch, shared).select("event_key", MONTH)
                tasks = _tasks(sum(months[m] for m in shared), base.buckets)
                unseen = self._unseen(table, base, keys, shared, tasks).select(F.col(MONTH).cast("string"))
                found = {r[0] for r in unseen.distinct().collect()}
            months = {m: n for m, n in months.items() if m not in there or m in found}
            batch = _of_months(batch, list(months))
        return self._write(base, batch, sum(months.values()), [m for m in shared if m in months]) if months else None

    def replace(self, batch: DataFrame, fixed: bool = False) -> int:
        """Drop the stored events and load the batch; the number of events loaded.

        Until the batch is written whole, readers see what was stored before. `fixed` as in `append_new`.
        """
        batch, months = self._with_months(batch, fixed)
        rows = sum(months.values())
        # None of the stored loads stays, so the buckets may change.
        base = Version(buckets=None)
        load = self._write(base, batch, rows)
        return self._publish_over_others(lambda now: (load,) if load else (), load, anew=bool(load))

    def compact(self) -> int:
        """Put the loads of the latest version into one, so that few large files hold the log; its rows.

        Events are read and written bucket by bucket, and not shuffled.
        """
        base = self.log.latest()
        load = self._write(base, None, sum(load.rows for load in base.loads)) if base.loads else None

        def loads(now: Version) -> tuple[Load, ...]:
            if not set(base.loads) <= set(now.loads):
                raise RuntimeError("the loads that were compacted have been replaced meanwhile")
            return tuple([load] if load else []) + tuple(x for x in now.loads if x not in base.loads)

        return self._publish_over_others(loads, load)

    def vacuum(self, versions: int = 1, hours: float = 24) -> list[str]:
        """Delete all but the latest versions, and the loads that none of those names; their folders' names.

        Folders changed within the last hours may belong to a load that goes on, and stay.
        """
        numbers = self.log.numbers()
        kept = numbers[-versions:] if versions else []
        named = {f"load={load.name}" for n in kept for load in self.log.at(n).loads}
        for number in numbers[: len(numbers) - len(kept)]:
            self.log.forget(number)
        latest = (time.time() - hours * 3600) * 1000
        there = {n: t for n, t in self.files.names(self.data).items() if n.startswith("load=")}
        dropped = [n for n, changed in there.items() if n not in named and changed <= latest]
        for name in dropped:
            self.files.delete(f"{self.data}/{name}")
        return sorted(dropped)

    def _publish(self, base: Version, loads: tuple[Load, ...], origin=None, load: Load | None = None) -> None:
        streams = base.streams | ({origin[0]: (origin[1], load.rows if load else 0)} if origin else {})
        buckets = base.buckets or (load.buckets if load else None) or self._new_buckets
        self.log.publish(Version(base.number + 1, buckets, loads, streams))

    def _publish_over_others(self, loads, load: Load | None, anew: bool = False) -> int:
        """Publishes what does not depend on the stored events, after all that others published meanwhile."""
        while True:
            base = self.log.latest()
            try:
                self._publish(replace(base, buckets=None) if anew else base, loads(base), load=load)
                return load.rows if load else 0
            except VersionTaken:
                continue
            except BaseException:
                self._discard(load)
                raise

    def _discard(self, load: Load | None) -> None:
        if load:
            self.files.delete(f"{self.data}/load={load.name}")

    @contextmanager
    def _bucketed(self, version: Version, buckets: int | None = None):
        """The version's folders as a table that knows its buckets, for the time of one load."""
        name = f"event_store_{uuid.uuid4().hex}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA.fields)
        location = self.data.replace("'", "\\'")
        self.spark.sql(
            f"""CREATE TABLE {name} ({columns}, load STRING, {MONTH} DATE) USING parquet
            OPTIONS (compression '{CODEC}') PARTITIONED BY (load, {MONTH})
            CLUSTERED BY (event_key) SORTED BY (event_key) INTO {buckets or version.buckets or self._new_buckets} BUCKETS
            LOCATION '{location}'"""
        )
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _stored(self, table: str, version: Version, months: list[str] | None = None) -> DataFrame:
        """Stored events of the months, or of all, already in their buckets."""
        parts = [(load.name, m) for load in version.loads for m in load.months if months is None or m in set(months)]
        for at in range(0, len(parts), PARTITIONS_AT_ONCE):
            listed = " ".join(
                f"PARTITION (load='{name}', {MONTH}={'NULL' if m == NO_MONTH else repr(m)})"
                for name, m in parts[at : at + PARTITIONS_AT_ONCE]
            )
            self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {listed}")
        return self.spark.table(table)

    def _stored_keys(self, table: str, version: Version, months: list[str]) -> DataFrame:
        return self._stored(table, version, months).select("event_key")

    def _unseen(
        self, table: str, version: Version, batch: DataFrame, months: list[str], tasks: int | None = None
    ) -> DataFrame:
        """Events of the batch, in the store's buckets, whose keys are not stored; stored keys stay where they are."""
        dealt = batch.repartition(tasks or version.buckets or self._new_buckets, "event_key")
        return dealt.join(self._stored_keys(table, version, months), "event_key", "left_anti")

    def _write(self, base: Version, batch: DataFrame | None, rows: int, months: list[str] = ()) -> Load | None:
        """A new folder with the events of the batch that the months do not hold; None, and no folder, without any.

        Without a batch these are the events of the version.
        """
        name = uuid.uuid4().hex
        written = Observation()
        buckets = base.buckets or max(self._new_buckets, math.ceil(rows / BUCKET_ROWS))
        try:
            with self._bucketed(base, buckets) as table:
                if batch is None:
                    events = self._stored(table, base)
                elif months:
                    events = self._unseen(table, base, _few_copies(batch), months, _tasks(rows, buckets))
                else:
                    events = _few_copies(batch).repartition(_tasks(rows, buckets), "event_key")
                # The rows of a key are in one task already.
                events = dedupe_events(events).withColumn(MONTH, _month(F.col("ts")))
                events = events.select(*EVENT_COLUMNS, F.lit(name).alias("load"), MONTH)
                events.observe(written, F.count(F.lit(1)).alias("rows")).write.insertInto(table)
            found_rows = written.get["rows"]
            if not found_rows:
                return None
            prefix = f"{MONTH}="
            found = self.files.names(f"{self.data}/load={name}")
            found_months = sorted(n[len(prefix) :] for n in found if n.startswith(prefix))
            return Load(name, found_rows, tuple(found_months), buckets)
        except BaseException:
            self.files.delete(f"{self.data}/load={name}")
            raise


def _of_months(batch: DataFrame, months: list[str | None]) -> DataFrame:
    named = F.col(MONTH).isin([F.lit(m).cast("date") for m in months if m is not None])
    return batch.where(F.col(MONTH).isNull() | named if None in months else named)


def _tasks(rows: int, buckets: int) -> int:
    """One task per bucket, or several per bucket of a load whose buckets are too large for one."""
    return buckets * max(1, math.ceil(rows / (buckets * TASK_ROWS)))


def _few_copies(batch: DataFrame) -> DataFrame:
    """The batch; if an event has very many copies, these are dropped on the map side, by a shuffle of their own."""
    sampled = batch.select("event_key").sample(SAMPLED_COPIES / MANY_COPIES, seed=11).groupBy("event_key").count()
    if sampled.where(F.col("count") * 2 >= SAMPLED_COPIES).isEmpty():
        return batch
    return dedupe_events(batch)


def load_stats(
    cleaned: DataFrame, inserted: DataFrame | int | None = None, distinct: bool = True
) -> DataFrame:
    """One row of counts for a load, in one pass over the cleaned rows (with marks).

    `inserted` is the frame of inserted events, or their number. Without it the load is a validation: every
    valid row counts as insertable. Without `distinct` the numbers of different cases and labels are left out.
    """
    valid = F.lit(True)
    for c in REQUIRED_COLUMNS:
        valid = valid & F.col(c).isNotNull()
    different = [
        F.count_distinct(F.when(F.col("valid"), F.col("case_id"))).alias("distinct_cases"),
        F.count_distinct(F.when(F.col("valid"), F.col("event"))).alias("distinct_events"),
    ]
    one = cleaned.withColumn("valid", valid).agg(
        F.count(F.lit(1)).alias("rows_input"),
        F.count_if("valid").alias("rows_valid"),
        F.count_if("score_dropped").alias("nulled_scores"),
        *(different if distinct else []),
        F.min(F.when(F.col("valid"), F.col("ts"))).alias("min_ts"),
        F.max(F.when(F.col("valid"), F.col("ts"))).alias("max_ts"),
    )
    if inserted is None:
        one = one.withColumn("rows_inserted", F.col("rows_valid"))
    elif isinstance(inserted, int):
        one = one.withColumn("rows_inserted", F.lit(inserted).cast("bigint"))
    else:
        stacked = one.unionByName(inserted.agg(F.count(F.lit(1)).alias("rows_inserted")), allowMissingColumns=True)
        one = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    return one.withColumns(
        {
            "rows_dropped": F.col("rows_input") - F.col("rows_valid"),
            "rows_duplicate": F.col("rows_valid") - F.col("rows_inserted"),
        }
    )


def top_events(valid: DataFrame, rows: int = TOP_EVENTS) -> DataFrame:
    """The most frequent raw labels of a load."""
    counts = valid.groupBy("event").agg(F.count(F.lit(1)).alias("events"))
    return counts.orderBy(F.desc("events"), "event").limit(rows)

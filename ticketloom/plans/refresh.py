"""Derived relations that are kept up to date: a batch recomputes the cases that it touches."""

from __future__ import annotations

import json
import math
import uuid
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.plans.model import EventLogModel
from ticketloom.plans.skew import IN_TASK_ROWS, LogParts, large_case_ids
from ticketloom.reference import ReferenceData
from ticketloom.schema import EVENT_COLUMNS, EVENT_SCHEMA, TARGET_COLUMNS
from ticketloom.session import BROADCAST_ROWS, CODEC, broadcast_up_to, require_utc, stored
from ticketloom.sources.event_store import BUCKET_ROWS, BUCKETS, PARTITIONS_AT_ONCE, dedupe_events
from ticketloom.sources.version_log import SharedFiles, VersionLog, VersionTaken

GROUP = "case_group"
# Groups of a new store: a batch reads the groups of its cases alone.
GROUPS = 16
# Events from which on a store keeps those of normal cases in buckets by case.
BUCKETS_FROM = 2_000_000
# A store gets more buckets when they hold so many times BUCKET_ROWS on average.
FULL = 4
# Layers of a group that are put into one.
LAYERS = 8
# Files that a task writes at once, at most.
FILES_AT_ONCE = 64

# Events in buckets; events by group alone; cases that a layer takes over from earlier ones.
EVENTS, SPREAD, HIDDEN = "events", "spread_events", "hidden_cases"
DERIVED = ("event_seq", "closed_cases")
RELATIONS = (EVENTS, SPREAD, *DERIVED)

# Copies of an event have one case, but for these: NULL and an empty text have one key.
_HAS_CASE, _NO_CASE = "coalesce(case_id, '') <> ''", "coalesce(case_id, '') = ''"

# A key of hexadecimal digits is shuffled as its bytes, which are half as many; any other as it is.
_IS_HEX = "lower(hex(unhex(event_key))) <=> event_key"
_KEY_BYTES, _KEY_TEXT = f"IF({_IS_HEX}, unhex(event_key), NULL)", f"IF({_IS_HEX}, NULL, event_key)"
_KEY = "coalesce(lower(hex(key_bytes)), key_text)"

Layers = dict[int, tuple[tuple[str, tuple[str, ...]], ...]]


@dataclass(frozen=True)
class Generations:
    """For each group of cases its layers, earliest first: their names, and the relations that have rows there.

    The names sort by version. `hidden` has the number of cases that a layer computed anew: the derived rows that
    earlier layers have of them count no more.
    """

    number: int = 0
    groups: int | None = None
    folders: Layers = field(default_factory=dict)
    hidden: dict[str, int] = field(default_factory=dict)
    rows: int = 0
    buckets: int | None = None

    def json(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("groups", "folders", "hidden", "rows", "buckets")})

    @classmethod
    def of(cls, number: int, text: str) -> "Generations":
        found = json.loads(text)
        if "rows" not in found:
            raise RuntimeError("this store has the layout of an earlier release; refresh a new one with its log")
        folders = {int(g): tuple((name, tuple(r)) for name, r in of) for g, of in found.pop("folders").items()}
        return cls(number, folders=folders, **found)

    def layers(self, groups, relation: str) -> dict[str, list[int]]:
        """The layers that have the relation in some of the groups, earliest first, and these groups."""
        found: dict[str, list[int]] = {}
        for g in sorted(set(groups) & set(self.folders)):
            for name, relations in self.folders[g]:
                if relation in relations:
                    found.setdefault(name, []).append(g)
        return dict(sorted(found.items()))

    @property
    def deepest(self) -> int:
        return max(map(len, self.folders.values()), default=0)


class CaseStore:
    """Events, event_seq and closed cases of a log, in groups by the hash of case_id.

    A refresh reads the touched groups alone and writes a layer: the unseen events, and the derived rows of the
    cases that these touch. The version that is published last names it. Readers hold on to the layers of a version;
    of a case that several layers have derived rows of, the last one's count. When a group has many layers, or these
    take many cases over, they are put into one.

    A store of many events deals those of a batch into buckets by case_id. Nothing else shuffles them: copies, the
    stored events of their cases and both derived relations are met in the bucket. Events of a case that is too large
    for a task, or without case_id, are spread over tasks by their key instead, like all events of a small store.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        groups: int = GROUPS,
        reference: ReferenceData | None = None,
        in_task_rows: int = IN_TASK_ROWS,
        buckets_from: int = BUCKETS_FROM,
    ):
        require_utc(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self.reference = reference or ReferenceData.defaults(spark)
        self.in_task_rows = in_task_rows
        self.buckets_from = buckets_from
        self.files = SharedFiles(spark)
        self.log = VersionLog(self.files, f"{self.path}/versions", Generations)
        self._new_groups = groups

    def model(self, version: int | None = None, in_task: bool = False) -> EventLogModel:
        """The model over the relations of the latest version, or of an earlier one."""
        at = self.log.latest() if version is None else self.log.at(version)
        sequence, closed = (self._read(at, name, at.folders) for name in DERIVED)
        return EventLogModel.of_relations(sequence, closed, self.reference, in_task)

    def refresh(self, batch: DataFrame, fixed: bool = False) -> int:
        """Take the unseen events of a keyed batch in; the number of cases computed anew.

        Another writer in between makes it start again from that one's version. The batch is evaluated once,
        into the shared folder, unless the caller says that its rows are fixed: read from files that stay as
        they are. Its rows are shuffled once, to drop copies and to meet the stored events.
        """
        batch = batch if fixed else stored(batch, "batch")
        while True:
            base = self.log.latest()
            base = replace(base, groups=base.groups or self._new_groups)
            taken = _Taken(batch, self._in_group(base))
            if not taken.groups:
                return 0
            room = base.buckets * BUCKET_ROWS * FULL if base.buckets else self.buckets_from
            if base.rows + taken.rows > room:
                buckets = max(BUCKETS, math.ceil((base.rows + taken.rows) / BUCKET_ROWS))
                if base.folders:
                    self._put_together(base, buckets)
                    continue
                base = replace(base, buckets=buckets)
            name = _new_layer(base)
            try:
                after, count = self._take(base, name, taken)
                if not count:
                    self._delete(name)
                    return 0
                self.log.publish(after)
            except VersionTaken:
                self._delete(name)
                continue
            except BaseException:
                self._delete(name)
                raise
            if after.deepest >= LAYERS or sum(after.hidden.values()) > BROADCAST_ROWS:
                self._put_together(after, after.buckets)
            return count

    def _in_group(self, at: Generations) -> Column:
        return F.pmod(F.xxhash64("case_id"), F.lit(at.groups)).cast("int")

    def _path(self, relation: str, name: str) -> str:
        return f"{self.path}/{relation}/load={name}"

    def _delete(self, name: str) -> None:
        for relation in (*RELATIONS, HIDDEN):
            self.files.delete(self._path(relation, name))
        self.files.delete(self._path(EVENTS, _again(name)))

    def _groups_in(self, relation: str, name: str) -> list[int]:
        prefix = f"{GROUP}="
        found = self.files.names(self._path(relation, name))
        return sorted(int(n[len(prefix) :]) for n in found if n.startswith(prefix))

    # Reading

    @cached_property
    def _schemas(self) -> dict[str, T.StructType]:
        empty = EventLogModel.over(self.spark.createDataFrame([], EVENT_SCHEMA), self.reference)
        derived = {"event_seq": empty.sequence.schema, "closed_cases": empty.closed.schema}
        return {EVENTS: EVENT_SCHEMA, SPREAD: EVENT_SCHEMA, **derived}

    def _files(self, relation: str, layers: dict[str, list[int]]) -> DataFrame:
        paths = [f"{self._path(relation, name)}/{GROUP}={g}" for name, groups in layers.items() for g in groups]
        if not paths:
            return self.spark.createDataFrame([], self._schemas[relation])
        return self.spark.read.schema(self._schemas[relation]).parquet(*paths)

    def _read(self, at: Generations, relation: str, groups) -> DataFrame:
        """The rows of a relation in some groups, whose folders alone are read."""
        layers = at.layers(groups, relation)
        # Layers whose cases the same later ones take over are read at once.
        alike: dict[tuple[str, ...], dict[str, list[int]]] = {}
        for name, of in layers.items():
            later = tuple(h for h in sorted(at.hidden) if h > name and relation in DERIVED)
            alike.setdefault(later, {})[name] = of
        parts = []
        for later, some in alike.items():
            rows = self._files(relation, some)
            if later:
                hidden = self.spark.read.schema("case_id STRING").parquet(*[self._path(HIDDEN, h) for h in later])
                hidden = broadcast_up_to(hidden, sum(at.hidden[h] for h in later))
                rows = rows.join(hidden, "case_id", "left_anti").select(*rows.columns)
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts) if parts else self._files(relation, {})

    @contextmanager
    def _table(self, buckets: int | None, layers: dict[str, list[int]]):
        """The bucketed events of some layers as a table that knows its buckets, while a layer is made; None without."""
        if not buckets:
            yield None
            return
        name = f"case_store_{uuid.uuid4().hex}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA.fields)
        location = f"{self.path}/{EVENTS}".replace("'", "\\'")
        self.spark.sql(
            f"""CREATE TABLE {name} ({columns}, load STRING, {GROUP} INT) USING parquet
            OPTIONS (compression '{CODEC}') PARTITIONED BY (load, {GROUP})
            CLUSTERED BY (case_id) INTO {buckets} BUCKETS LOCATION '{location}'"""
        )
        try:
            parts = [f"PARTITION (load='{layer}', {GROUP}={g})" for layer, groups in layers.items() for g in groups]
            for at in range(0, len(parts), PARTITIONS_AT_ONCE):
                listed = " ".join(parts[at : at + PARTITIONS_AT_ONCE])
                self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {listed}")
            yield name
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    # A layer of a batch

    def _take(self, base: Generations, name: str, taken: _Taken) -> tuple[Generations, int]:
        """The version with a layer of the unseen events and of the cases that these touch, and their number."""
        with self._table(base.buckets, base.layers(taken.groups, EVENTS)) as table:
            in_buckets, spread, large = self._by_size(base, taken, table)
            if in_buckets is not None:
                self._append_in_buckets(base, name, taken, in_buckets, table)
            if spread is not None:
                self._append_spread(base, name, taken, spread, large, table)
            new = {relation: self._groups_in(relation, name) for relation in (EVENTS, SPREAD)}
            layers = [
                layer(self, base, name, groups, table)
                for layer, groups in ((_BucketLayer, new[EVENTS]), (_SpreadLayer, new[SPREAD]))
                if groups
            ]
            count = sum(layer.cases.count() for layer in layers)
            if not count:
                return base, 0
            hidden = [layer.taken_over for layer in layers if layer.taken_over is not None]
            if hidden:
                reduce(DataFrame.unionByName, hidden).write.parquet(self._path(HIDDEN, name), compression=CODEC)
            for layer in layers:
                model = layer.model()
                for relation, rows in zip(DERIVED, (model.sequence, model.closed)):
                    self._write(rows, relation, name, base, even=isinstance(layer, _SpreadLayer))
            self.files.delete(self._path(EVENTS, _again(name)))
            rows = sum(self._files(relation, {name: groups}).count() for relation, groups in new.items() if groups)
            hidden_now = {name: sum(layer.taken_over_cases for layer in layers)} if hidden else {}
        folders = {g: (*base.folders.get(g, ()), *of) for g, of in self._layer_of(name).items()}
        after = replace(
            base,
            number=base.number + 1,
            folders=base.folders | folders,
            hidden=base.hidden | {n: cases for n, cases in hidden_now.items() if cases},
            rows=base.rows + rows,
        )
        return after, count

    def _layer_of(self, name: str) -> Layers:
        there = {relation: self._groups_in(relation, name) for relation in RELATIONS}
        groups = sorted(set().union(*there.values()))
        return {g: ((name, tuple(r for r in RELATIONS if g in there[r])),) for g in groups}

    def _by_size(self, base: Generations, taken: _Taken, table: str | None) -> tuple[DataFrame | None, ...]:
        """Rows of a batch that go to buckets, those that are spread, and the cases of these that buckets may hold.

        None stands for no rows.

        A case is spread if batch and store together have too many rows of it for a task, or if it was spread before.
        """
        batch = taken.batch
        if table is None:
            return None, batch, None
        spread = base.layers(taken.groups, SPREAD)
        ids = [batch.select("case_id")]
        if base.layers(taken.groups, EVENTS):
            ids.append(self.spark.table(table).select("case_id"))
        large = large_case_ids(reduce(DataFrame.unionByName, ids), self.in_task_rows)
        if spread:
            before = self._files(SPREAD, spread).select("case_id")
            large = stored((before if large is None else before.unionByName(large)).distinct(), "spread-cases")
        if large is None:
            return batch.where(_HAS_CASE), batch.where(_NO_CASE) if taken.without_case else None, None
        large = large.where(_HAS_CASE)
        large = broadcast_up_to(large, large.count())
        normal = batch.where(_HAS_CASE).join(large, "case_id", "left_anti")
        spread = batch.join(large, "case_id", "left_semi").unionByName(batch.where(_NO_CASE))
        return normal, spread, large

    def _append_in_buckets(self, base: Generations, name: str, taken: _Taken, rows: DataFrame, table: str) -> None:
        rest = [c for c in TARGET_COLUMNS if c != "case_id"]
        packed = rows.selectExpr(f"{_KEY_BYTES} AS key_bytes", f"{_KEY_TEXT} AS key_text", *TARGET_COLUMNS)
        dealt = packed.repartition(base.buckets, "case_id").selectExpr(f"{_KEY} AS event_key", *TARGET_COLUMNS)
        # The smallest of the copies, as in dedupe_events, in the order that the join needs anyway.
        in_case = Window.partitionBy("case_id").orderBy("event_key", *rest)
        unseen = dealt.withColumn("previous_key", F.lag("event_key").over(in_case))
        unseen = unseen.where(~F.col("event_key").eqNullSafe(F.col("previous_key")))
        if base.layers(taken.groups, EVENTS):
            seen = self.spark.table(table).where(taken.in_span).select("case_id", "event_key")
            unseen = unseen.join(seen, ["case_id", "event_key"], "left_anti")
        layer = unseen.select(*EVENT_COLUMNS, F.lit(name).alias("load"), self._in_group(base).alias(GROUP))
        with self._as_they_lie(base):
            layer.write.insertInto(table)

    def _append_spread(
        self, base: Generations, name: str, taken: _Taken, rows: DataFrame, large: DataFrame | None, table: str | None
    ) -> None:
        seen = self._files(SPREAD, base.layers(taken.groups, SPREAD))
        if large is not None and base.layers(taken.groups, EVENTS):
            # Cases that have become too large since.
            earlier = self.spark.table(table).where(~F.col("load").startswith(name)).select(*EVENT_COLUMNS)
            seen = seen.unionByName(earlier.join(large, "case_id", "left_semi").select(*EVENT_COLUMNS))
        seen = seen.where(taken.in_span).select("event_key")
        unseen = stored(dedupe_events(rows).join(seen, "event_key", "left_anti"), "unseen")
        self._write(unseen.select(*EVENT_COLUMNS), SPREAD, name, base, even=True)

    def _write(self, rows: DataFrame, relation: str, name: str, at: Generations, even: bool) -> None:
        """Add rows to a layer, dealt evenly by group, or as they lie.

        rebalance writes few files per group and splits a group that a large case fills
        """
        rows = rows.withColumn(GROUP, self._in_group(at))
        rows = rows.hint("rebalance", GROUP) if even else rows
        with nullcontext() if even else self._as_they_lie(at):
            rows.write.mode("append").partitionBy(GROUP).parquet(self._path(relation, name), compression=CODEC)

    @contextmanager
    def _as_they_lie(self, at: Generations):
        """Writes in the order of the rows, a file of each group at a time; joins take buckets by case for keys.

        Spark would sort rows by group before it writes them, deal both sides of a join on case and key anew, and
        sort the parts of aggregates.
        """
        settings = {
            "spark.sql.maxConcurrentOutputFileWriters": str(at.groups if at.groups <= FILES_AT_ONCE else 0),
            "spark.sql.requireAllClusterKeysForCoPartition": "false",
            # The facts of a case are aggregated in the order that they come in.
            "spark.sql.execution.useObjectHashAggregateExec": "false",
        }
        before = {name: self.spark.conf.get(name) for name in settings}
        for name, value in settings.items():
            self.spark.conf.set(name, value)
        try:
            yield
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value)

    # Layers put into one

    def _put_together(self, base: Generations, buckets: int | None) -> None:
        """Publish a version of the same rows, with one layer of derived rows, in so many buckets.

        Events are written anew if the buckets change or a group has many layers. If another writer publishes
        meanwhile, all stays as that one left it.
        """
        name = _new_layer(base)
        try:
            groups = list(base.folders)
            events = buckets != base.buckets or base.deepest >= LAYERS
            if events:
                self._put_events_together(base, name, buckets)
            for relation in DERIVED:
                self._write(self._read(base, relation, groups), relation, name, base, even=not buckets)
            folders = self._layer_of(name)
            if not events:
                kept = {
                    g: tuple((n, r) for n, of in layers if (r := tuple(x for x in of if x not in DERIVED)))
                    for g, layers in base.folders.items()
                }
                folders = {g: (*layers, *folders.get(g, ())) for g, layers in kept.items()}
            self.log.publish(replace(base, number=base.number + 1, folders=folders, hidden={}, buckets=buckets))
        except VersionTaken:
            self._delete(name)
        except BaseException:
            self._delete(name)
            raise

    def _put_events_together(self, base: Generations, name: str, buckets: int | None) -> None:
        groups = list(base.folders)
        layers = {relation: base.layers(groups, relation) for relation in (EVENTS, SPREAD)}
        with self._table(base.buckets, layers[EVENTS]) as old, self._table(buckets, {}) as new, self._as_they_lie(base):
            in_buckets = self.spark.table(old).select(*EVENT_COLUMNS) if layers[EVENTS] else None
            spread = self._files(SPREAD, layers[SPREAD]) if layers[SPREAD] else None
            if buckets != base.buckets:
                rows = reduce(DataFrame.unionByName, [r for r in (in_buckets, spread) if r is not None])
                large = large_case_ids(rows.select("case_id"), self.in_task_rows)
                in_buckets, spread = rows.where(_HAS_CASE), rows.where(_NO_CASE)
                if large is not None:
                    large = large.where(_HAS_CASE)
                    large = broadcast_up_to(large, large.count())
                    spread = spread.unionByName(in_buckets.join(large, "case_id", "left_semi").select(*EVENT_COLUMNS))
                    in_buckets = in_buckets.join(large, "case_id", "left_anti").select(*EVENT_COLUMNS)
                in_buckets = in_buckets.repartition(buckets, "case_id")
            if in_buckets is not None:
                layer = in_buckets.select("*", F.lit(name).alias("load"), self._in_group(base).alias(GROUP))
                layer.write.insertInto(new)
            if spread is not None:
                self._write(spread, SPREAD, name, base, even=True)


class _Taken:
    """A batch, and what one pass over it tells: groups, rows, span, and whether events without a case are there."""

    def __init__(self, batch: DataFrame, in_group: Column):
        self.batch = batch
        found = batch.groupBy(in_group.alias(GROUP)).agg(
            F.count(F.lit(1)).alias("rows"),
            F.expr(f"count_if({_NO_CASE})").alias("without_case"),
            F.count_if(F.col("ts").isNull()).alias("without_time"),
            F.unix_micros(F.min("ts")).alias("first"),
            F.unix_micros(F.max("ts")).alias("last"),
        )
        found = found.collect()
        self.groups = [r[GROUP] for r in found]
        self.rows = sum(r["rows"] for r in found)
        self.without_case = any(r["without_case"] for r in found)
        self.without_time = any(r["without_time"] for r in found)
        self.first = min((r["first"] for r in found if r["first"] is not None), default=None)
        self.last = max((r["last"] for r in found if r["last"] is not None), default=None)

    @property
    def in_span(self) -> Column:
        """Stored events that a copy in the batch may have: a key covers the time."""
        within = F.lit(False)
        if self.first is not None:
            first, last = (F.timestamp_micros(F.lit(t).cast("bigint")) for t in (self.first, self.last))
            within = F.coalesce(F.col("ts").between(first, last), F.lit(False))
        return within | F.col("ts").isNull() if self.without_time else within


class _BucketLayer:
    """The new layer's events in buckets, with the earlier ones of their cases; nothing of it shuffles events."""

    def __init__(self, store: CaseStore, base: Generations, name: str, groups: list[int], table: str):
        self.store, self.base, self.name, self.table = store, base, name, table
        self.rows, self.new = store.spark.table(table), F.col("load") == name
        self.cases = self.rows.where(self.new).select("case_id").distinct()
        self.taken_over, self.taken_over_cases = None, 0
        if base.layers(groups, EVENTS):
            before = self.rows.where(~self.new).select("case_id").distinct()
            self.taken_over = stored(self.cases.join(before, "case_id", "left_semi"), "taken-over")
            self.taken_over_cases = self.taken_over.count()

    def _of_cases(self) -> DataFrame:
        if not self.taken_over_cases:
            return self.rows.where(self.new)
        if self.taken_over_cases > BROADCAST_ROWS:
            again = self.taken_over.withColumn("again", F.lit(True))
            return self.rows.join(again, "case_id", "left").where(self.new | F.col("again"))
        # Few earlier events are copied beside the new ones, so that all others are read once.
        earlier = self.rows.where(~self.new).join(F.broadcast(self.taken_over), "case_id", "left_semi")
        load = F.lit(_again(self.name)).alias("load")
        earlier = earlier.select(*EVENT_COLUMNS, load, self.store._in_group(self.base).alias(GROUP))
        with self.store._as_they_lie(self.base):
            earlier.write.insertInto(self.table)
        return self.store.spark.table(self.table).where(F.col("load").startswith(self.name))

    def model(self) -> EventLogModel:
        parts = LogParts(self._of_cases().select(*EVENT_COLUMNS), None, self.store.in_task_rows)
        return EventLogModel(parts, self.store.reference)


class _SpreadLayer:
    """The same of events that are not in buckets, whose cases may be too large for a task."""

    def __init__(self, store: CaseStore, base: Generations, name: str, groups: list[int], table: str | None):
        self.store = store
        new = store._files(SPREAD, {name: groups})
        self.cases = stored(new.select("case_id").distinct(), "touched-cases")
        self._few = broadcast_up_to(self.cases, self.cases.count())
        before = store._files(SPREAD, base.layers(groups, SPREAD))
        if base.layers(groups, EVENTS):
            earlier = store.spark.table(table).where(~F.col("load").startswith(name)).select(*EVENT_COLUMNS)
            before = before.unionByName(earlier.join(self._few, "case_id", "left_semi").select(*EVENT_COLUMNS))
        self.rows = before.unionByName(new)
        self.taken_over, self.taken_over_cases = None, 0
        if base.layers(groups, SPREAD) or base.layers(groups, EVENTS):
            known = before.select("case_id").distinct()
            self.taken_over = stored(self.cases.join(known, "case_id", "left_semi"), "taken-over")
            self.taken_over_cases = self.taken_over.count()

    def model(self) -> EventLogModel:
        of_cases = self.rows.join(self._few, "case_id", "left_semi").select(*EVENT_COLUMNS)
        return EventLogModel.over(of_cases, self.store.reference, self.store.in_task_rows)


def _new_layer(base: Generations) -> str:
    return f"{base.number + 1:020d}-{uuid.uuid4().hex}"


def _again(name: str) -> str:
    """A layer for the time in which another one is made: the earlier events of its cases."""
    return f"{name}-again"


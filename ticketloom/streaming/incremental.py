"""Incremental ingest: new export files of a folder into the event store, with the report of the load."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.schema import TARGET_COLUMNS
from ticketloom.session import require_utc, scratch_scope, stored
from ticketloom.sources.event_csv import (
    DELIMITER,
    cleaned,
    drop_invalid,
    file_layouts,
    file_lines,
    header_cells,
    read_layouts,
    resolve_columns,
)
from ticketloom.sources.event_store import TOP_EVENTS, EventStore, keyed_events, load_stats
from ticketloom.sources.version_log import SharedFiles

# What a batch leaves for the report, one folder of each per batch.
COUNTS = "rows_input LONG, rows_valid LONG, nulled_scores LONG, rows_inserted LONG, min_ts TIMESTAMP, max_ts TIMESTAMP"
FILES = "file STRING, multiline BOOLEAN, target STRING, source STRING"
PARTS = {"counts": COUNTS, "files": FILES, "cases": "case_id STRING", "events": "event STRING, events LONG"}


class LoadReport:
    """What the batches of a stream read, dropped and stored; every part is a frame over all of them.

    A batch's parts are replaced when it is repeated. Counts add up; case ids and labels are kept as they are,
    once per batch, so that the numbers of different ones are exact over any batches.
    """

    def __init__(self, spark: SparkSession, folder: str, batches: list[int] | None = None):
        self.spark, self.folder, self.batches = spark, folder, batches

    def _part(self, name: str) -> DataFrame:
        schema = T.StructType.fromDDL(f"{PARTS[name]}, batch INT")
        there = SharedFiles(self.spark).names(f"{self.folder}/{name}")
        numbers = {int(n.removeprefix("batch=")) for n in there if n.startswith("batch=")}
        chosen = sorted(numbers if self.batches is None else numbers & set(self.batches))
        if not chosen:
            return self.spark.createDataFrame([], schema)
        base = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/batch={b}" for b in chosen])

    def stats(self) -> DataFrame:
        """One row with the columns of `load_stats`."""
        one = self._part("counts").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows_input", "rows_valid", "nulled_scores")],
            F.coalesce(F.sum("rows_inserted"), F.lit(0)).alias("rows_inserted"),
            F.min("min_ts").alias("min_ts"),
            F.max("max_ts").alias("max_ts"),
        )
        cases = self._part("cases").agg(F.count_distinct("case_id").alias("distinct_cases"))
        labels = self._part("events").agg(F.count_distinct("event").alias("distinct_events"))
        # One row each.
        one = one.join(F.broadcast(cases), F.lit(True)).join(F.broadcast(labels), F.lit(True))
        return one.withColumns(
            {
                "rows_dropped": F.col("rows_input") - F.col("rows_valid"),
                "rows_duplicate": F.col("rows_valid") - F.col("rows_inserted"),
            }
        )

    def top_events(self, rows: int = TOP_EVENTS) -> DataFrame:
        """The most frequent raw labels."""
        counts = self._part("events").groupBy("event").agg(F.sum("events").alias("events"))
        return counts.orderBy(F.desc("events"), "event").limit(rows)

    def mappings(self) -> DataFrame:
        """file, multiline, and for each log column the header that it was read from (NULL: none)."""
        return self._part("files").drop("batch").distinct()


def _mapping_rows(spark: SparkSession, layouts: DataFrame, delimiter: str) -> DataFrame:
    """A row per file and log column. The driver resolves each different header once."""
    headers = [r["header"] for r in layouts.select("header").distinct().collect()]
    pairs = [
        (h, target, source)
        for h in headers
        for target, source in resolve_columns(header_cells(h, delimiter)).items()
    ]
    resolved = spark.createDataFrame(pairs, "header STRING, target STRING, source STRING")
    return layouts.join(F.broadcast(resolved), "header").select("file", "multiline", "target", "source")


def _load_batch(batch: DataFrame, number: int, store: EventStore, stream: str, folder: str, delimiter: str) -> None:
    spark = batch.sparkSession

    def keep(part: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{part}/batch={number}")

    with scratch_scope(spark):
        layouts = stored(file_layouts(batch), "layouts")
        keep("files", _mapping_rows(spark, layouts, delimiter))
        rows = stored(cleaned(read_layouts(spark, layouts, delimiter), marks=True), "load")
        valid = drop_invalid(rows)
        inserted = store.append_new(keyed_events(valid), (stream, number), fixed=True)
        keep("cases", valid.select("case_id").distinct())
        keep("events", valid.groupBy("event").agg(F.count(F.lit(1)).alias("events")))
        keep("counts", load_stats(rows, inserted, distinct=False).select(*T.StructType.fromDDL(COUNTS).fieldNames()))


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name that stays with the checkpoint; the store knows the stream's batches by it."""
    files, path = SharedFiles(spark), f"{checkpoint}/stream-id"
    if "stream-id" not in files.names(checkpoint):
        try:
            files.publish(path, uuid.uuid4().hex)
        except FileExistsError:
            pass
    return files.text(path)


def stream_report(spark: SparkSession, checkpoint: str, batches: list[int] | None = None) -> LoadReport:
    """The report of some batches of a stream, or of all that it has loaded."""
    return LoadReport(spark, f"{checkpoint.rstrip('/')}/load-report", batches)


def ingest_new_files(
    spark: SparkSession,
    folder: str,
    store: EventStore,
    checkpoint: str,
    delimiter: str = DELIMITER,
    files_per_batch: int = 1000,
) -> LoadReport:
    """Load every file that has not been loaded yet, then stop; the report of what this call loaded.

    The stream reads lines, which tell the header of each new file and whether its cells hold line breaks;
    the files are then read by their own headers. The stream's checkpoint remembers the files, and the store
    the last batch of the stream: a batch that is repeated after a failure appends nothing twice, and its
    report says what the first attempt inserted.
    """
    require_utc(spark)
    checkpoint = checkpoint.rstrip("/")
    stream = _stream_id(spark, checkpoint)
    lines = file_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))
    loaded: list[int] = []

    def load(batch: DataFrame, number: int) -> None:
        _load_batch(batch, number, store, stream, f"{checkpoint}/load-report", delimiter)
        loaded.append(number)

    query = (
        lines.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream_report(spark, checkpoint, loaded)

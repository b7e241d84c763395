"""A load from start to end: read, clean, store, and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketloom.session import require_utc, stored
from ticketloom.sources.event_csv import DELIMITER, cleaned, drop_invalid, read_exports
from ticketloom.sources.event_store import EventStore, keyed_events, load_stats


def load_columns(store: EventStore, columns: DataFrame, iso_day_first: bool = False, replace: bool = False) -> DataFrame:
    """Loads the log columns, given as text, and returns the row of `load_stats`.

    The text is parsed once; statistics and events are taken from what that gave.
    """
    require_utc(store.spark)
    rows = stored(cleaned(columns, iso_day_first, marks=True), "load")
    batch = keyed_events(drop_invalid(rows))
    return load_stats(rows, (store.replace if replace else store.append_new)(batch, fixed=True))


def load_exports(
    spark: SparkSession,
    path: str,
    store: EventStore,
    delimiter: str = DELIMITER,
    iso_day_first: bool = False,
    replace: bool = False,
) -> DataFrame:
    """Loads all export files of a folder, whatever their headers, and returns the row of `load_stats`."""
    return load_columns(store, read_exports(spark, path, delimiter), iso_day_first, replace)

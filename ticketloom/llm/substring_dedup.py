"""Operator 12: repeated substrings by recompression.

A window is `window` consecutive words of one document. Every word is removed that lies in a window whose
words also start earlier: in a document of smaller doc_id, or earlier in the same one. Windows are judged on
the input.

1. Every document is parsed into symbols (see recompression). Names are global, so one shuffle of the names
   tells which symbols occur twice anywhere. Two equal windows hold the same symbols at the same places,
   as far as the ranges that decide them lie in the window: a window around the deciding range of a symbol
   that occurs once is no repeat. All others stay open, also those that hold no such range.
2. Open windows are verified by 128-bit fingerprints of their words. One shuffle brings equal ones
   together in the order of doc_id and place; all behind the first are repeats.

Both shuffles carry at most one row of a name, or of a window of one document and place, per Arrow batch:
a name found twice in a batch is shared, and a window behind an equal one of its batch is a repeat, whatever
other batches hold. So a passage that a third of all documents hold does not make a hot key. What is known
travels under a random key.

Cases: null is a text without words; words are separated by blanks and the characters 9 to 13 and compared as
bytes; a null doc_id is smaller than all others; rows of one doc_id and text are one document, and rows of one
doc_id and different texts are ordered by place alone, so neither is earlier at the same place. Texts of fewer
words than a window lose nothing. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.batches import slices, text_column
from ticketloom.llm.recompression import covered, fingerprints, mixed, open_windows, remaining, symbols, words_of
from ticketloom.session import stored

WINDOW = 20

# Spark's setting for dropping the shuffle files of a query when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _units(documents: DataFrame) -> DataFrame:
    """doc_id, text, and a digest that tells texts of one doc_id apart."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    return documents.select(doc_id, text_column().alias("text"), F.xxhash64("doc_id", "text").alias("unit"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """The frame stored, and the shuffle files it took dropped at once and not when the driver's memory is cleared."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return stored(df, name)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)


def _numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def _joined(parts: list, kinds: list) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, k), *[p[i] for p in parts]]) for i, k in enumerate(kinds)]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of all list entries; a null list has none."""
    lengths = np.fromiter((0 if n is None else n for n in column.value_lengths().to_pylist()), np.int64, len(column))
    return np.repeat(np.arange(len(column)), lengths), _numbers(column.flatten()).astype(np.int64)


def _named(window: int):
    """Per batch: every name once, or, where it occurs twice in the batch, its places under random names."""

    def run(batches):
        for batch in batches:
            parts = []
            for part in slices([batch]):
                words = words_of(part.column("text"))
                found = symbols(words, window)
                unit = _numbers(part.column("unit"))[found.text]
                parts.append((found.name, unit, found.start - words.first[found.text]))
            name, unit, place = _joined(parts, [np.uint64, np.int64, np.int64])
            order = np.argsort(name, kind="stable")
            again = np.zeros(len(name), bool)
            again[1:] = name[order[1:]] == name[order[:-1]]
            in_order = again.copy()
            in_order[:-1] |= again[1:]
            # Rows stay in the order of the texts, in which they are small when compressed.
            shared = np.empty(len(name), bool)
            shared[order] = in_order
            # One row tells other batches of the name; the places are known to be shared.
            told = name[order[in_order & ~again]]
            random = mixed(unit.view(np.uint64) ^ mixed(place.astype(np.uint64), 51), 52)
            names = np.concatenate([np.where(shared, random, name), told]).view(np.int64)
            none = np.ones(len(told), bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names),
                    pa.array(np.concatenate([unit, np.zeros(len(told), np.int64)])),
                    pa.array(np.concatenate([place, -none.astype(np.int64)]).astype(np.int32)),
                    pa.array(np.concatenate([shared, none])),
                ],
                names=["name", "unit", "place", "shared"],
            )

    return run


def shared_symbols(units: DataFrame, window: int) -> DataFrame:
    """unit and the places of its symbols that occur twice or more in all documents."""
    rows = units.select("unit", "text").mapInArrow(_named(window), "name LONG, unit LONG, place INT, shared BOOLEAN")
    in_name = Window.partitionBy("name")
    counted = rows.withColumn("found", F.sum(F.expr("IF(shared, 2, 1)")).over(in_name))
    kept = counted.where("found >= 2 AND place >= 0")
    return kept.groupBy("unit").agg(F.collect_list("place").alias("places"))


def _windows(window: int):
    """Per batch: fingerprints of open windows, and repeats of earlier windows in the batch under random ones."""

    def run(batches):
        for batch in batches:
            parts = []
            for part in slices([batch]):
                words = words_of(part.column("text"))
                found = symbols(words, window)
                rows, places = _lists(part.column("places"))
                is_shared = np.zeros(len(words.starts), bool)
                is_shared[words.first[rows] + places] = True
                at = open_windows(words, found, ~is_shared[found.start], window)
                high, low = fingerprints(words, at, window)
                text = np.searchsorted(words.first, at, "right") - 1
                ids = part.column("doc_id")
                known = _numbers(ids.is_valid())[text]
                doc_id = _numbers(ids.fill_null(0))[text]
                unit = _numbers(part.column("unit"))[text]
                parts.append((high, low, known, doc_id, at - words.first[text], unit))
            kinds = [np.int64, np.int64, bool, np.int64, np.int64, np.int64]
            high, low, known, doc_id, start, unit = _joined(parts, kinds)
            order = np.lexsort((unit, start, doc_id, known, low, high))

            def same(*keys):
                equal = np.zeros(len(order), bool)
                equal[1:] = np.all([k[order[1:]] == k[order[:-1]] for k in keys], axis=0)
                return equal

            # Rows of one document and place say the same; the place of the first of a window is no repeat.
            kept, repeat = np.empty(len(order), bool), np.empty(len(order), bool)
            kept[order] = ~same(high, low, known, doc_id, start, unit)
            heads = np.flatnonzero(~same(high, low))
            first = order[heads][np.cumsum(~same(high, low)) - 1]
            repeat[order] = np.any([k[order] != k[first] for k in (known, doc_id, start)], axis=0)
            random = mixed(unit.view(np.uint64) ^ mixed(start.astype(np.uint64), 53), 54).view(np.int64)
            high = np.where(repeat, random, high)
            # A repeat has its place below zero, so that the rows are narrow.
            start = np.where(repeat, ~start, start)
            ids = pa.array(doc_id[kept], mask=~known[kept])
            columns = [high[kept], low[kept], ids, start[kept].astype(np.int32), unit[kept]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["high", "low", "doc_id", "start", "unit"]
            )

    return run


def repeated_windows(units: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """doc_id, unit and the first words of its windows that also start earlier."""
    schema = "high LONG, low LONG, doc_id LONG, start INT, unit LONG"
    rows = units.join(places, "unit", "left").select("doc_id", "unit", "text", "places")
    rows = rows.mapInArrow(_windows(window), schema)
    in_window = Window.partitionBy("high", "low").orderBy("doc_id", "start")
    # Equal places share the first rank, so that only windows behind the first have a later one.
    found = rows.withColumn("rank", F.rank().over(in_window)).where("start < 0 OR rank > 1")
    found = found.withColumn("start", F.expr("IF(start < 0, ~start, start)"))
    return found.groupBy("doc_id", "unit").agg(F.collect_list("start").alias("starts"))


def _kept(window: int):
    def run(batches):
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            rows, starts = _lists(batch.column("starts"))
            begins = words.first[rows] + starts
            removed = covered(len(words.starts), begins, begins + window)
            taken = np.bincount(words.text_of_word()[removed], minlength=batch.num_rows)
            kept = remaining(words, removed).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words.counts), pa.array(taken), kept],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, and kept: the words left, one space apart."""
    if window < 1:
        raise ValueError("a window has at least one word")
    units = _units(documents)
    places = _written(shared_symbols(units, window), "shared-symbols")
    repeats = _written(repeated_windows(units, places, window), "repeated-windows")
    left, right = units.alias("l"), repeats.alias("r")
    same = F.col("l.unit").eqNullSafe(F.col("r.unit")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    rows = left.join(right, same, "left").select("l.doc_id", "l.text", "r.starts")
    return rows.mapInArrow(_kept(window), "doc_id LONG, n_words LONG, n_removed LONG, kept STRING")

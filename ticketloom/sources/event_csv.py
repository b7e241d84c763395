"""Delimited event exports: reading, header matching, cleaning and validation."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.functions.text import blank_to_null, stripped
from ticketloom.functions.times import with_timestamp
from ticketloom.schema import CSAT_TYPE, REQUIRED_COLUMNS, TARGET_COLUMNS, TEXT_COLUMNS
from ticketloom.session import BROADCAST_ROWS, stored
from ticketloom.sources.event_store import keyed_events

# Header names accepted for each column besides its own, in order of preference.
COLUMN_ALIASES = {
    "case_id": ["caseid", "incident_id", "incident_number", "ticket_id", "ticket_number", "id"],
    "variant": ["process_variant", "flow_variant", "path", "trace_variant"],
    "priority": ["severity", "incident_priority", "urgency_level"],
    "reporter": ["reported_by", "caller", "requester", "opened_by", "submitted_by"],
    "ts": [
        "timestamp",
        "time",
        "event_time",
        "event_timestamp",
        "datetime",
        "date_time",
        "created_at",
        "reported_at",
        "occurred_at",
    ],
    "event": ["event_name", "activity", "action", "status", "stage", "step"],
    "issue_type": ["issue_category", "category", "incident_type", "type"],
    "resolver": ["assignee", "assigned_to", "resolved_by", "handler", "owner", "resolver_group"],
    "report_channel": ["channel", "source_channel", "intake_channel", "contact_channel", "reported_via"],
    "short_description": ["description", "summary", "title", "short_desc", "brief_description"],
    "customer_satisfaction": ["csat", "satisfaction", "customer_rating", "sat_score", "rating"],
}

# Fixed value: the separator of an export.
DELIMITER = ";"

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def csv_options(delimiter: str = DELIMITER, multiline: bool = False) -> dict[str, str]:
    """Quotes are doubled inside quoted cells. With multiline files are read whole by one task each; without
    it in splits, and a record with a line break in a cell would be cut (`read_exports` finds the files that
    have such records, and reads them in splits too)."""
    return {
        "sep": delimiter,
        "header": "true",
        "quote": '"',
        "escape": '"',
        "multiLine": str(multiline).lower(),
    }


def read_event_csv(
    spark: SparkSession, path: str, delimiter: str = DELIMITER, multiline: bool = False
) -> DataFrame:
    """All columns of files with one header as strings; an empty cell is NULL."""
    return spark.read.options(**csv_options(delimiter, multiline)).csv(path)


def file_lines(lines: DataFrame) -> DataFrame:
    """The lines of a text source with the file and the split that each comes from."""
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def file_layouts(lines: DataFrame) -> DataFrame:
    """One row per file: its header line, and whether a quoted cell may reach over a line's end.

    One pass over the text (see `file_lines`). A line with an odd number of quotes may begin or end such a cell.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    numbered = lines.withColumn("line", F.monotonically_increasing_id())
    return numbered.groupBy("file").agg(
        F.min_by("value", F.struct("block", "line")).alias("header"), F.max(quotes % 2 == 1).alias("multiline")
    )


def read_layouts(spark: SparkSession, layouts: DataFrame, delimiter: str = DELIMITER) -> DataFrame:
    """The eleven log columns, as text, of files whose headers may differ in names and order.

    Files with one header are read together, in splits; where a cell may hold a line break, `record_lines` puts
    the records together. The driver holds the names of the files.
    """
    groups = layouts.groupBy("header", "multiline").agg(F.collect_list("file").alias("files")).collect()
    empty = spark.createDataFrame([], T.StructType([T.StructField(t, T.StringType()) for t in TARGET_COLUMNS]))
    found = empty
    for group in sorted(groups, key=lambda g: (g["header"], g["multiline"])):
        files = sorted(group["files"])
        if group["multiline"]:
            lines = file_lines(spark.read.option("lineSep", "\n").text(files))
            raw = _cells(record_lines(lines, delimiter), header_cells(group["header"].rstrip("\r"), delimiter), delimiter)
        else:
            raw = spark.read.options(**csv_options(delimiter), enforceSchema="false").csv(files)
        found = found.unionByName(target_columns(raw))
    return found


def _cells(records: DataFrame, header: list[str], delimiter: str) -> DataFrame:
    """The cells of each record as columns under the names of the header, all but the header's own record."""
    numbered = ", ".join(f"c{i} STRING" for i in range(len(header)))
    options = {k: v for k, v in csv_options(delimiter).items() if k not in ("header", "multiLine")}
    parsed = records.where("number > 1").select(F.from_csv("record", numbered, options).alias("cells"))
    return parsed.select("cells.*").toDF(*header)


def _ends_inside(delimiter: str, inside: bool) -> str:
    """A pattern of the lines after which a quoted cell is still open, when one is, or is not, before them.

    A cell is quoted when a quote is its first character; a quote inside is doubled. What follows the closing
    quote up to the delimiter belongs to the cell, and quotes inside a plain cell mean nothing.
    """
    d = re.escape(delimiter)
    content, rest = r'[^"]*+(?:""[^"]*+)*+', f"[^{d}]*+"
    cell = f'(?:"{content}"{rest}|[^"{d}]{rest}|)'
    opened = f'(?:{cell}{d})*+"{content}$'
    return f'(?s)^(?:{content}$|{content}"{rest}{d}{opened})' if inside else f"(?s)^{opened}"


# What is told of each split, and the records, or pieces of them, that a split holds.
SPLIT_ENDS = "file string, block bigint, from_0 int, from_1 int, begun_0 bigint, begun_1 bigint"
SPLIT_RECORDS = "file string, block bigint, number bigint, whole boolean, record string"


def record_lines(lines: DataFrame, delimiter: str = DELIMITER) -> DataFrame:
    """Records of delimited files, whose cells may hold line breaks: file, number from 1, record.

    `lines` comes from a text source as it is (see `file_lines`), so each task has the lines of its splits in order.
    A line maps the state before it, inside a quoted cell or not, to the state behind it. A first pass gives, per
    split, the state behind it and the records begun in it for either state before it; the splits of a file, a row
    each, are put together by `_states`. A second pass knows the state before each split and puts its records
    together where they are read. Only the pieces of records that reach over a split's end are shuffled.
    """
    from_outside, from_inside = (
        F.col("value").rlike(_ends_inside(delimiter, inside)).cast("int") for inside in (False, True)
    )
    told = lines.withColumns({"from_0": from_outside, "from_1": from_inside})
    split = ["file", "block"]
    split_ends, split_records = _split_passes()

    ends = _states(told.select(*split, "from_0", "from_1").mapInArrow(split_ends, SPLIT_ENDS), ["file"], "block")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun_here = F.when(F.col("before_0") == 0, F.col("begun_0")).otherwise(F.col("begun_1"))
    records_before = F.coalesce(F.sum(begun_here).over(before), F.lit(0)).alias("records_before")
    ends = stored(ends.select(*split, F.col("before_0").alias("state"), records_before), "splits")

    splits = ends.count()
    columns = [*split, "value", "from_0", "from_1", "state", "records_before"]
    if splits <= BROADCAST_ROWS:
        placed = told.join(F.broadcast(ends), split).select(*columns)
    else:
        numbered = told.withColumn("line", F.monotonically_increasing_id())
        placed = numbered.join(ends, split).sortWithinPartitions(*split, "line").select(*columns)
    # One evaluation: whole records and pieces come from it.
    found = stored(placed.mapInArrow(split_records, SPLIT_RECORDS), "records")
    in_order = F.array_sort(F.collect_list(F.struct("block", "record")))
    longer = found.where("NOT whole").groupBy("file", "number").agg(in_order.alias("pieces"))
    longer = longer.select("file", "number", F.array_join("pieces.record", "\n").alias("record"))
    both = found.where("whole").select("file", "number", "record").unionByName(longer)
    return both.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")


def _split_passes():
    """The two passes over the lines of splits, which stand in order, for mapInArrow.

    Both functions hold all they use, so that workers need not import this package.
    """

    def runs(batches):
        """The rows of a batch that are of one split, and whether that split begins with them."""
        import numpy as np
        import pyarrow.compute as pc

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column("file"), batch.column("block")
            other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
            cuts = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                rows = batch.slice(start, end - start)
                split = (rows.column("file")[0].as_py(), rows.column("block")[0].as_py())
                yield split, split != last, rows
                last = split

    def states(rows, state):
        """The state before each row, and behind the last, if it is `state` before the first."""
        import numpy as np

        from_0, from_1 = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("from_0", "from_1"))
        turns = np.concatenate(([0], np.cumsum(from_0 > from_1)))
        # The last row before that maps both states to one.
        forgets = np.where(from_0 == from_1, np.arange(len(from_0)), -1)
        known = np.concatenate(([-1], np.maximum.accumulate(forgets)))
        since = np.where(known < 0, state + turns, from_0[known] + turns - turns[known + 1]) % 2
        return since[:-1], int(since[-1])

    def split_ends(batches):
        import pyarrow as pa

        names = ["file", "block", "from_0", "from_1", "begun_0", "begun_1"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

        def row(split, ends, begun):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*split, *ends, *begun], types)], names)

        of = None
        for split, first, rows in runs(batches):
            if first:
                if of:
                    yield row(of, ends, begun)
                of, ends, begun = split, [0, 1], [0, 0]
            for s in (0, 1):
                before, ends[s] = states(rows, ends[s])
                begun[s] += int((before == 0).sum())
        if of:
            yield row(of, ends, begun)

    def split_records(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["file", "block", "number", "whole", "record"]

        def out(split, numbers, whole, records):
            n = len(records)
            same = [pa.repeat(pa.scalar(v, t), n) for v, t in zip(split, (pa.string(), pa.int64()))]
            numbers = pa.array(numbers, pa.int64())
            return pa.RecordBatch.from_arrays([*same, numbers, pa.repeat(pa.scalar(whole), n), records], names)

        def joined(values, bounds):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
            return pc.binary_join(lists, "\n").cast(pa.string())

        def put_together(lines):
            return pa.array(["\n".join(lines)], pa.string())

        # The lines of the record that is open, the number of the last record begun, and whether that began in the split.
        of, opened, number, here = None, [], 0, True
        for split, first, rows in runs(batches):
            if first:
                if opened:
                    yield out(of, [number], False, put_together(opened))
                of, opened, here = split, [], False
                state, number = rows.column("state")[0].as_py(), rows.column("records_before")[0].as_py()
            values = rows.column("value")
            before, state = states(rows, state)
            begins = np.flatnonzero(before == 0)
            until = int(begins[0]) if len(begins) else len(values)
            opened += values.slice(0, until).to_pylist()
            if not len(begins):
                if not state:
                    yield out(of, [number], here, put_together(opened))
                    opened = []
                continue
            if opened:
                yield out(of, [number], here, put_together(opened))
            opened, here = [], True
            bounds = np.append(begins, len(values))
            if state:
                opened = values.slice(int(bounds[-2])).to_pylist()
                bounds = bounds[:-1]
            if len(bounds) > 1:
                numbers = number + 1 + np.arange(len(bounds) - 1)
                yield out(of, numbers, True, joined(values, bounds))
            number += len(begins)
        if opened:
            yield out(of, [number], False, put_together(opened))

    return split_ends, split_records


def _states(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """before_0 and before_1: the state before each row, if it is 0 or 1 before the first row of the keys.

    A row that maps both states to one forgets what was before; one that maps each to the other turns it.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(*keys).orderBy(order)
    forgets = F.col("from_0") == F.col("from_1")
    rows = rows.withColumn("_turns", F.sum(F.when(F.col("from_0") > F.col("from_1"), 1).otherwise(0)).over(until))
    known = F.last(F.when(forgets, F.struct(F.col("from_0").alias("s"), "_turns")), ignorenulls=True).over(before)
    turns = F.coalesce(F.max("_turns").over(before), F.lit(0))
    rows = rows.withColumns({"_known": known, "_turned": turns})
    since = F.col("_turned") - F.col("_known._turns")

    def from_state(s: int) -> Column:
        return F.coalesce(F.col("_known.s") + since, F.lit(s) + F.col("_turned")) % 2

    rows = rows.withColumns({f"before_{s}": from_state(s) for s in (0, 1)})
    return rows.drop("_turns", "_known", "_turned")


def read_exports(spark: SparkSession, path: str, delimiter: str = DELIMITER) -> DataFrame:
    """The eleven log columns, as text, of all files of a folder; without any file, no rows."""
    return read_layouts(spark, file_layouts(file_lines(spark.read.text(path))), delimiter)


def header_cells(line: str, delimiter: str = DELIMITER) -> list[str]:
    """The names in a header line."""
    return next(csv.reader([line], delimiter=delimiter, quotechar='"'), [])


def normalize_header(name: str) -> str:
    """Lower-case words joined by single underscores."""
    return "_".join(re.findall("[a-z0-9]+", name.lower()))


def normalized_columns(df: DataFrame) -> DataFrame:
    """The frame under normalized names; of two columns with one name the last stays."""
    last = {normalize_header(c): i for i, c in enumerate(df.columns)}
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"c{i}").alias(name) for name, i in last.items()])


def resolve_columns(headers: Sequence[str]) -> dict[str, str | None]:
    """Source header per target column, None for a missing optional one."""
    by_name = {normalize_header(h): h for h in headers}
    found = {}
    for target in TARGET_COLUMNS:
        names = [target, *COLUMN_ALIASES[target]]
        found[target] = next((by_name[n] for n in names if n in by_name), None)
    missing = [c for c in REQUIRED_COLUMNS if found[c] is None]
    if missing:
        raise ValueError(f"required columns without a matching header: {', '.join(missing)}")
    return found


def target_columns(raw: DataFrame) -> DataFrame:
    """The eleven log columns, still as text, whatever the headers of the export are called."""
    mapping = resolve_columns(raw.columns)
    position = {h: i for i, h in enumerate(raw.columns)}
    numbered = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])

    def source(target: str) -> Column:
        header = mapping[target]
        cell = F.lit(None) if header is None else F.col(f"c{position[header]}")
        return cell.cast("string").alias(target)

    return numbered.select(*[source(t) for t in TARGET_COLUMNS])


def parse_csat(c: Column) -> Column:
    """A score with two decimals, halves away from zero; NULL for text or more than 999.99."""
    text = stripped(c)
    number = F.when(text.rlike(NUMBER), text).try_cast("double")
    return number.try_cast(CSAT_TYPE)


def cleaned(columns: DataFrame, iso_day_first: bool = False, marks: bool = False) -> DataFrame:
    """Stripped text with blanks as NULL, timestamps in UTC, decimal scores.

    With marks a column score_dropped tells where a written score is no number or out of range.

    Every column is made in a projection, which is compiled. The columns then come out of inline, so that a filter
    on them is not pushed below and each cell is cleaned and parsed once instead of once per use.
    """
    score = F.col("customer_satisfaction")
    dropped = (blank_to_null(score).isNotNull() & parse_csat(score).isNull()).alias("score_dropped")
    made = {
        **{c: blank_to_null(F.col(c)) for c in TEXT_COLUMNS},
        "ts": stripped(F.col("ts")),
        "customer_satisfaction": parse_csat(score),
    }
    rows = columns.select(*[made[c].alias(c) for c in TARGET_COLUMNS], *([dropped] if marks else []))
    rows = with_timestamp(rows, "ts", iso_day_first)
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def drop_invalid(clean: DataFrame) -> DataFrame:
    """Rows that have every required column."""
    return clean.na.drop(subset=REQUIRED_COLUMNS)


def events_from_columns(columns: DataFrame, iso_day_first: bool = False) -> DataFrame:
    """Valid, keyed events of the log columns as text, copies included."""
    return keyed_events(drop_invalid(cleaned(columns, iso_day_first)))


def events_from_raw(raw: DataFrame, iso_day_first: bool = False) -> DataFrame:
    """Valid, keyed events of an export, copies included."""
    return events_from_columns(target_columns(raw), iso_day_first)

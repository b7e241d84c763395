"""Records with line breaks in cells, read in splits, against the reader that takes files whole."""

import random

import pytest
from pyspark.sql import functions as F

from ticketloom.session import stored
from ticketloom.sources import event_csv
from ticketloom.sources.event_csv import (
    csv_options,
    file_layouts,
    file_lines,
    header_cells,
    read_exports,
    read_layouts,
    record_lines,
)

NAMES = [
    "incident_number", "process_variant", "severity", "reported_by", "timestamp", "event_name", "category",
    "assigned_to", "channel", "summary", "csat",
]


@pytest.fixture
def small_splits(spark):
    """Splits of a few lines each, one per task."""
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "300"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


CELLS = [
    "plain", "", "two\nlines", "three\n\nlines\n", 'a "quoted" word', '5" disk', "semi;colon", '"', '""', "a\n;\"\n;b",
    "x" * 700, ("long\n" * 120), '";\n"', "tail ",
]


def written(rng, rows, end="\n"):
    def cell(text):
        quoted = any(c in text for c in ';"\n\r') or text.startswith('"')
        if text == '5" disk' and rng.random() < 0.5:
            return text  # a quote inside a plain cell means nothing
        return '"' + text.replace('"', '""') + '"' if quoted else text

    lines = [";".join(NAMES)]
    for i in range(rows):
        cells = [f"C{i}", *rng.choices(CELLS, k=9), str(i)]
        lines.append(";".join(map(cell, cells)))
    return end.join(lines) + (end if rng.random() < 0.5 else "")


def whole(spark, path):
    rows = spark.read.options(**csv_options(multiline=True)).csv(str(path)).toDF(*NAMES)
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_records_over_splits_equal_the_whole_file(spark, small_splits, tmp_path, seed, end):
    rng = random.Random(seed)
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_bytes(written(rng, 40, end).encode())
    lines = file_lines(spark.read.text(str(tmp_path)))
    assert lines.select("file", "block").distinct().count() > 20
    layouts = file_layouts(lines)
    assert all(r.multiline for r in layouts.collect())
    found = read_layouts(spark, layouts).toDF(*NAMES)
    assert sorted(map(tuple, found.collect()), key=str) == whole(spark, tmp_path)


def test_records_are_numbered_without_gaps(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text(written(random.Random(4), 60))
    found = record_lines(file_lines(spark.read.option("lineSep", "\n").text(str(tmp_path))))
    assert sorted(r.number for r in found.collect()) == list(range(1, 62))


def test_no_task_takes_a_whole_file(spark, small_splits, tmp_path):
    """Lines are gathered by split, and by record; rows of a whole file are one per split."""
    (tmp_path / "a.csv").write_text(written(random.Random(5), 80))
    lines = file_lines(spark.read.option("lineSep", "\n").text(str(tmp_path)))
    plan = record_lines(lines)._jdf.queryExecution().executedPlan().toString()
    by_file = [line for line in plan.splitlines() if "Exchange hashpartitioning(file" in line]
    alone = [line for line in by_file if "block" not in line.split("hashpartitioning(")[1].split("),")[0] and "number" not in line]
    assert by_file and all("last" not in line for line in alone)
    most = lines.groupBy("file", "block").count().agg(F.max("count")).first()[0]
    # Splits of 300 bytes, the shortest lines of which have five.
    assert most <= 60


def test_lines_stay_where_they_are_read(spark, small_splits, tmp_path, monkeypatch):
    """No text is shuffled but the pieces of records that reach over a split's end, two per split at most."""
    made = []
    monkeypatch.setattr(event_csv, "stored", lambda df, name: made.append((df, stored(df, name))) or made[-1][1])
    (tmp_path / "a.csv").write_text(written(random.Random(7), 80))
    lines = file_lines(spark.read.option("lineSep", "\n").text(str(tmp_path)))
    assert record_lines(lines).count() == 81
    with_text = [(df, kept) for df, kept in made if {"value", "record"} & set(df.columns)]
    assert with_text
    for df, _ in with_text:
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    pieces = with_text[0][1].where("NOT whole").groupBy("file", "block").count()
    assert 0 < pieces.agg(F.max("count")).first()[0] <= 2


def test_more_splits_than_are_broadcast(spark, small_splits, tmp_path, monkeypatch):
    """Then lines meet what is known of their split in a shuffle, and are put in order again."""
    monkeypatch.setattr(event_csv, "BROADCAST_ROWS", 0)
    rng = random.Random(8)
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(written(rng, 40))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = read_layouts(spark, file_layouts(file_lines(spark.read.text(str(tmp_path))))).toDF(*NAMES)
        assert sorted(map(tuple, found.collect()), key=str) == whole(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_split_may_come_in_many_batches(spark, tmp_path):
    """A record that is open at a batch's end goes on in the next one; several small files share a task."""
    rng = random.Random(9)
    for name in ("a.csv", "b.csv", "c.csv"):
        (tmp_path / name).write_text(written(rng, 30))
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "3", "spark.sql.files.minPartitionNum": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = read_layouts(spark, file_layouts(file_lines(spark.read.text(str(tmp_path))))).toDF(*NAMES)
        assert sorted(map(tuple, found.collect()), key=str) == whole(spark, tmp_path)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_layouts_mix(spark, tmp_path):
    rng = random.Random(6)
    (tmp_path / "a.csv").write_text(written(rng, 5))
    (tmp_path / "b.csv").write_text(";".join(NAMES) + "\n" + ";".join(["D", *"abcdefghi", "1"]) + "\n")
    turned = ";".join(reversed(NAMES)) + "\n" + ";".join(["1", *"ihgfedcb", '"a\nb"', "E"]) + "\n"
    (tmp_path / "c.csv").write_text(turned)
    found = {r.case_id: r for r in read_exports(spark, str(tmp_path)).collect()}
    assert len(found) == 7
    assert (found["D"].variant, found["D"].customer_satisfaction) == ("a", "1")
    assert (found["E"].variant, found["E"].short_description) == ("a\nb", "i")
    assert header_cells('a;"b;c";d') == ["a", "b;c", "d"]

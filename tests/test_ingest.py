"""Reading, cleaning and storing exports."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from event_rows import row
from ticketloom import EventLogModel, ReferenceData
from ticketloom.functions.text import WHITE_SPACE, stripped
from ticketloom.functions.times import parse_timestamp, with_timestamp
from ticketloom.operators import cases, checks
from ticketloom.operators.events import event_normalized
from ticketloom.reference import EVENT_ALIASES
from ticketloom.schema import LOG_SCHEMA, TARGET_COLUMNS
from ticketloom.session import scratch_dir, settings_for
from ticketloom.sources.event_csv import (
    cleaned,
    drop_invalid,
    events_from_raw,
    normalize_header,
    normalized_columns,
    parse_csat,
    read_event_csv,
    resolve_columns,
    target_columns,
)
from ticketloom.sources.event_store import (
    EventStore,
    dedupe_events,
    keyed_events,
    load_stats,
    top_events,
    unique_in_case,
    unseen_events,
)
from ticketloom.sources.export import export_csv
from ticketloom.sources.load import load_exports
from ticketloom.streaming.incremental import ingest_new_files

HEADER = (
    "incident_number;process_variant;severity;reported_by;timestamp;event_name;category;"
    "assigned_to;channel;summary;csat"
)


def line(ts, event, csat=""):
    return f"INC100;Standard;High;Ava;{ts};{event};Access;L1;Portal;Password reset;{csat}"


FIXTURE = [
    line("2024-01-01 08:00:00", "Ticket created"),
    line("2024-01-01 08:00:00", "Ticket created"),
    line("2024-01-01 08:15:00", "Ticket solved by level 1 support"),
    line("2024-01-01 08:20:00", "Ticket closed"),
    line("2024-01-01 08:25:00", "Customer feedback received", "4.50"),
]


@pytest.fixture
def fixture_csv(tmp_path):
    path = tmp_path / "export.csv"
    path.write_text("\n".join([HEADER, *FIXTURE]) + "\n")
    return str(path)


def test_headers_are_matched_by_alias():
    assert resolve_columns(HEADER.split(";")) == dict(zip(TARGET_COLUMNS, HEADER.split(";")))


def test_own_name_goes_before_aliases_and_the_last_of_equal_names_wins():
    headers = [*TARGET_COLUMNS, "incident_id", "Case ID", "Event"]
    found = resolve_columns(headers)
    assert (found["case_id"], found["event"]) == ("Case ID", "Event")


def test_missing_required_headers_are_named_and_optional_ones_are_not():
    with pytest.raises(ValueError, match="priority, issue_type"):
        resolve_columns([c for c in TARGET_COLUMNS if c not in ("priority", "issue_type")])
    found = resolve_columns([c for c in TARGET_COLUMNS if c not in ("resolver", "customer_satisfaction")])
    assert found["resolver"] is None and found["customer_satisfaction"] is None


@pytest.mark.parametrize(
    "name, normal",
    [(" Incident Number ", "incident_number"), ("__A--b", "a_b"), ("(CSAT)", "csat"), ("é x", "x"), ("", "")],
)
def test_header_names(name, normal):
    assert normalize_header(name) == normal


def test_normalized_columns_keep_the_last_of_equal_names(spark):
    df = spark.createDataFrame([("a", "b")], ["Case ID", "case-id"])
    assert normalized_columns(df).collect()[0].asDict() == {"case_id": "b"}


def test_missing_optional_columns_are_null(spark):
    raw = spark.createDataFrame([("C", "V")], ["case_id", "variant"])
    rest = [c for c in TARGET_COLUMNS if c not in ("case_id", "variant", "resolver")]
    raw = raw.withColumns({c: F.lit("x") for c in rest})
    assert target_columns(raw).columns == TARGET_COLUMNS
    assert target_columns(raw).first()["resolver"] is None


def text_row(**values):
    base = dict(
        case_id="INC-1", variant="Happy path", priority="High", reporter="Ava", ts="2024-01-01 09:00:00",
        event="Ticket created", issue_type="Access", resolver="L1", report_channel="Portal",
        short_description="Password reset", customer_satisfaction="",
    )
    return tuple({**base, **values}[c] for c in TARGET_COLUMNS)


def text_frame(spark, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in TARGET_COLUMNS))


def test_blank_score_is_valid_and_blank_case_is_not(spark):
    raw = text_frame(spark, text_row(), text_row(case_id=" \t", customer_satisfaction="4.0"))
    (event,) = events_from_raw(raw).collect()
    assert event.case_id == "INC-1" and event.customer_satisfaction is None and event.event_key


def test_any_white_space_is_stripped(spark):
    df = spark.createDataFrame([(WHITE_SPACE + "a b" + WHITE_SPACE,)], "c string")
    assert df.select(stripped(F.col("c"))).first()[0] == "a b"
    assert all(ch.isspace() for ch in WHITE_SPACE)


TIMES = [
    ("31/12/2024", datetime(2024, 12, 31)),
    ("01/02/2024 08:30", datetime(2024, 2, 1, 8, 30)),
    ("1-2-2024 8:05:09", datetime(2024, 2, 1, 8, 5, 9)),
    ("01.02.2024 08:30:15.123456", datetime(2024, 2, 1, 8, 30, 15, 123456)),
    ("01/02/2024 10:30 PM", datetime(2024, 2, 1, 22, 30)),
    ("12/31/2024 10:15", datetime(2024, 12, 31, 10, 15)),
    ("2024-01-02 08:00:00", datetime(2024, 1, 2, 8)),
    ("2024-01-02T08:00:00.5+02:00", datetime(2024, 1, 2, 6, 0, 0, 500000)),
    ("05/03/24 10:00", datetime(2024, 3, 5, 10)),
    ("5 Mar 2024 10:00", datetime(2024, 3, 5, 10)),
    ("05-Mar-2024", datetime(2024, 3, 5)),
    ("March 5, 2024 10:00 AM", datetime(2024, 3, 5, 10)),
    ("05/03/2024 10:00:00+0100", datetime(2024, 3, 5, 9)),
    ("2024/03/05 10:00", datetime(2024, 3, 5, 10)),
    ("20240305", datetime(2024, 3, 5)),
    ("20240305T101500Z", datetime(2024, 3, 5, 10, 15)),
    ("Tue, 5 Mar 2024 10:00:09 -0330", datetime(2024, 3, 5, 13, 30, 9)),
    ("Tuesday 5th September 2023", datetime(2023, 9, 5)),
    ("Sept. 5th, 2023 at 10:00", None),
    ("sep 5 99 12:05 a.m.", datetime(1999, 9, 5, 0, 5)),
    ("2024-Mar-05 12:05 PM", datetime(2024, 3, 5, 12, 5)),
    ("31.12.68", datetime(2068, 12, 31)),
    ("31.12.69", datetime(1969, 12, 31)),
    ("5 3 2024 7", datetime(2024, 3, 5, 7)),
    ("29/02/2024 23:59:59.9999999", datetime(2024, 2, 29, 23, 59, 59, 999999)),
    ("01/02/2024 08:30 UTC", datetime(2024, 2, 1, 8, 30)),
    ("2024-01-02 08:00:00 Europe/Berlin", datetime(2024, 1, 2, 7)),
    ("01/02/2024 13:30 PM", None),
    ("01/02/2024 24:00", None),
    ("01/02/2024 10:60", None),
    ("29/02/2023", None),
    ("1/2-2024", None),
    ("5 Mai 2024", None),
    ("2024-13-05", None),
    ("|||||||||||||", None),
    ("0", None),
    ("2024", None),
    ("13/13/2024", None),
    ("2024-02-30", None),
    ("10:30", None),
    ("n/a", None),
    ("", None),
]


def test_times(spark):
    df = spark.createDataFrame([(t,) for t, _ in TIMES], "t string")
    plain = parse_timestamp(F.col("t")).cast("timestamp_ntz")
    swapped = parse_timestamp(F.col("t"), iso_day_first=True).cast("timestamp_ntz")
    found = df.select("t", plain.alias("v"), swapped.alias("w")).collect()
    assert {r.t: r.v for r in found} == dict(TIMES)
    staged = with_timestamp(df.withColumn("ts", F.col("t")), "ts").select("t", F.col("ts").cast("timestamp_ntz"))
    assert {r.t: r.ts for r in staged.collect()} == dict(TIMES)
    swapped = {r.t: r.w for r in found}
    assert swapped["2024-01-02 08:00:00"] == datetime(2024, 2, 1, 8)
    assert swapped["2024/03/05 10:00"] == datetime(2024, 5, 3, 10)
    assert swapped["20240305"] == datetime(2024, 3, 5)


@pytest.mark.parametrize(
    "text, score",
    [("4.5", "4.50"), (" 4 ", "4.00"), ("4.005", "4.01"), ("-1", "-1.00"), ("1e3", None), ("4,5", None),
     ("nan", None), ("inf", None), ("4d", None), ("", None), ("good", None)],
)
def test_scores(spark, text, score):
    found = spark.createDataFrame([(text,)], "c string").select(parse_csat(F.col("c"))).first()[0]
    assert (None if found is None else str(found)) == score


def test_event_key_is_the_hash_of_the_joined_parts(spark):
    log = spark.createDataFrame(
        [
            row("C", "2024-01-01 08:00:00.000250", "Ticket created", customer_satisfaction="4.5"),
            row("C", "2024-01-01 08:00", "Ticket created", resolver=None, variant=""),
        ],
        LOG_SCHEMA,
    )
    texts = [
        "C|Standard|High|Ava|2024-01-01T08:00:00.000250Z|Ticket created|Access|L1|Portal|Password reset|4.50",
        "C||High|Ava|2024-01-01T08:00:00.000000Z|Ticket created|Access||Portal|Password reset|",
    ]
    assert [r.event_key for r in keyed_events(log).collect()] == [
        hashlib.md5(t.encode()).hexdigest() for t in texts
    ]


def test_a_repeated_load_inserts_nothing(spark, fixture_csv):
    raw = read_event_csv(spark, fixture_csv)
    clean = cleaned(target_columns(raw), marks=True)
    valid = keyed_events(drop_invalid(clean))
    store = EventStore(spark, scratch_dir(spark, "store"))
    for inserted, duplicates in ((4, 1), (0, 5)):
        stats = load_stats(clean, unseen_events(valid, store.read())).first()
        assert (stats.rows_input, stats.rows_valid, stats.rows_dropped) == (5, 5, 0)
        assert (stats.rows_inserted, stats.rows_duplicate) == (inserted, duplicates)
        assert (stats.distinct_cases, stats.distinct_events) == (1, 4)
        store.append_new(valid)
        assert store.read().count() == 4
    assert top_events(valid).first().asDict() == {"event": "Ticket created", "events": 2}

    case = cases.case_sla(EventLogModel.over(store.read()).closed).first()
    assert (case.cycle_hours, case.met_sla, case.has_feedback) == (pytest.approx(1 / 3), True, True)


def test_validation_counts_every_valid_row(spark, fixture_csv):
    clean = cleaned(target_columns(read_event_csv(spark, fixture_csv)), marks=True)
    stats = load_stats(clean).first()
    assert (stats.rows_inserted, stats.rows_duplicate) == (5, 0)


def test_replacing_drops_what_was_stored(spark):
    store = EventStore(spark, scratch_dir(spark, "store"))
    old, new = (
        keyed_events(spark.createDataFrame([row("C", ts, "Ticket created")], LOG_SCHEMA))
        for ts in ("2023-05-01 08:00", "2024-01-01 08:00")
    )
    store.append_new(old)
    store.replace(new)
    assert [r.event_key for r in store.read().collect()] == [r.event_key for r in new.collect()]


def test_the_stream_loads_each_file_once(spark, tmp_path):
    folder = tmp_path / "incoming"
    folder.mkdir()
    store = EventStore(spark, scratch_dir(spark, "store"))
    state = scratch_dir(spark, "stream")

    def ingest(name, lines):
        if lines:
            (folder / name).write_text("\n".join([HEADER, *lines]) + "\n")
        ingest_new_files(spark, str(folder), store, state)
        return store.read().count()

    assert ingest("a.csv", FIXTURE[:3]) == 2
    assert ingest("a.csv", None) == 2
    assert ingest("b.csv", FIXTURE) == 4


SWAPPED = "Summary;csat;reported_by;severity;incident_number;path;time;activity;type;owner;intake_channel"


def swapped(case, reporter, priority, summary, ts="2024-02-01 08:00:00", csat="3.00"):
    return f"{summary};{csat};{reporter};{priority};{case};Standard;{ts};Ticket created;Access;L1;Portal"


@pytest.fixture
def layouts(tmp_path):
    """Files with two headers in different order, one of them with a line break inside a cell."""
    folder = tmp_path / "layouts"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([HEADER, *FIXTURE]) + "\n")
    (folder / "b.csv").write_text("\n".join([SWAPPED, swapped("INC2", "Ben", "Low", "Printer")]) + "\n")
    broken = swapped("INC3", "Cem", "Medium", '"Two lines:\nsecond ""line"""', csat="4.25")
    (folder / "c.csv").write_text("\n".join([SWAPPED, broken, swapped("INC4", "Dee", "High", "x")]) + "\n")
    return str(folder)


def check_layouts(store):
    rows = {r.case_id: r for r in store.read().where("case_id <> 'INC100'").collect()}
    assert {c: (r.priority, r.reporter) for c, r in rows.items()} == {
        "INC2": ("Low", "Ben"), "INC3": ("Medium", "Cem"), "INC4": ("High", "Dee"),
    }
    assert (rows["INC3"].short_description, float(rows["INC3"].customer_satisfaction)) == (
        'Two lines:\nsecond "line"', 4.25,
    )
    assert store.read().count() == 7


def test_each_file_is_read_by_its_own_header(spark, layouts):
    store = EventStore(spark, scratch_dir(spark, "store"))
    for inserted in (7, 0):
        stats = load_exports(spark, layouts, store).first()
        assert (stats.rows_input, stats.rows_inserted, stats.rows_duplicate) == (8, inserted, 8 - inserted)
    check_layouts(store)


def test_the_stream_reads_each_file_by_its_own_header(spark, layouts):
    store = EventStore(spark, scratch_dir(spark, "store"))
    state = scratch_dir(spark, "stream")
    reports = [ingest_new_files(spark, layouts, store, state, files_per_batch=2) for _ in range(2)]
    assert [r.stats().first().rows_inserted for r in reports] == [7, 0]
    check_layouts(store)


def test_an_empty_folder_loads_nothing(spark, tmp_path):
    store = EventStore(spark, scratch_dir(spark, "store"))
    folder = tmp_path / "empty"
    folder.mkdir()
    stats = load_exports(spark, str(folder), store).first()
    assert (stats.rows_input, stats.rows_inserted) == (0, 0)
    report = ingest_new_files(spark, str(folder), store, scratch_dir(spark, "stream"))
    assert (report.stats().first().rows_input, report.stats().first().rows_inserted) == (0, 0)
    assert report.mappings().count() == report.top_events().count() == 0


def test_dropped_scores_are_counted(spark, tmp_path):
    scores = ["", " ", "4.5", "good", "5000", "999.99", "-1e3"]
    lines = [line(f"2024-01-01 08:00:0{i}", "Ticket created", s) for i, s in enumerate(scores)]
    (tmp_path / "scores.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    stats = load_exports(spark, str(tmp_path), EventStore(spark, scratch_dir(spark, "store"))).first()
    assert (stats.rows_valid, stats.nulled_scores) == (7, 3)


@pytest.mark.parametrize("turned", [False, True])
def test_of_copies_the_smallest_stays(spark, turned):
    """NULL and an empty text give one key; the input's order must not choose between them."""
    rows = [row("C", "2024-01-01 08:00", "Ticket created", resolver=r) for r in ("", None)]
    log = spark.createDataFrame(rows[::-1] if turned else rows, LOG_SCHEMA).coalesce(1)
    keyed = keyed_events(log)
    for found in (dedupe_events(keyed), unique_in_case(keyed.repartition("case_id"))):
        assert [r.resolver for r in found.collect()] == [None]


def test_only_touched_months_are_read(spark):
    store = EventStore(spark, scratch_dir(spark, "store"))
    times = ("1970-01-01 00:00", "2024-01-01 08:00", "2024-03-01 08:00")
    batch = keyed_events(spark.createDataFrame([row("C", t, "Ticket created") for t in times], LOG_SCHEMA))
    assert store.append_new(batch) == 3
    two = batch.where("ts <> TIMESTAMP '2024-01-01 08:00'")
    assert store.append_new(two) == 0
    base = store.log.latest()
    with store._bucketed(base) as table:
        assert store._stored_keys(table, base, ["1970-01-01", "2024-03-01"]).count() == 2


def test_every_alias_maps_to_its_code(spark):
    reference = ReferenceData.defaults(spark)
    assert len(EVENT_ALIASES) == 22
    log = [row("C", f"2024-01-01 08:{i:02}", label) for i, (label, _) in enumerate(EVENT_ALIASES)]
    normalized = event_normalized(keyed_events(spark.createDataFrame(log, LOG_SCHEMA)), reference.event_alias)
    assert {r.raw_event_name: r.event_code for r in normalized.collect()} == dict(EVENT_ALIASES)


def test_verification_fails_on_an_unmapped_label(spark, log_of):
    reference = ReferenceData.defaults(spark)

    def verified(*labels):
        log = log_of(*[row("C", f"2024-01-01 08:{i:02}", label) for i, label in enumerate(labels)])
        return checks.verification(event_normalized(log, reference.event_alias), log, reference)

    checks.require_verified(verified("Ticket created", "Ticket closed"))
    with pytest.raises(ValueError, match="unmapped_events: 1"):
        checks.require_verified(verified("Ticket created", "Completely new raw event"))


def test_quoted_cells(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a;b\n"x;y";"say ""hi"""\n')
    assert tuple(read_event_csv(spark, str(path)).first()) == ("x;y", 'say "hi"')


def test_export_reads_back(spark):
    df = spark.createDataFrame([("a,b", 'say "hi"', 1.5, None), ("", "x", 2.0, True)], "a string, b string, c double, d boolean")
    path = scratch_dir(spark, "export")
    export_csv(df, path)
    back = spark.read.options(header=True, escape='"').schema(df.schema).csv(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.na.replace("", None, ["a"]).collect()))


def test_dimension_checks(spark):
    ref = ReferenceData.defaults(spark)
    counts = checks.reference_counts(
        {"alias": ref.event_alias, "catalog": ref.event_catalog, "sla": ref.sla_policy}
    )
    assert {r.table_name: r.row_count for r in counts.collect()} == {"alias": 22, "catalog": 16, "sla": 3}
    assert checks.alias_integrity(ref.event_alias, ref.event_catalog).isEmpty()
    assert checks.policy_integrity(ref.sla_policy).isEmpty()

    policy = spark.createDataFrame([("High", 8), ("High", 9), ("Low", 0), ("Medium", 16)], "priority string, target_hours int")
    assert {r.priority for r in checks.policy_integrity(policy).collect()} == {"High", "Low"}
    alias = spark.createDataFrame([("x", "nowhere"), ("y", "ticket_closed")], "raw_event_name string, event_code string")
    assert [r.raw_event_name for r in checks.alias_integrity(alias, ref.event_catalog).collect()] == ["x"]


def test_own_dimensions(spark, log_of):
    log = log_of(row("C", "2024-01-01 08:00", "opened"), row("C", "2024-01-01 09:00", "done"))
    alias = spark.createDataFrame(
        [("opened", "ticket_created"), ("done", "ticket_closed")], "raw_event_name string, event_code string"
    )
    policy = spark.createDataFrame([("High", 0.5)], "priority string, target_hours double")
    ref = ReferenceData.defaults(spark).replaced(event_alias=alias, sla_policy=policy)
    assert EventLogModel.over(log, ref).closed.first()["met_sla"] is False


def test_log_constraints(spark):
    log = keyed_events(
        spark.createDataFrame(
            [row("C", "2024-01-01 08:00", "a")] * 3 + [row("C", "2024-01-01 08:00", None)], LOG_SCHEMA
        )
    )
    found = checks.log_constraints(log).first()
    assert (found.events, found.repeated_keys, found.surplus_rows, found.missing_event) == (4, 1, 2, 1)
    assert found.largest_case == 4


def test_settings_grow_with_the_data():
    assert settings_for(10**14, 4000)["spark.sql.shuffle.partitions"] == str(-(-(10**14) // (192 * 2**20)))
    assert settings_for(1000, 8)["spark.sql.shuffle.partitions"] == "8"

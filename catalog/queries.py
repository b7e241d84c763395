"""One callable per query: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs
from catalog.inputs import SCOPE, WIDE_SCOPE, portable
from ticketloom import EventLogModel
from ticketloom.functions.times import parse_timestamp
from ticketloom.operators import cases, checks, events, outcomes, scope, summaries
from ticketloom.plans.refresh import CaseStore
from ticketloom.session import scratch_dir, stored
from ticketloom.sources import event_csv, event_store, export, load
from ticketloom.streaming.incremental import ingest_new_files
from ticketloom.workstreams import command, enablement, flow, handoffs, intake, pages, quality

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Low enough that the test tables have cases above it, which then run in slices.
FEW_ROWS = 9


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = lambda spark, sf_dir: portable(function(spark, sf_dir))
    return function


def _over_model(name: str, build: Callable[[EventLogModel], DataFrame], **kwargs) -> None:
    QUERIES[name] = lambda spark, sf_dir: portable(build(inputs.model(spark, sf_dir, **kwargs)))


# Sources, ingest and sinks


@_query
def read_event_csv(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    export.export_csv(inputs.plain_export(spark, sf_dir), path)
    return event_csv.read_event_csv(spark, path, delimiter=",")


@_query
def normalize_header(spark, sf_dir):
    return event_csv.normalized_columns(inputs.export_rows(spark, sf_dir))


@_query
def resolve_columns(spark, sf_dir):
    return event_csv.target_columns(inputs.export_rows(spark, sf_dir))


def _clean(spark, sf_dir):
    return event_csv.cleaned(event_csv.target_columns(inputs.export_rows(spark, sf_dir)))


@_query
def clean_text(spark, sf_dir):
    return _clean(spark, sf_dir).drop("ts", "customer_satisfaction")


@_query
def parse_ts(spark, sf_dir):
    return _clean(spark, sf_dir).select("case_id", "event", "reporter", "resolver", "ts")


@_query
def parse_ts_notations(spark, sf_dir):
    """The time of every event, written in one of many notations, read back."""
    rows = inputs.written_times(spark, sf_dir)
    return rows.select("case_id", "event", "reporter", "resolver", parse_timestamp(F.col("written")).alias("ts"))


@_query
def parse_csat(spark, sf_dir):
    return _clean(spark, sf_dir).select("case_id", "event", "customer_satisfaction")


@_query
def drop_invalid(spark, sf_dir):
    return event_csv.drop_invalid(_clean(spark, sf_dir))


@_query
def event_key(spark, sf_dir):
    return inputs.keyed(spark, sf_dir)


@_query
def dedupe_events(spark, sf_dir):
    return event_store.dedupe_events(inputs.keyed(spark, sf_dir))


def _two_loads(spark, sf_dir):
    """A store that holds the events up to a day, and the whole log, derived once, as the next batch."""
    keyed = stored(inputs.keyed(spark, sf_dir), "log")
    store = event_store.EventStore(spark, scratch_dir(spark, "events"))
    store.replace(keyed.filter(F.col("ts") < F.lit(inputs.FIRST_LOAD_ENDS).cast("timestamp")), fixed=True)
    return store, keyed


@_query
def append_new_events(spark, sf_dir):
    """The whole store after the second load, and after a third that repeats it."""
    store, batch = _two_loads(spark, sf_dir)
    store.append_new(batch, fixed=True)
    store.append_new(batch, fixed=True)
    return store.read()


@_query
def replace_load(spark, sf_dir):
    store, batch = _two_loads(spark, sf_dir)
    store.replace(batch.filter(F.col("ts") >= F.lit(inputs.FIRST_LOAD_ENDS).cast("timestamp")), fixed=True)
    return store.read()


@_query
def load_stats(spark, sf_dir):
    """Statistics of a load of the untidy export into a store that holds part of it."""
    store = event_store.EventStore(spark, scratch_dir(spark, "events"))
    columns = stored(event_csv.target_columns(inputs.export_rows(spark, sf_dir)), "export")
    earlier = event_csv.events_from_columns(columns)
    store.replace(earlier.filter(F.col("ts") < F.lit(inputs.FIRST_LOAD_ENDS).cast("timestamp")))
    return load.load_columns(store, columns)


@_query
def validate_only(spark, sf_dir):
    columns = event_csv.target_columns(inputs.export_rows(spark, sf_dir))
    return event_store.load_stats(event_csv.cleaned(columns, marks=True))


@_query
def top_events(spark, sf_dir):
    return event_store.top_events(event_csv.drop_invalid(_clean(spark, sf_dir)))


@_query
def incremental_ingest(spark, sf_dir):
    """Two runs of the stream over a growing folder whose files have two layouts, then the store."""
    folder, state = scratch_dir(spark, "incoming"), scratch_dir(spark, "stream")
    store = event_store.EventStore(spark, scratch_dir(spark, "events"))
    rows = stored(inputs.plain_export(spark, sf_dir), "export")
    early = F.col("timestamp") < inputs.FIRST_LOAD_ENDS
    renamed = rows.withColumnRenamed("severity", "Priority").withColumnRenamed("summary", "Short Description")
    for part in (rows.filter(early), renamed.select(*reversed(renamed.columns))):
        part.write.mode("append").options(header="true", sep=";", escape='"').csv(folder)
        ingest_new_files(spark, folder, store, state)
    return store.read()


@_query
def incremental_report(spark, sf_dir):
    """The report of the second run of the stream, whose files repeat all that the first run stored."""
    folder, state = scratch_dir(spark, "incoming"), scratch_dir(spark, "stream")
    store = event_store.EventStore(spark, scratch_dir(spark, "events"))
    rows = stored(inputs.plain_export(spark, sf_dir), "export")
    for part in (rows.filter(F.col("timestamp") < inputs.FIRST_LOAD_ENDS), rows):
        part.write.mode("append").options(header="true", sep=";", escape='"').csv(folder)
        report = ingest_new_files(spark, folder, store, state)
    return report.stats()


@_query
def multiline_export(spark, sf_dir):
    """Every description holds a line break and quotes; files are read in splits, records put together."""
    folder = scratch_dir(spark, "multiline")
    rows = inputs.plain_export(spark, sf_dir)
    told = F.concat_ws("\n", F.concat(F.lit('"'), "summary", F.lit('"')), "event_name")
    rows.withColumn("summary", told).write.options(header="true", sep=";", escape='"').csv(folder)
    return event_csv.read_exports(spark, folder)


@_query
def compact_store(spark, sf_dir):
    """The store after three loads, compaction, and a fourth load that repeats all."""
    store, batch = _two_loads(spark, sf_dir)
    store.append_new(batch, fixed=True)
    store.compact()
    store.append_new(batch, fixed=True)
    return store.read()


@_query
def earlier_version(spark, sf_dir):
    """The store as it was before its second load."""
    store, batch = _two_loads(spark, sf_dir)
    store.append_new(batch, fixed=True)
    return store.read(version=1)


def _refreshed(spark, sf_dir):
    """Relations kept up to date over three batches, of which the second repeats much of the first."""
    # Stored without keys, which hardly compress, and given them when it is read.
    batch = event_store.keyed_events(stored(inputs.log(spark, sf_dir), "log"))
    store = CaseStore(spark, scratch_dir(spark, "cases"))
    for start, end in (("1990-01-01", "1996-01-01"), ("1994-01-01", "1998-07-01"), ("1998-07-01", "2010-01-01")):
        store.refresh(batch.where(f"ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '{end}'"), fixed=True)
    return store.model()


@_query
def refreshed_sequence(spark, sf_dir):
    return _refreshed(spark, sf_dir).sequence


@_query
def refreshed_case_sla(spark, sf_dir):
    return cases.case_sla(_refreshed(spark, sf_dir).closed)


@_query
def reference_data(spark, sf_dir):
    """The event catalog with the number of logged events of each code."""
    m = inputs.model(spark, sf_dir)
    seen = m.normalized.groupBy("event_code").agg(F.count(F.lit(1)).alias("events"))
    joined = m.reference.event_catalog.join(seen, F.col("event_name") == F.col("event_code"), "left")
    counted = F.coalesce("events", F.lit(0)).alias("events")
    return joined.select("event_name", "description", "stakeholder_owner", counted)


@_query
def export_csv(spark, sf_dir):
    path = scratch_dir(spark, "export")
    rows = inputs.scoped(inputs.model(spark, sf_dir)).select(*scope.SCOPE_CASE_COLUMNS)
    export.export_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


_over_model("load_range", lambda m: checks.load_range(m.closed))

# Data quality

_over_model("unmapped_events", lambda m: checks.unmapped_events(m.normalized))


@_query
def reference_counts(spark, sf_dir):
    """Rows of each dimension that the log makes use of: the dimensions themselves are fixed values, and a
    query has to read a given table."""
    m = inputs.model(spark, sf_dir)
    ref = m.reference
    used = {
        "event_alias": ref.event_alias.join(m.log, F.col("raw_event_name") == F.col("event"), "left_semi"),
        "event_catalog": ref.event_catalog.join(
            m.normalized, F.col("event_name") == F.col("event_code"), "left_semi"
        ),
        "sla_policy": ref.sla_policy.join(m.log, "priority", "left_semi"),
    }
    return checks.reference_counts(used)


@_query
def alias_integrity(spark, sf_dir):
    """Aliases completed from the log: labels without a code get one made from their words."""
    m = inputs.model(spark, sf_dir)
    made = F.regexp_replace(F.lower("raw_event_name"), "[^a-z]+", "_").alias("event_code")
    extra = checks.unmapped_events(m.normalized).select("raw_event_name", made)
    return checks.alias_integrity(m.reference.event_alias.unionByName(extra), m.reference.event_catalog)


@_query
def policy_integrity(spark, sf_dir):
    """Policies read off the log: the hours of the closed cases of each priority and channel."""
    closed = inputs.model(spark, sf_dir).closed
    hours = F.floor(F.min("cycle_hours")).cast("int").alias("target_hours")
    return checks.policy_integrity(closed.groupBy("priority", "report_channel").agg(hours))


@_query
def log_constraints(spark, sf_dir):
    return checks.log_constraints(inputs.keyed(spark, sf_dir))


@_query
def verify(spark, sf_dir):
    """All checks over the log with its copies; unmapped labels and copies fail it."""
    m = inputs.model(spark, sf_dir)
    return checks.verification(m.normalized, inputs.keyed(spark, sf_dir), m.reference)


# Event-level relations

_over_model("event_normalized", lambda m: m.normalized)
_over_model("event_seq", lambda m: m.sequence)
_over_model("event_seq_large_cases", lambda m: m.sequence, in_task_rows=FEW_ROWS)
_over_model("transition_summary", lambda m: events.transition_summary(m.sequence, m.in_task))
_over_model(
    "transition_summary_distributed", lambda m: events.transition_summary(m.sequence, in_task=False)
)
_over_model("dwell_by_event", lambda m: events.dwell_by_event(m.sequence, m.in_task))
_over_model("transition_by_variant", lambda m: events.transition_by_variant(m.sequence))

# Case-level relations

_over_model("case_bounds", lambda m: cases.case_bounds(m.facts))
_over_model("first_nonblank", lambda m: cases.first_nonblank(m.facts))
_over_model("variant_mode", lambda m: cases.variant_mode(m.facts))
_over_model("case", lambda m: cases.case(m.closed))
_over_model("case_sla", lambda m: cases.case_sla(m.closed))
_over_model("case_sla_large_cases", lambda m: cases.case_sla(m.closed), in_task_rows=FEW_ROWS)
_over_model("pingpong_cases", lambda m: outcomes.pingpong_cases(m.closed))
_over_model("worst_handoff_cases", lambda m: outcomes.worst_handoff_cases(m.closed))
_over_model("closure_compliance", lambda m: outcomes.closure_compliance(m.closed))
_over_model("problem_candidate_cases", lambda m: outcomes.problem_candidate_cases(m.closed))
_over_model("problem_candidate_top_cases", lambda m: outcomes.problem_candidate_top_cases(m.closed))
_over_model("resolution_level", lambda m: outcomes.resolution_level(m.closed))
_over_model("fcr_cases", lambda m: outcomes.fcr_cases(m.closed))

# Summaries

_over_model("variant_summary", lambda m: summaries.variant_summary(m.closed, m.in_task))
_over_model("variant_summary_distributed", lambda m: summaries.variant_summary(m.closed, in_task=False))
_over_model("handoff_summary", lambda m: summaries.handoff_summary(m.closed, m.in_task))
_over_model("cx_summary", lambda m: summaries.cx_summary(m.closed, m.in_task))
_over_model("cx_summary_distributed", lambda m: summaries.cx_summary(m.closed, in_task=False))
_over_model("cx_breakdown", lambda m: summaries.cx_breakdown(m.closed))
_over_model("problem_candidates", lambda m: summaries.problem_candidates(m.closed, m.in_task))
_over_model("channel_summary", lambda m: summaries.channel_summary(m.closed, m.in_task))
_over_model("channel_issue_summary", lambda m: summaries.channel_issue_summary(m.closed, m.in_task))
_over_model("fcr_summary", lambda m: summaries.fcr_summary(m.closed))
_over_model("kb_enablement_candidates", lambda m: summaries.kb_enablement_candidates(m.closed))

# Scoping

_over_model(
    "fill_dimension",
    lambda m: scope.fill_dimensions(m.closed, *scope.FILTER_DIMENSIONS).select(
        "case_id", *scope.FILTER_DIMENSIONS
    ),
)
_over_model("scope_cases", lambda m: inputs.scoped(m).select(*scope.SCOPE_CASE_COLUMNS))
_over_model(
    "scope_detail",
    lambda m: scope.scope_detail(
        outcomes.closure_compliance(m.closed), inputs.scoped(m, WIDE_SCOPE), WIDE_SCOPE
    ),
)
_over_model("filter_domain_dates", lambda m: scope.filter_dates(m.closed))
_over_model("filter_domain_values", lambda m: scope.filter_values(m.closed))

# Operational health


def _over_scope(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    _over_model(name, lambda m: build(inputs.scoped(m)))


_over_model("scope_kpis", lambda m: command.scope_kpis(inputs.scoped(m), m.in_task))
_over_scope("variant_rollup", command.variant_rollup)
_over_scope("group_rollup_issue_type", lambda s: command.group_rollup(s, "issue_type"))
_over_scope("group_rollup_report_channel", lambda s: command.group_rollup(s, "report_channel"))
_over_scope("top_cases", command.top_cases)
_over_scope("leader_briefing", command.leader_briefing)
_over_scope("action_queue", command.action_queue)
_over_scope("action_chart", command.action_chart)

# Flow


def _over_steps(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    _over_model(name, lambda m: build(flow.scoped_steps(m, SCOPE)))


_over_steps("flow_steps", lambda steps: steps)
_over_steps("flow_transitions", flow.flow_transitions)
_over_model(
    "flow_transitions_large_cases",
    lambda m: flow.flow_transitions(flow.scoped_steps(m, SCOPE)),
    in_task_rows=FEW_ROWS,
)
_over_steps("flow_dwell", flow.flow_dwell)
_over_steps("flow_dwell_chart", flow.flow_dwell_chart)
_over_steps("flow_hotspots", flow.flow_hotspots)
_over_steps("flow_top_paths", flow.flow_top_paths)


_over_model("flow_kpis", lambda m: flow.scoped_flow_kpis(m, SCOPE))
_over_model("flow_worklist", lambda m: flow.flow_worklist(m, SCOPE))

# Handoffs

_over_scope("handoff_rollup", handoffs.handoff_rollup)
_over_scope("handoff_chart", handoffs.handoff_chart)
_over_scope("handoff_table", handoffs.handoff_table)
_over_scope("handoff_kpis", handoffs.handoff_kpis)
_over_scope("handoff_worklist_pingpong", handoffs.pingpong_worklist)
_over_model("handoff_worklist_worst", lambda m: handoffs.worst_handoff_worklist(m.closed, WIDE_SCOPE))

# Quality

_over_scope("quality_by_issue", quality.quality_by_issue)
_over_scope("quality_by_priority", quality.quality_by_priority)
_over_scope("quality_kpis", quality.quality_kpis)
_over_scope("quality_worklist", quality.quality_worklist)
_over_scope("quality_outcome_pairs", quality.quality_outcome_pairs)

# Intake

_over_scope("intake_channels", intake.intake_channels)
_over_scope("intake_channel_issue", intake.intake_channel_issue)
_over_scope("intake_issue_mix", intake.intake_issue_mix)
_over_scope("intake_kpis", intake.intake_kpis)
_over_scope("intake_slowest_channel", intake.intake_slowest_channel)

# Enablement

_over_scope("enablement_by_issue", enablement.enablement_by_issue)
_over_model("prevention_backlog", lambda m: enablement.prevention_backlog(m.closed, WIDE_SCOPE))
_over_scope("enablement_kpis", enablement.enablement_kpis)
_over_scope("low_fcr_worklist", enablement.low_fcr_worklist)
_over_model("problem_worklist", lambda m: enablement.problem_worklist(m.closed, WIDE_SCOPE))

# Pages: all rollups of a page in one pass


def _page_query(name: str) -> None:
    _over_model(f"page_{name}", lambda m: pages.roll_up(inputs.scoped(m), pages.pages()[name], m.in_task))


for _name in ("command", "handoffs", "quality", "intake", "enablement"):
    _page_query(_name)

# Labels and column lists

_over_scope("status_labels", lambda s: scope.status_labels(outcomes.closure_compliance(s)))
_over_model("projection_cases", lambda m: m.closed.select(*scope.SCOPE_CASE_COLUMNS))
_over_model("projection_events", lambda m: m.sequence.select(*scope.SCOPE_EVENT_COLUMNS))

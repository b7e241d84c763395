"""Independent SQL for the registered queries, for DuckDB over the same tables.

Each statement starts from the tables. The shared parts below are common table expressions; a
query lists the ones it needs.
"""

from __future__ import annotations

# The log, one row per order line, and its keyed rows without copies.
RAW = """
raw AS (
  SELECT
    'INC' || l_orderkey AS case_id,
    CASE WHEN l_discount >= 0.09 THEN ''
         WHEN l_tax >= 0.07 THEN 'Expedited'
         ELSE ['Standard', 'Escalated', 'Rework'][1 + l_orderkey % 3] END AS variant,
    CASE WHEN l_linenumber = 5 THEN NULL
         WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium'
         WHEN o_orderpriority = '5-LOW' THEN 'Low'
         ELSE 'Unrated' END AS priority,
    'U' || o_custkey AS reporter,
    o_orderdate + to_minutes(CAST((l_linenumber - 1) * 240 + 15 * (l_suppkey % 12) AS BIGINT)) AS ts,
    CASE WHEN l_linenumber = 1 THEN 'Ticket created'
         WHEN l_linenumber IN (2, 3) THEN [
           'Ticket assigned to level 1 support', 'WIP - level 1 support',
           'Level 1 escalates to level 2 support', 'Ticket assigned to level 2 support',
           'WIP - level 2 support', 'Level 2 escalates to level 3 support',
           'WIP - level 3 support', 'Vendor callback'][1 + (l_partkey * 7 + l_suppkey * 3) % 8]
         WHEN l_linenumber IN (4, 5) THEN [
           'Ticket solved by level 1 support', 'Ticket solved by level 1 support',
           'Ticket solved by level 2 support', 'Ticket solved by level 3 support',
           'Ticket rejected'][1 + (l_partkey * 7 + l_suppkey * 3) % 5]
         WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'Ticket reopened by customer'
         WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 'Customer feedback received'
         ELSE 'Ticket closed' END AS event,
    ['Access', 'Hardware', 'Email', 'Network', NULL][1 + l_partkey % 5] AS issue_type,
    CASE WHEN l_suppkey % 9 > 0 THEN 'R' || (l_suppkey % 9) END AS resolver,
    ['Portal', 'Phone', 'Email', ''][1 + l_orderkey % 4] AS report_channel,
    ['Password reset #12', 'VPN error 809!', 'Laptop (2nd floor)', '12345', 'Mailbox  FULL',
     'Printer-jam', 'Account locked'][1 + l_orderkey % 7] AS short_description,
    CASE WHEN l_linenumber = 7 AND l_returnflag = 'A'
         THEN CAST(l_quantity % 5 + 1 AS DECIMAL(5, 2)) END AS customer_satisfaction,
    l_orderkey AS number
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""

HASH = """md5(concat_ws('|', coalesce(case_id, ''), coalesce(variant, ''), coalesce(priority, ''),
    coalesce(reporter, ''), coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), ''), coalesce(event, ''),
    coalesce(issue_type, ''), coalesce(resolver, ''), coalesce(report_channel, ''),
    coalesce(short_description, ''),
    coalesce(CAST(CAST(customer_satisfaction AS DECIMAL(5, 2)) AS VARCHAR), '')))"""

KEYED = f"""
keyed AS (SELECT {HASH} AS event_key, * EXCLUDE (number) FROM raw)"""

LOG = """
log AS (SELECT DISTINCT * FROM keyed)"""

# Raw labels and their codes.
ALIAS = """
alias(label, code) AS (VALUES
  ('Ticket created', 'ticket_created'),
  ('Ticket closed', 'ticket_closed'),
  ('Customer feedback received', 'customer_feedback_received'),
  ('Ticket reopened by customer', 'ticket_reopened'),
  ('Ticket rejected', 'ticket_rejected'),
  ('Ticket solved by level 1 support', 'ticket_solved_l1'),
  ('Ticket solved by level 2 support', 'ticket_solved_l2'),
  ('Ticket solved by level 3 support', 'ticket_solved_l3'),
  ('Level 1 escalates to level 2 support', 'escalated_to_l2'),
  ('Ticket assigned to level 2 support', 'assigned_to_l2'),
  ('Level 2 escalates to level 3 support', 'escalated_to_l3'),
  ('Ticket assigned to level 1 support', 'assigned_to_l1'),
  ('WIP - level 1 support', 'work_in_progress_l1'),
  ('WIP - level 2 support', 'work_in_progress_l2'),
  ('WIP - level 3 support', 'work_in_progress_l3'))"""

NORM = """
norm AS (
  SELECT log.* EXCLUDE (event), event AS raw_event_name, code AS event_code,
    ifnull(code, event) AS event,
    CASE WHEN regexp_matches(code, '_l[123]$') THEN upper(right(code, 2)) END AS event_level
  FROM log LEFT JOIN alias ON label = log.event)"""

SEQ = """
seq AS (
  SELECT *, (epoch_us(next_ts) - epoch_us(ts)) / 3.6e9 AS delta_hours
  FROM (
    SELECT *, row_number() OVER w AS seq, lead(ts) OVER w AS next_ts, lead(event) OVER w AS next_event,
      lead(raw_event_name) OVER w AS next_raw_event_name, lead(event_code) OVER w AS next_event_code,
      lead(event_level) OVER w AS next_event_level
    FROM norm WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_key)))"""

FACTS = """
named AS (
  SELECT case_id, variant FROM norm WHERE variant <> '' GROUP BY case_id, variant
  QUALIFY row_number() OVER (
    PARTITION BY case_id ORDER BY count(*) DESC, max(ts) DESC, variant) = 1),
swaps AS (
  SELECT case_id, count(*) AS pingpong_transitions FROM seq
  WHERE event_level || next_event_level IN ('L2L3', 'L3L2') GROUP BY case_id),
spans AS (
  SELECT case_id, min(ts) AS first_ts, min(ts) FILTER (event_code = 'ticket_created') AS opened,
    max(ts) FILTER (event_code = 'ticket_closed') AS closed_at
  FROM norm GROUP BY case_id),
late AS (
  SELECT case_id, min(ts) FILTER (event_code = 'ticket_reopened' AND ts > closed_at) AS reopened_at,
    last(event_code ORDER BY ts, event_key)
      FILTER (event_code LIKE 'ticket\\_solved%' ESCAPE '\\' AND ts <= closed_at) AS last_solve
  FROM norm JOIN spans USING (case_id) GROUP BY case_id),
facts AS (
  SELECT case_id,
    any_value(ifnull(opened, first_ts)) AS created_at, any_value(spans.closed_at) AS closed_at,
    any_value(named.variant) AS variant,
    first(priority ORDER BY ts, event_key) FILTER (priority <> '') AS priority,
    first(issue_type ORDER BY ts, event_key) FILTER (issue_type <> '') AS issue_type,
    first(report_channel ORDER BY ts, event_key) FILTER (report_channel <> '') AS report_channel,
    count(*) AS event_count,
    count(DISTINCT nullif(resolver, '')) AS distinct_resolvers,
    count(*) FILTER (regexp_matches(event_code, '^(escalated|assigned)_to_l[23]$')) AS escalation_count,
    bool_or(event_code = 'customer_feedback_received') AS has_feedback,
    bool_or(event_code = 'ticket_reopened') AS has_reopen,
    bool_or(event_code = 'ticket_rejected') AS has_reject,
    max(customer_satisfaction) AS customer_satisfaction,
    max(short_description) AS short_description_raw,
    count(*) FILTER (event_code = 'ticket_solved_l1') > 0 AS solved_l1,
    count(*) FILTER (event_code = 'ticket_solved_l2') > 0 AS solved_l2,
    count(*) FILTER (event_code = 'ticket_solved_l3') > 0 AS solved_l3,
    count(*) FILTER (event_code IN ('escalated_to_l2', 'assigned_to_l2')) > 0 AS escalated_to_l2,
    count(*) FILTER (event_code IN ('escalated_to_l3', 'assigned_to_l3')) > 0 AS escalated_to_l3,
    any_value(reopened_at) AS reopened_at,
    ifnull(upper(right(any_value(last_solve), 2)), 'Unknown') AS resolution_level,
    ifnull(any_value(pingpong_transitions), 0) AS pingpong_transitions
  FROM norm JOIN spans USING (case_id) LEFT JOIN named USING (case_id)
    LEFT JOIN late USING (case_id) LEFT JOIN swaps USING (case_id)
  GROUP BY case_id)"""

CLOSED = """
timed AS (
  SELECT *, (epoch_us(closed_at) - epoch_us(created_at)) / 3.6e9 AS cycle_hours,
    CASE priority WHEN 'High' THEN 8 WHEN 'Medium' THEN 16 WHEN 'Low' THEN 24 END AS target_hours,
    (epoch_us(reopened_at) - epoch_us(closed_at)) / 3.6e9 AS reopen_after_close_hours,
    CASE WHEN distinct_resolvers > 1 THEN distinct_resolvers - 1 ELSE 0 END AS resolver_changes,
    nullif(array_to_string(regexp_extract_all(lower(short_description_raw), '[a-z]+'), ' '), '')
      AS short_description_norm
  FROM facts WHERE closed_at >= created_at),
closed AS (
  SELECT *, cycle_hours <= target_hours AS met_sla, has_reopen AS reopened,
    NOT has_feedback AS closed_without_feedback,
    ifnull(reopen_after_close_hours <= 3, false) AS reopened_within_3h,
    ifnull(reopen_after_close_hours <= 24, false) AS reopened_within_24h,
    resolution_level = 'L1' AND NOT has_reopen AND NOT escalated_to_l2 AND NOT escalated_to_l3 AS fcr,
    pingpong_transitions > 0 AS swapped
  FROM timed)"""

_ORDER = [RAW, KEYED, LOG, ALIAS, NORM, SEQ, FACTS, CLOSED]


def _with(last: str, select: str, *more: str) -> str:
    parts = [*_ORDER[: _ORDER.index(last) + 1], *more]
    return "WITH " + ",".join(parts) + "\n" + select


def over_closed(select: str, *more: str) -> str:
    return _with(CLOSED, select, *more)


def _scope(name: str, start: str, end: str, source: str = "closed", **selected: tuple) -> str:
    """A scoped relation; a selected dimension is filled before it is tested and shown."""
    filled = ", ".join(
        f"CASE WHEN trim({d}) <> '' THEN {d} ELSE 'Unspecified' END AS {d}" for d in selected
    )
    tests = " AND ".join(f"{d} IN {values}" for d, values in selected.items())
    return (
        f"\n{name} AS (SELECT * FROM (SELECT * REPLACE ({filled}) FROM {source}"
        f" WHERE CAST(created_at AS DATE) BETWEEN DATE '{start}' AND DATE '{end}') WHERE {tests})"
    )


SCOPE_DAYS = ("1996-03-01", "2000-09-30")
SCOPE_SELECTED = {
    "priority": ("High", "Medium", "Low"),
    "variant": ("Standard", "Rework", "Unspecified"),
    "report_channel": ("Portal", "Email", "Unspecified"),
}
WIDE_DAYS = ("1997-01-15", "2001-06-30")
WIDE_SELECTED = {"issue_type": ("Access", "Email", "Network", "Unspecified")}

SCOPED = _scope("scoped", *SCOPE_DAYS, **SCOPE_SELECTED)


def over_scope(select: str, *more: str) -> str:
    return over_closed(select, SCOPED, *more)


def d(expression: str, alias: str | None = None) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {alias or expression}"


def share(flag: str, alias: str) -> str:
    return d(f"avg(CASE WHEN {flag} THEN 1 ELSE 0 END)", alias)


CASES = "count(*) AS cases"
AVG_CYCLE = d("avg(cycle_hours)", "avg_cycle_hours")
AVG_CSAT = d("avg(CAST(customer_satisfaction AS DOUBLE))", "avg_csat")
MET_SLA = d("avg(CAST(met_sla AS INT))", "met_sla_rate")
P90 = d("quantile_cont(cycle_hours, 0.9)", "p90_cycle_hours")
REOPEN = share("has_reopen", "reopen_rate")
REJECT = share("has_reject", "reject_rate")
FEEDBACK = share("has_feedback", "feedback_rate")
NO_FEEDBACK = share("NOT has_feedback", "missing_feedback_rate")
UNANSWERED = share("closed_without_feedback", "closed_without_feedback_rate")
WITHIN_3H = share("reopened_within_3h", "reopened_within_3h_rate")
WITHIN_24H = share("reopened_within_24h", "reopened_within_24h_rate")
ESCALATIONS = d("avg(escalation_count)", "avg_escalations")
CHANGES = d("avg(resolver_changes)", "avg_resolver_changes")
CORE = ", ".join([CASES, AVG_CYCLE, AVG_CSAT, MET_SLA])
CHURN = ", ".join([ESCALATIONS, CHANGES])


def filled(column: str) -> str:
    return f"CASE WHEN trim({column}) <> '' THEN {column} ELSE 'Unspecified' END AS {column}"


CSAT = d("customer_satisfaction")
CYCLE = d("cycle_hours")
DIMS = "case_id, variant, priority, issue_type, report_channel"

CASE_COLUMNS = f"""{DIMS}, created_at, closed_at, {CYCLE}, event_count, distinct_resolvers,
  resolver_changes, escalation_count, has_feedback, has_reopen, has_reject, {CSAT}"""
SCOPE_CASE_COLUMNS = f"""{DIMS}, created_at, closed_at, {CYCLE}, event_count, escalation_count,
  resolver_changes, has_feedback, has_reopen, has_reject, {CSAT}, met_sla"""
WORST_COLUMNS = f"""{DIMS}, {CYCLE}, {CSAT}, met_sla, escalation_count, resolver_changes,
  has_reopen, has_reject, has_feedback"""
CLOSURE_COLUMNS = f"""{DIMS}, {CYCLE}, {CSAT}, met_sla, has_feedback, has_reopen, has_reject,
  closed_without_feedback, {d("reopen_after_close_hours")}, reopened_within_3h, reopened_within_24h"""
PROBLEM_COLUMNS = f"""{DIMS}, {CYCLE}, {CSAT}, met_sla, has_reopen, has_reject,
  short_description_raw, short_description_norm"""
PINGPONG_COLUMNS = f"""{DIMS}, {CYCLE}, {CSAT}, escalation_count, resolver_changes,
  pingpong_transitions, has_reopen, has_reject, met_sla"""
FCR_COLUMNS = f"{DIMS}, {CYCLE}, {CSAT}, met_sla, resolution_level, fcr"
LOG_COLUMNS = f"""event_key, case_id, variant, priority, reporter, ts, event, issue_type, resolver,
  report_channel, short_description, {CSAT}"""

WORST_ORDER = "ORDER BY resolver_changes DESC, escalation_count DESC, cycle_hours DESC, case_id"
LONGEST_ORDER = "ORDER BY cycle_hours DESC, has_reopen DESC, has_reject DESC, case_id"

ORACLES: dict[str, str] = {}

# Sources, ingest and sinks

_ISO = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
ORACLES["read_event_csv"] = _with(
    RAW,
    f"""SELECT case_id AS incident_number, nullif(variant, '') AS process_variant, priority AS severity,
  reporter AS reported_by, {_ISO} AS "timestamp", event AS event_name, issue_type AS category,
  resolver AS assigned_to, nullif(report_channel, '') AS channel, short_description AS summary,
  CAST(customer_satisfaction AS VARCHAR) AS csat FROM raw""",
)

# The untidy export: padded cells, times and scores in several notations.
UNTIDY = """
untidy AS (
  SELECT case_id, variant, priority, reporter, event, issue_type, resolver, report_channel,
    short_description, ts, number,
    CASE WHEN number % 11 = 10 THEN 'n/a'
         WHEN number % 5 = 0 THEN strftime(ts, '%d/%m/%Y %H:%M')
         WHEN number % 5 = 1 THEN strftime(ts, '%-d-%-m-%Y %-H:%M:%S')
         WHEN number % 5 = 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
         WHEN number % 5 = 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
         WHEN day(ts) > 12 THEN strftime(ts, '%m/%d/%Y %H:%M')
         ELSE strftime(ts, '%d.%m.%Y %I:%M %p') END AS written_ts,
    CASE WHEN customer_satisfaction IS NULL THEN ''
         ELSE [' ' || CAST(CAST(customer_satisfaction AS INT) AS VARCHAR),
               CAST(CAST(customer_satisfaction AS INT) AS VARCHAR) || '.50', 'good',
               CAST(CAST(customer_satisfaction AS INT) AS VARCHAR) || 'e3'][1 + number % 4]
         END AS written_csat,
    CASE WHEN number % 4 = 0 THEN customer_satisfaction
         WHEN number % 4 = 1 THEN customer_satisfaction + 0.5 END AS score
  FROM raw)"""

TIDY = """
tidy AS (
  SELECT case_id, nullif(variant, '') AS variant, priority, reporter,
    CASE WHEN number % 11 <> 10 THEN ts END AS ts, event, issue_type, resolver,
    nullif(report_channel, '') AS report_channel, short_description,
    CAST(score AS DECIMAL(5, 2)) AS customer_satisfaction
  FROM untidy)"""

VALID = """
valid AS (
  SELECT * FROM tidy WHERE variant IS NOT NULL AND priority IS NOT NULL AND ts IS NOT NULL
    AND issue_type IS NOT NULL AND report_channel IS NOT NULL)"""


def _pad(column: str, alias: str) -> str:
    return f"chr(9) || ' ' || ifnull({column}, '') || ' ' || chr(10) AS {alias}"


def _padded(names: dict[str, str]) -> str:
    return ", ".join(_pad(c, a) for c, a in names.items())


ORACLES["normalize_header"] = _with(
    RAW,
    f"""SELECT {_padded({
        "case_id": "incident_number", "variant": "process_variant", "priority": "severity",
        "reporter": "reported_by", "event": "event_name", "issue_type": "category",
        "resolver": "assigned_to", "report_channel": "channel", "short_description": "summary"})},
  written_ts AS "timestamp", written_csat AS csat FROM untidy""",
    UNTIDY,
)
_TEXT = ["case_id", "variant", "priority", "reporter", "event", "issue_type", "resolver",
         "report_channel", "short_description"]
ORACLES["resolve_columns"] = _with(
    RAW,
    f"""SELECT {_padded({c: c for c in _TEXT})}, written_ts AS ts,
  written_csat AS customer_satisfaction FROM untidy""",
    UNTIDY,
)
ORACLES["clean_text"] = _with(RAW, f"SELECT {', '.join(_TEXT)} FROM tidy", UNTIDY, TIDY)
ORACLES["parse_ts"] = _with(RAW, "SELECT case_id, event, reporter, resolver, ts FROM tidy", UNTIDY, TIDY)
ORACLES["parse_ts_notations"] = _with(
    RAW,
    """SELECT case_id, event, reporter, resolver,
  CASE WHEN number % 11 IN (2, 6) THEN date_trunc('day', ts)
       WHEN number % 11 = 4 THEN ts - INTERVAL 1 HOUR
       WHEN number % 11 = 8 THEN ts + INTERVAL 210 MINUTE
       ELSE ts END AS ts
FROM raw""",
)
ORACLES["parse_csat"] = _with(RAW, f"SELECT case_id, event, {CSAT} FROM tidy", UNTIDY, TIDY)
ORACLES["drop_invalid"] = _with(
    RAW, f"SELECT * REPLACE ({d('customer_satisfaction')}) FROM valid", UNTIDY, TIDY, VALID
)
ORACLES["event_key"] = _with(KEYED, f"SELECT {LOG_COLUMNS} FROM keyed")
ORACLES["dedupe_events"] = _with(LOG, f"SELECT {LOG_COLUMNS} FROM log")
ORACLES["append_new_events"] = ORACLES["dedupe_events"]
ORACLES["replace_load"] = ORACLES["dedupe_events"] + " WHERE ts >= TIMESTAMP '1998-07-01'"
ORACLES["incremental_ingest"] = _with(
    RAW,
    f"""SELECT DISTINCT {HASH} AS event_key, * EXCLUDE (number) REPLACE ({CSAT}) FROM complete""",
    """
complete AS (
  SELECT * FROM raw
  WHERE variant <> '' AND priority <> '' AND issue_type <> '' AND report_channel <> '')""",
)
_COMPLETE = """
complete AS (
  SELECT * FROM raw
  WHERE variant <> '' AND priority <> '' AND issue_type <> '' AND report_channel <> '')"""
ORACLES["incremental_report"] = _with(
    RAW,
    """SELECT (SELECT count(*) FROM raw) AS rows_input, count(*) AS rows_valid, 0::BIGINT AS nulled_scores,
  (SELECT count(*) FROM raw) - count(*) AS rows_dropped, count(DISTINCT case_id) AS distinct_cases,
  count(DISTINCT event) AS distinct_events, min(ts) AS min_ts, max(ts) AS max_ts,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM complete WHERE ts >= TIMESTAMP '1998-07-01')) AS rows_inserted,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM complete WHERE ts >= TIMESTAMP '1998-07-01'))
    AS rows_duplicate
FROM complete""",
    _COMPLETE,
)
ORACLES["multiline_export"] = _with(
    RAW,
    f"""SELECT case_id, nullif(variant, '') AS variant, priority, reporter, {_ISO} AS ts, event, issue_type,
  resolver, nullif(report_channel, '') AS report_channel,
  '"' || short_description || '"' || chr(10) || event AS short_description,
  CAST(customer_satisfaction AS VARCHAR) AS customer_satisfaction FROM raw""",
)
ORACLES["compact_store"] = ORACLES["dedupe_events"]
ORACLES["earlier_version"] = ORACLES["dedupe_events"] + " WHERE ts < TIMESTAMP '1998-07-01'"
_STATS = """(SELECT count(*) FROM tidy) AS rows_input, count(*) AS rows_valid,
  (SELECT count(*) FROM untidy WHERE trim(written_csat) <> '' AND score IS NULL) AS nulled_scores,
  (SELECT count(*) FROM tidy) - count(*) AS rows_dropped, count(DISTINCT case_id) AS distinct_cases,
  count(DISTINCT event) AS distinct_events, min(ts) AS min_ts, max(ts) AS max_ts"""
ORACLES["validate_only"] = _with(
    RAW, f"SELECT {_STATS}, count(*) AS rows_inserted, 0::BIGINT AS rows_duplicate FROM valid",
    UNTIDY, TIDY, VALID,
)
_INSERTED = "(SELECT count(*) FROM (SELECT DISTINCT * FROM valid WHERE ts >= TIMESTAMP '1998-07-01'))"
ORACLES["load_stats"] = _with(
    RAW,
    f"""SELECT {_STATS}, {_INSERTED} AS rows_inserted, count(*) - {_INSERTED} AS rows_duplicate
FROM valid""",
    UNTIDY, TIDY, VALID,
)
ORACLES["top_events"] = _with(
    RAW, "SELECT event, count(*) AS events FROM valid GROUP BY event ORDER BY events DESC, event LIMIT 5",
    UNTIDY, TIDY, VALID,
)

# Canonical codes with their meaning and owner.
CATALOG = """
catalog(event_name, description, stakeholder_owner) AS (VALUES
  ('ticket_created', 'Ticket is created in the ITSM platform.', 'Service Desk'),
  ('ticket_closed', 'Ticket is formally closed in the ITSM platform.', 'Service Desk'),
  ('customer_feedback_received', 'Customer feedback or satisfaction is recorded.', 'Service Desk'),
  ('ticket_reopened', 'The incident is reopened after closure or failed resolution.', 'Service Desk'),
  ('ticket_rejected', 'The proposed resolution or closure is rejected.', 'Service Desk'),
  ('ticket_solved_l1', 'The incident is resolved by level 1 support.', 'L1 Support'),
  ('ticket_solved_l2', 'The incident is resolved by level 2 support.', 'L2 Support'),
  ('ticket_solved_l3', 'The incident is resolved by level 3 support.', 'L3 Support'),
  ('escalated_to_l2', 'The incident is escalated from level 1 to level 2 support.', 'L1 Support'),
  ('assigned_to_l2', 'The incident is assigned to level 2 support.', 'Service Desk'),
  ('escalated_to_l3', 'The incident is escalated from level 2 to level 3 support.', 'L2 Support'),
  ('assigned_to_l3', 'The incident is assigned to level 3 support.', 'L2 Support'),
  ('assigned_to_l1', 'The incident is assigned to level 1 support.', 'Service Desk'),
  ('work_in_progress_l1', 'The incident is actively being worked by level 1 support.', 'L1 Support'),
  ('work_in_progress_l2', 'The incident is actively being worked by level 2 support.', 'L2 Support'),
  ('work_in_progress_l3', 'The incident is actively being worked by level 3 support.', 'L3 Support'))"""
ORACLES["reference_data"] = _with(
    NORM,
    """SELECT event_name, description, stakeholder_owner, count(event_key) AS events
FROM catalog LEFT JOIN norm ON event_code = event_name GROUP BY ALL""",
    CATALOG,
)
ORACLES["export_csv"] = over_scope(f"SELECT {SCOPE_CASE_COLUMNS} FROM scoped")
ORACLES["load_range"] = over_closed(
    "SELECT min(created_at) AS min_created, max(closed_at) AS max_closed FROM closed"
)

# Data quality

ORACLES["unmapped_events"] = _with(
    NORM,
    """SELECT raw_event_name, count(*) AS events FROM norm
WHERE raw_event_name NOT IN (SELECT label FROM alias) GROUP BY ALL""",
)
ORACLES["reference_counts"] = _with(
    NORM,
    """SELECT 'event_alias' AS table_name, count(DISTINCT raw_event_name) AS row_count
  FROM norm WHERE event_code IS NOT NULL
UNION ALL SELECT 'event_catalog', count(DISTINCT event_code) FROM norm
UNION ALL SELECT 'sla_policy', count(DISTINCT priority) FROM norm
  WHERE priority IN ('High', 'Medium', 'Low')""",
)
ORACLES["alias_integrity"] = _with(
    NORM,
    """SELECT DISTINCT raw_event_name, replace(lower(raw_event_name), ' ', '_') AS event_code
FROM norm WHERE event_code IS NULL""",
)
ORACLES["policy_integrity"] = over_closed(
    """SELECT priority, count(*) AS policies, count(*) FILTER (hours < 1) AS bad_targets
FROM (SELECT priority, min(cycle_hours) AS hours FROM closed GROUP BY priority, report_channel)
GROUP BY priority HAVING policies > 1 OR bad_targets > 0 OR priority IS NULL""",
)
ORACLES["log_constraints"] = _with(
    KEYED,
    """SELECT count(*) AS events, count(*) FILTER (case_id IS NULL) AS missing_case_id,
  count(*) FILTER (ts IS NULL) AS missing_ts, count(*) FILTER (event IS NULL) AS missing_event,
  (SELECT count(*) FROM (SELECT 1 FROM keyed GROUP BY event_key HAVING count(*) > 1)) AS repeated_keys,
  count(*) - count(DISTINCT event_key) AS surplus_rows,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM keyed GROUP BY case_id)) AS largest_case
FROM keyed""",
)

_FOUND = {
    "unmapped_events": f"SELECT coalesce(sum(events), 0) FROM ({ORACLES['unmapped_events']})",
    "unseeded_dimensions": "SELECT 0",
    "unknown_alias_codes": "SELECT 0",
    "broken_policies": "SELECT 0",
    "log_constraints": f"""SELECT missing_case_id + missing_ts + missing_event + surplus_rows
  FROM ({ORACLES['log_constraints']})""",
}
ORACLES["verify"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS "check", CAST(({sql}) AS BIGINT) AS violations, ({sql}) = 0 AS passed"""
    for name, sql in _FOUND.items()
)

# Event-level relations

ORACLES["event_normalized"] = _with(NORM, f"SELECT * REPLACE ({CSAT}) FROM norm")
ORACLES["event_seq"] = _with(
    SEQ, f"SELECT * EXCLUDE (event_key) REPLACE ({CSAT}, {d('delta_hours')}) FROM seq"
)
ORACLES["event_seq_large_cases"] = ORACLES["event_seq"]


def _waits(prefix: str) -> str:
    return ", ".join(
        [
            d("avg(delta_hours)", f"avg_{prefix}_hours"),
            d("quantile_cont(delta_hours, 0.5)", f"median_{prefix}_hours"),
            d("quantile_cont(delta_hours, 0.9)", f"p90_{prefix}_hours"),
        ]
    )


ORACLES["transition_summary"] = _with(
    SEQ,
    f"""SELECT event AS from_event, next_event AS to_event, count(*) AS transition_count, {_waits("delta")}
FROM seq WHERE delta_hours >= 0 GROUP BY event, next_event""",
)
ORACLES["transition_summary_distributed"] = ORACLES["transition_summary"]
ORACLES["dwell_by_event"] = _with(
    SEQ,
    f"""SELECT event, count(*) AS occurrences, {_waits("dwell")}
FROM seq WHERE delta_hours >= 0 GROUP BY event""",
)
ORACLES["transition_by_variant"] = _with(
    SEQ,
    f"""SELECT variant, event AS from_event, next_event AS to_event, count(*) AS transition_count,
  {d("avg(delta_hours)", "avg_delta_hours")}
FROM seq WHERE delta_hours >= 0 GROUP BY variant, event, next_event""",
)

# Case-level relations

ORACLES["case_bounds"] = _with(
    FACTS,
    f"""SELECT case_id, created_at, closed_at, event_count, distinct_resolvers, escalation_count,
  has_feedback, has_reopen, has_reject, {CSAT} FROM facts""",
)
ORACLES["first_nonblank"] = _with(FACTS, "SELECT case_id, priority, issue_type, report_channel FROM facts")
ORACLES["variant_mode"] = _with(FACTS, "SELECT case_id, variant FROM named")
ORACLES["case"] = over_closed(f"SELECT {CASE_COLUMNS} FROM closed")
ORACLES["case_sla"] = over_closed(
    f"SELECT {CASE_COLUMNS}, CAST(target_hours AS BIGINT) AS target_hours, met_sla FROM closed"
)
ORACLES["case_sla_large_cases"] = ORACLES["case_sla"]
ORACLES["pingpong_cases"] = over_closed(f"SELECT {PINGPONG_COLUMNS} FROM closed WHERE swapped")
ORACLES["closure_compliance"] = over_closed(f"SELECT {CLOSURE_COLUMNS} FROM closed")
ORACLES["problem_candidate_cases"] = over_closed(f"SELECT {PROBLEM_COLUMNS}, has_feedback FROM closed")
ORACLES["problem_candidate_top_cases"] = over_closed(
    f"SELECT {PROBLEM_COLUMNS} FROM (FROM closed {LONGEST_ORDER} LIMIT 500)"
)
ORACLES["worst_handoff_cases"] = over_closed(
    f"SELECT {WORST_COLUMNS} FROM (FROM closed {WORST_ORDER} LIMIT 200)"
)
ORACLES["resolution_level"] = over_closed(
    """SELECT case_id, solved_l1, solved_l2, solved_l3, reopened, escalated_to_l2, escalated_to_l3,
  resolution_level FROM closed"""
)
ORACLES["fcr_cases"] = over_closed(f"SELECT {FCR_COLUMNS} FROM closed")

# Summaries

ORACLES["variant_summary"] = over_closed(
    f"SELECT variant, {CORE}, {P90}, {REOPEN}, {REJECT}, {CHURN} FROM closed GROUP BY variant"
)
ORACLES["variant_summary_distributed"] = ORACLES["variant_summary"]
ORACLES["handoff_summary"] = over_closed(
    f"""SELECT variant, issue_type, {CORE}, {P90}, {CHURN},
  {share("distinct_resolvers >= 2", "handoff_rate")},
  {share("distinct_resolvers >= 4", "high_handoff_rate")}, {share("swapped", "pingpong_rate")}
FROM closed GROUP BY variant, issue_type"""
)
ORACLES["cx_summary"] = over_closed(
    f"SELECT {CORE}, {P90}, {UNANSWERED}, {WITHIN_3H}, {WITHIN_24H}, {REJECT} FROM closed"
)
ORACLES["cx_summary_distributed"] = ORACLES["cx_summary"]
ORACLES["cx_breakdown"] = over_closed(
    f"""SELECT issue_type, priority, {CORE}, {UNANSWERED}, {WITHIN_3H}, {REJECT}
FROM closed GROUP BY issue_type, priority"""
)
ORACLES["problem_candidates"] = over_closed(
    f"""SELECT issue_type, short_description_norm, {CORE}, {P90}, {REOPEN}, {REJECT},
  {d('''count(*) * ((1 - ifnull(avg(CAST(met_sla AS INT)), 0)) * avg(cycle_hours) / 10
      + avg(CAST(has_reopen AS INT)) + avg(CAST(has_reject AS INT)))''', "impact_score")},
  min(short_description_raw) AS example_description, max(closed_at) AS last_seen_ts
FROM closed WHERE short_description_norm <> '' GROUP BY issue_type, short_description_norm"""
)
_CHANNEL = f"{CORE}, {P90}, {REOPEN}, {REJECT}, {CHURN}, {FEEDBACK}, {NO_FEEDBACK}"
ORACLES["channel_summary"] = over_closed(
    f"SELECT report_channel, {_CHANNEL} FROM closed GROUP BY report_channel"
)
ORACLES["channel_issue_summary"] = over_closed(
    f"SELECT report_channel, issue_type, {_CHANNEL} FROM closed GROUP BY report_channel, issue_type"
)
ORACLES["fcr_summary"] = over_closed(
    f"""SELECT issue_type, {CORE}, {share("fcr", "fcr_rate")}, {REOPEN},
  {share("escalated_to_l2", "l2_escalation_rate")}, {share("escalated_to_l3", "l3_escalation_rate")}
FROM closed GROUP BY issue_type"""
)
ORACLES["kb_enablement_candidates"] = over_closed(
    f"""SELECT issue_type, {CASES}, {AVG_CYCLE}, {AVG_CSAT}, {REOPEN},
  {share("resolution_level = 'L1'", "l1_solved_rate")},
  {share("resolution_level IN ('L2', 'L3')", "l2_or_l3_rate")},
  {share("escalated_to_l2", "escalation_to_l2_rate")},
  {d('''(count(*) FILTER (resolution_level IN ('L2', 'L3')) + count(*) FILTER (escalated_to_l2))
      * avg(cycle_hours) / 10''', "enablement_score")}
FROM closed GROUP BY issue_type"""
)

# Scoping

ORACLES["fill_dimension"] = over_closed(
    f"""SELECT case_id, {filled("priority")}, {filled("issue_type")}, {filled("variant")},
  {filled("report_channel")} FROM closed"""
)
ORACLES["scope_cases"] = ORACLES["export_csv"]
WIDE = _scope("wide", *WIDE_DAYS, **WIDE_SELECTED)
ORACLES["scope_detail"] = over_closed(f"SELECT {CLOSURE_COLUMNS} FROM wide", WIDE)
ORACLES["filter_domain_dates"] = over_closed(
    """SELECT CAST(min(created_at) AS DATE) AS min_date, CAST(max(created_at) AS DATE) AS max_date
FROM closed"""
)
ORACLES["filter_domain_values"] = over_closed(
    "\nUNION ".join(
        f"SELECT '{c}' AS dimension, {filled(c).replace(f' AS {c}', ' AS value')} FROM closed"
        for c in ("priority", "issue_type", "variant", "report_channel")
    )
)

# Operational health

ORACLES["scope_kpis"] = over_scope(
    f"""SELECT {CASES}, {MET_SLA}, {AVG_CYCLE}, {P90}, {REOPEN}, {share("NOT has_feedback", "feedback_gap")}
FROM scoped"""
)
_SCORE = "count(*) * avg(cycle_hours) * (1 + avg(CAST(has_reopen AS INT)) + avg(CAST(has_reject AS INT)))"
_VARIANTS = f"""
by_variant AS (
  SELECT {filled("variant")}, count(*) AS n, {_SCORE} AS score, avg(cycle_hours) AS hours,
    {CORE}, {REOPEN}, {REJECT}, {CHURN}, {d(_SCORE, "opportunity_score")}
  FROM scoped GROUP BY ALL),
heaviest AS (FROM by_variant ORDER BY score DESC, n DESC, variant)"""
ORACLES["variant_rollup"] = over_scope(
    "SELECT * EXCLUDE (n, score, hours) FROM by_variant", _VARIANTS
)
_GROUP = f"{CORE}, {REOPEN}, {REJECT}, {FEEDBACK}, {CHURN}"
for _dimension in ("issue_type", "report_channel"):
    ORACLES[f"group_rollup_{_dimension}"] = over_scope(
        f"SELECT {filled(_dimension)}, {_GROUP} FROM scoped GROUP BY ALL"
    )
ORACLES["top_cases"] = over_scope(
    f"""SELECT {DIMS}, {CYCLE}, {CSAT}, met_sla, has_reopen, has_reject, resolver_changes,
  escalation_count FROM (FROM scoped ORDER BY cycle_hours DESC, case_id LIMIT 25)"""
)
ORACLES["leader_briefing"] = over_scope(
    f"""SELECT {CASES}, {AVG_CYCLE}, (SELECT variant FROM heaviest LIMIT 1) AS worst_variant,
  {d("(SELECT hours FROM heaviest LIMIT 1)", "worst_variant_hours")},
  {share("NOT has_feedback", "feedback_gap")}, {REOPEN} FROM scoped""",
    _VARIANTS,
)
ORACLES["action_queue"] = over_scope(
    """SELECT variant, cases, avg_cycle_hours, met_sla_rate, reopen_rate, reject_rate, opportunity_score
FROM heaviest LIMIT 10""",
    _VARIANTS,
)
ORACLES["action_chart"] = over_scope(
    "SELECT * EXCLUDE (n, score, hours) FROM heaviest LIMIT 8", _VARIANTS
)

# Flow

STEPS = f"""
near AS (
  SELECT case_id, variant, priority, issue_type, report_channel, ts AS created_at, seq, event,
    next_event, delta_hours
  FROM seq WHERE case_id IN (SELECT case_id FROM scoped)),{_scope("steps", *SCOPE_DAYS, source="near", **SCOPE_SELECTED)}"""
_EDGES = f"""
edges AS (
  SELECT event AS from_event, next_event AS to_event, count(*) AS transition_count,
    avg(delta_hours) AS hours
  FROM steps WHERE next_event IS NOT NULL GROUP BY event, next_event),
dwells AS (
  SELECT event, count(*) AS occurrences, avg(delta_hours) AS hours FROM steps GROUP BY event)"""
_EDGE = f"from_event, to_event, transition_count, {d('hours', 'avg_delta_hours')}"
_DWELL = f"event, occurrences, {d('hours', 'avg_dwell_hours')}"


def over_steps(select: str, *more: str) -> str:
    return over_scope(select, STEPS, _EDGES, *more)


ORACLES["flow_steps"] = over_steps(
    f"""SELECT {DIMS}, created_at AS ts, seq, event, next_event, {d("delta_hours")} FROM steps"""
)
ORACLES["flow_transitions"] = over_steps(f"SELECT {_EDGE} FROM edges")
ORACLES["flow_transitions_large_cases"] = ORACLES["flow_transitions"]
ORACLES["flow_dwell"] = over_steps(f"SELECT {_DWELL} FROM dwells")
ORACLES["flow_dwell_chart"] = over_steps(
    f"SELECT {_DWELL} FROM (FROM dwells ORDER BY hours DESC NULLS LAST, event LIMIT 10)"
)
ORACLES["flow_kpis"] = over_steps(
    f"""SELECT (SELECT count(DISTINCT variant) FROM scoped) AS variants,
  {d("count(*) / count(DISTINCT case_id)", "avg_steps")}, (SELECT count(*) FROM edges) AS transitions,
  {d("(SELECT max(hours) FROM dwells)", "slowest_dwell_hours")} FROM steps"""
)
ORACLES["flow_hotspots"] = over_steps(
    f"""SELECT {_EDGE} FROM (FROM edges
  ORDER BY hours DESC NULLS LAST, transition_count DESC, from_event, to_event LIMIT 15)"""
)
ORACLES["flow_worklist"] = over_steps(
    f"""SELECT {DIMS}, event_steps, {CYCLE}, met_sla, has_reopen
FROM scoped LEFT JOIN (SELECT case_id, count(*) AS event_steps FROM steps GROUP BY case_id)
USING (case_id)"""
)
ORACLES["flow_top_paths"] = over_steps(
    f"""SELECT position, s.id AS source_id, t.id AS target_id, {_EDGE}
FROM used JOIN nodes s ON s.name = from_event JOIN nodes t ON t.name = to_event""",
    """
used AS (
  SELECT *, row_number() OVER (ORDER BY transition_count DESC, from_event, to_event) AS position
  FROM edges QUALIFY position <= 18),
nodes AS (
  SELECT name, row_number() OVER (ORDER BY min(side), min(position) FILTER (side = 0),
    min(position)) - 1 AS id
  FROM (SELECT from_event AS name, 0 AS side, position FROM used
        UNION ALL SELECT to_event, 1, position FROM used) GROUP BY name)""",
)

# Handoffs

_HANDOFF = f"""
cohorts AS (
  SELECT {filled("issue_type")}, {CORE}, {CHURN}, {share("distinct_resolvers >= 2", "handoff_rate")},
    {share("distinct_resolvers >= 3", "high_handoff_rate")}, {share("swapped", "pingpong_rate")},
    avg(CAST(swapped AS INT)) AS exact
  FROM scoped GROUP BY ALL),
swapping AS (FROM cohorts ORDER BY exact DESC, issue_type)"""
ORACLES["handoff_rollup"] = over_scope("SELECT * EXCLUDE (exact) FROM swapping", _HANDOFF)
ORACLES["handoff_chart"] = over_scope("SELECT * EXCLUDE (exact) FROM swapping LIMIT 10", _HANDOFF)
ORACLES["handoff_table"] = over_scope(
    """SELECT issue_type, cases, avg_cycle_hours, met_sla_rate, handoff_rate, high_handoff_rate,
  pingpong_rate FROM swapping LIMIT 12""",
    _HANDOFF,
)
ORACLES["handoff_kpis"] = over_scope(
    f"""SELECT {CHURN}, {share("swapped", "pingpong_rate")},
  {d("avg(cycle_hours) FILTER (swapped)", "pingpong_avg_cycle_hours")} FROM scoped"""
)
ORACLES["handoff_worklist_pingpong"] = over_scope(
    f"""SELECT {PINGPONG_COLUMNS} FROM (
  FROM scoped WHERE swapped ORDER BY pingpong_transitions DESC, case_id LIMIT 200)"""
)
ORACLES["handoff_worklist_worst"] = over_closed(
    f"SELECT {WORST_COLUMNS} FROM (FROM picked {WORST_ORDER} LIMIT 200)",
    _scope("picked", *WIDE_DAYS, **WIDE_SELECTED),
)

# Quality

_BY_ISSUE = f"""SELECT {filled("issue_type")}, {CORE}, {UNANSWERED}, {WITHIN_24H}, {REJECT}
FROM scoped GROUP BY ALL"""
ORACLES["quality_by_issue"] = over_scope(_BY_ISSUE)
ORACLES["quality_by_priority"] = over_scope(
    f"SELECT {filled('priority')}, {CASES}, {WITHIN_24H}, {REJECT}, {AVG_CYCLE} FROM scoped GROUP BY ALL"
)
ORACLES["quality_kpis"] = over_scope(
    f"SELECT {AVG_CSAT}, {MET_SLA}, {UNANSWERED}, {WITHIN_24H}, {REJECT} FROM scoped"
)
ORACLES["quality_worklist"] = over_scope(
    f"""SELECT {CLOSURE_COLUMNS} FROM (FROM scoped
  ORDER BY reopened_within_24h DESC, closed_without_feedback DESC, cycle_hours DESC, case_id LIMIT 200)"""
)
ORACLES["quality_outcome_pairs"] = over_scope(
    f"SELECT * FROM ({_BY_ISSUE}) WHERE avg_cycle_hours IS NOT NULL AND avg_csat IS NOT NULL"
)

# Intake

ORACLES["intake_channels"] = over_scope(
    f"SELECT {filled('report_channel')}, {_GROUP}, {NO_FEEDBACK} FROM scoped GROUP BY ALL"
)
_PAIRS = f"""SELECT {filled("report_channel")}, {filled("issue_type")}, {CASES}, {AVG_CYCLE}, {MET_SLA},
  {REOPEN} FROM scoped GROUP BY ALL"""
ORACLES["intake_channel_issue"] = over_scope(_PAIRS)
ORACLES["intake_issue_mix"] = over_scope(
    f"FROM ({_PAIRS}) ORDER BY cases DESC, report_channel, issue_type LIMIT 20"
)
ORACLES["intake_kpis"] = over_scope(
    f"""SELECT count(DISTINCT report_channel) AS channels, {AVG_CYCLE}, {MET_SLA}, {NO_FEEDBACK}
FROM scoped"""
)
ORACLES["intake_slowest_channel"] = over_scope(
    f"""SELECT {filled("report_channel")}, {AVG_CYCLE} FROM scoped GROUP BY ALL
ORDER BY avg_cycle_hours DESC, report_channel LIMIT 1"""
)

# Enablement


def _solved_at(level: str) -> str:
    return share(f"resolution_level = '{level}'", f"{level.lower()}_rate")


ORACLES["enablement_by_issue"] = over_scope(
    f"""SELECT {filled("issue_type")}, {CORE}, {share("fcr", "fcr_rate")}, {_solved_at("L1")},
  {_solved_at("L2")}, {_solved_at("L3")},
  {d("count(*) FILTER (NOT fcr) * avg(cycle_hours)", "enablement_score")}
FROM scoped GROUP BY ALL"""
)
PICKED = _scope("picked", *WIDE_DAYS, **WIDE_SELECTED)
ORACLES["prevention_backlog"] = over_closed(
    f"""SELECT issue_type, short_description_norm, {CASES}, {AVG_CYCLE} FROM picked GROUP BY ALL
ORDER BY count(*) DESC, avg(cycle_hours) DESC, issue_type, short_description_norm NULLS FIRST LIMIT 15""",
    PICKED,
)
ORACLES["enablement_kpis"] = over_scope(
    f"SELECT {share('fcr', 'fcr_rate')}, {_solved_at('L1')}, {AVG_CYCLE}, {AVG_CSAT} FROM scoped"
)
ORACLES["low_fcr_worklist"] = over_scope(
    f"SELECT {FCR_COLUMNS} FROM (FROM scoped ORDER BY fcr, cycle_hours DESC, case_id LIMIT 200)"
)
ORACLES["problem_worklist"] = over_closed(
    f"SELECT {PROBLEM_COLUMNS} FROM (FROM picked ORDER BY cycle_hours DESC, case_id LIMIT 200)",
    PICKED,
)

# Labels and column lists


def _word(column: str, yes: str, no: str) -> str:
    return f"CASE {column} WHEN true THEN '{yes}' WHEN false THEN '{no}' END AS {column}"


ORACLES["status_labels"] = over_scope(
    f"""SELECT {DIMS}, {CYCLE}, {CSAT}, {d("reopen_after_close_hours")}, {_word("met_sla", "Met", "Missed")},
  {_word("has_feedback", "Feedback", "Feedback Missing")}, {_word("has_reopen", "Reopened", "Stable")},
  {_word("has_reject", "Rejected", "Accepted")},
  {_word("closed_without_feedback", "Feedback Missing", "Feedback")},
  {_word("reopened_within_3h", "Reopened", "Stable")},
  {_word("reopened_within_24h", "Reopened", "Stable")} FROM scoped"""
)
ORACLES["projection_cases"] = over_closed(f"SELECT {SCOPE_CASE_COLUMNS} FROM closed")
ORACLES["projection_events"] = _with(
    SEQ, f"SELECT {DIMS}, ts, seq, event, next_event, {d('delta_hours')} FROM seq"
)

# Pages


def _page(measures: str, **rollups: tuple) -> str:
    """Every rollup of a page, one query each."""
    dimensions = list(dict.fromkeys(d for by in rollups.values() for d in by))
    parts = []
    for name, by in rollups.items():
        shown = [filled(x) if x in by else f"CAST(NULL AS VARCHAR) AS {x}" for x in dimensions]
        parts.append(f"SELECT {', '.join([f"'{name}' AS rollup", *shown])}, {measures} FROM scoped GROUP BY ALL")
    return over_scope("\nUNION ALL ".join(parts))


_ISSUE, _CHANNEL = ("issue_type",), ("report_channel",)
ORACLES["page_command"] = _page(f"{_GROUP}, {P90}", all=(), variant=("variant",), issue=_ISSUE, channel=_CHANNEL)
ORACLES["page_handoffs"] = _page(
    f"""{CORE}, {CHURN}, {share("distinct_resolvers >= 2", "handoff_rate")},
  {share("distinct_resolvers >= 3", "high_handoff_rate")}, {share("swapped", "pingpong_rate")}""",
    all=(),
    issue=_ISSUE,
)
ORACLES["page_quality"] = _page(
    f"{CORE}, {UNANSWERED}, {WITHIN_24H}, {REJECT}", all=(), issue=_ISSUE, priority=("priority",)
)
ORACLES["page_intake"] = _page(_GROUP, all=(), channel=_CHANNEL, channel_issue=_CHANNEL + _ISSUE)
ORACLES["page_enablement"] = _page(
    f"{CORE}, {share('fcr', 'fcr_rate')}, {_solved_at('L1')}, {_solved_at('L2')}, {_solved_at('L3')}",
    all=(),
    issue=_ISSUE,
)

# Relations kept up to date

ORACLES["refreshed_sequence"] = ORACLES["event_seq"]
ORACLES["refreshed_case_sla"] = ORACLES["case_sla"]

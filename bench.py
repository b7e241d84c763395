"""Time the headline queries; prints one JSON line.

Every query starts from the raw tables: nothing is cached between runs. The `stored_` entries read
the two relations that `EventLogModel.materialize` writes once, whose own time is `materialize`.
"""

from __future__ import annotations

import importlib.util
import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from catalog import inputs  # noqa: E402
from ticketloom.operators import events, summaries  # noqa: E402
from ticketloom.session import scratch_dir, settings_for  # noqa: E402
from ticketloom.workstreams import flow, handoffs  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "dedupe_events",
    "drop_invalid",
    "event_seq",
    "transition_summary",
    "transition_summary_distributed",
    "case_sla",
    "variant_summary",
    "handoff_summary",
    "problem_candidates",
    "fcr_summary",
    "flow_transitions",
    "flow_worklist",
    "handoff_rollup",
]

STORED = {
    "stored_variant_summary": lambda m: summaries.variant_summary(m.closed, m.in_task),
    "stored_transition_summary": lambda m: events.transition_summary(m.sequence, m.in_task),
    "stored_flow_transitions": lambda m: flow.flow_transitions(flow.scoped_steps(m, inputs.SCOPE)),
    "stored_handoff_rollup": lambda m: handoffs.handoff_rollup(inputs.scoped(m)),
}


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    size = sum(f.stat().st_size for f in os.scandir(SF_DIR) if f.name.startswith(("lineitem", "orders")))
    for key, value in settings_for(size, CPUS).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(build) -> float:
    """Median of warm runs, building the query included."""

    def once() -> float:
        started = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    once()
    return round(statistics.median(once() for _ in range(RUNS)), 3)


def main() -> None:
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries = entry.queries()

    spark = session()
    timed = {name: seconds(lambda: queries[name](spark, SF_DIR)) for name in HEADLINE}

    started = time.perf_counter()
    stored = inputs.model(spark, SF_DIR).materialize(scratch_dir(spark, "bench"))
    timed["materialize"] = round(time.perf_counter() - started, 3)
    timed.update({name: seconds(lambda: build(stored)) for name, build in STORED.items()})

    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm medians",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()

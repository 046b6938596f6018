"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with a ``noop`` write (every row produced,
nothing collected to the driver), twice: ``queries`` holds the warm (second)
run, ``cold`` the first one (JIT and first-use costs). Prints one JSON line:
{"metric": "total_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpdesk_lake.plans.catalog import load_all  # noqa: E402
from helpdesk_lake.session import build_session  # noqa: E402

HEADLINE = (
    "period_summary",
    "recurrence",
    "metrics_comparison",
    "top_topics",
    "timeline",
    "response_distribution",
    "top_customers",
    "dashboard_summary",
    "customer_metrics",
    "metrics_by_customer",
    "filter_all",
    "ticket_page",
    "ticket_search",
    "export_records",
    "export_cells",
    "ingest_latest",
    "ingest_conflicts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:] or list(HEADLINE)
    spark = build_session(f"local[{cpus}]", app_name="helpdesk-lake-bench", shuffle_partitions=2 * cpus)
    registry = load_all()
    # warm the JVM and the Parquet readers on a tiny query
    registry["period_summary"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in only:
        runs = []
        for _ in range(2):
            t0 = time.perf_counter()
            df = registry[name].build(spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t0, 3))
        cold[name], timings[name] = runs
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "cold": cold, "cold_total": round(sum(cold.values()), 3),
                      "sf": sf, "cpus": cpus,
                      "spark": spark.version, "shuffle_partitions": 2 * cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

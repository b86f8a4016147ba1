"""Times the headline queries and prints one JSON line.

Each query runs once unmeasured (JVM warm-up, code generation) and then BENCH_REPEAT
times into a sink that drops the rows; the best time counts.
"""

import json
import os
import sys
import time

from tidemark.plans.registry import QUERIES
from tidemark.session import build_session

HEADLINE = (
    "employee_week_metrics",
    "first_record_per_week",
    "dense_timeline",
    "weekly_flags_long",
    "signals_as_of_week",
    "signals_with_gaps",
    "score_recurrence",
    "nearest_case",
    "evaluation_run",
    "employee_status",
    "cohort_overview",
    "blocked_documents",
    "screened_texts",
    "message_parts",
    "completions_view",
    "grade_summary",
    "weekly_files",
    "state_upsert",
    "realtime_files",
    "model_prompts",
    "evaluation_run_recomputed",
    "report_file",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        best = float("inf")
        for attempt in range(repeat + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from typeaudit.plans.queries import REGISTRY  # noqa: E402
from typeaudit.session import DEFAULTS  # noqa: E402

HEADLINE = [
    "category",
    "engine_suppressed",
    "engine_antijoin",
    "config_rules",
    "summary_total",
    "summary_rollup",
    "leaderboard",
    "file_head",
    "attribution_substring",
    "report_json",
    "report_files",
    "scan_prune",
    "line_count",
    "tokens",
    "types",
    "extracted_leaderboard",
    "extracted_summary",
    "stream_summary",
    "request_selection",
    "prompt_standard",
    "heuristics_local",
    "chat_extract",
    "retry_triage",
    "cascade_local_first",
    "advice_sections",
    "advice_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    names = [name for name in sys.argv[1:] if name in REGISTRY] or HEADLINE
    # One untimed query, so that the first timed one does not pay for the start of the JVM.
    REGISTRY["category"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

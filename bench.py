"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads), BENCH_ALL=1 for
every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftpanel.queries import QUERIES  # noqa: E402

HEADLINE = (
    "latest_score_per_posting",
    "board_union_normalised",
    "stable_and_composite_keys",
    "keyword_filter",
    "payload_bytes",
    "export_rows",
    "fresh_candidates",
    "liveness_split",
    "jobs_upsert",
    "dedupe_newest",
    "panel_draw",
    "panel_draw_capped",
    "batch_assignment",
    "batch_prompt_payload",
    "chat_response_items",
    "usage_itemised",
    "correlate_results",
    "grade_run_events",
    "rebuild_calls_from_events",
    "rolling_token_audit",
    "spacing_audit",
    "cost_asof",
    "drift_by_day",
    "model_variance",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    # The first job pays for starting the engine; keep that out of the numbers.
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total" if names is HEADLINE else "all_total",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

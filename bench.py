"""Time headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores). The study's tables are
written first and timed as `prepare_study` (ingestion and enrichment); then each query runs twice
and the second, warm run counts. Set BENCH_COLD=1 to count the first run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

HEADLINE = (
    "a21_b10_enriched_requests",
    "a13_a14_flat_ads",
    "b20_clean_text",
    "d1_prevalence_by_profile",
    "d2_tracker_frequency",
    "d4_differential_entities",
    "d5_exclusive_entities",
    "d6_jaccard_parts",
    "d7_cookie_counts",
    "d8_b27_lifespan_distribution",
    "d10_cookie_syncs",
    "d13_canvas_detector",
    "d18_technique_frequency",
    "d22_network_distribution",
    "d24_top_brands",
    "d28_c10_tracking_by_category",
    "d29_network_tracker_cooccurrence",
    "d32_b18_keyword_categories",
    "d34_c12_visit_measures",
    "d35_c7_pixel_hits",
    "d36_d38_site_pixels",
    "d40_c8_ads_with_pixel_context",
    "d44_targeting_accuracy",
    "d50_describe_requests",
    "i4_i5_presence_tests",
    "i9_pairwise_battery",
    "i10_category_pvalues",
    "j1_e8_zero_shot_labels",
    "j5_topic_keywords",
    "k2_shared_histogram",
    "m4_e2_merged_reviews",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    parallel = str(os.cpu_count() if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("crawlprism-bench")
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from crawlprism.plans.registry import load_all
    from crawlprism.plans.roles import Roles

    queries = load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)

    start = time.perf_counter()
    roles = Roles(spark, folder)
    for table in ("visits", "requests", "index", "enriched", "cookies", "cookies_enriched", "script_calls",
                  "script_visits", "scripts", "ads", "doc_ads", "hits"):
        getattr(roles, table)
    times = {"prepare_study": round(time.perf_counter() - start, 3)}

    for name in names:
        runs = []
        for _ in range(1 if os.environ.get("BENCH_COLD") else 2):
            start = time.perf_counter()
            queries[name].build(Roles(spark, folder)).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(runs[-1], 3)
        print(f"{name}: {' '.join(f'{r:.2f}' for r in runs)}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

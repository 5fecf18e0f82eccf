"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR is the table folder, BENCH_CPUS the number of local cores, BENCH_QUERIES an optional comma list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clauseloom.catalog import QUERIES  # noqa: E402
from clauseloom.session import configure  # noqa: E402
from clauseloom.sources.stages import release  # noqa: E402

HEADLINE = (
    "normalize_text",
    "text_stats",
    "load_funnel",
    "rejects",
    "contract_numbers",
    "distinct_content",
    "chunks",
    "sentences",
    "keyword_hits",
    "context_windows",
    "merged_passages",
    "clause_table",
    "clause_rows",
    "detection_rate",
    "detection_rollup",
    "detection_accuracy",
    "exemplar_similarity",
    "clause_prompts",
    "token_efficiency",
    "task_results",
    "wide_results",
    "summaries",
    "length_distribution",
    "uncached_texts",
    "postings",
    "sample_search",
    "benchmark_search",
    "nearest_batch",
    "nearest_in_cells",
    "nearest_by_bound",
    "own_type_hits",
    "chunked_prompts",
    "model_answers",
    "embedded_search",
    "job_results",
    "rate_sliding",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' machinery before the clock runs.
    QUERIES["detection_rate"](spark, sf_dir).collect()
    spark.range(8).mapInPandas(lambda frames: frames, "id long").collect()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release(spark)
    print(
        json.dumps(
            {
                "metric": "clause_analytics_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

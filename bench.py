"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from colinear.plans import registry

HEADLINE = ["seed_blocks", "kmer_counts", "six_frames", "chunks", "collapse", "summary_stats", "best_query", "depth_segments", "coverage_stats", "coverage_delta", "feature_coverage", "midpoint_depth", "grid_weights", "grid_topk", "interpolate", "gap_regions", "chain_best", "merge_overlaps", "synteny_blocks", "scaffold_anchors", "gff_export", "density_bins", "align_swga", "guided_matches", "merged_summary"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", os.environ.get("BENCH_WAREHOUSE", "/tmp/colinear-bench"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries["summary"](spark, sf).count()  # starts the executors' Python and compiles the common parts
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()

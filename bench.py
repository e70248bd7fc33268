"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR and BENCH_CPUS.  Each query runs once to warm up and once timed into a
sink that drops its rows, so every row and column is computed.
"""
import json
import os
import sys
import time

from siftline.plans import catalog
from siftline.session import build_session

HEADLINE = [
    "scan_severity_counts", "rule_scan", "keyword_scan", "dedupe_first", "dedupe_best", "function_blocks", "segment_features",
    "severity_distribution", "project_stats", "daily_trends", "language_share", "confidence_histogram", "top_vulnerable_files",
    "scan_trend", "findings_enriched", "status_update", "project_upsert", "type_accuracy", "running_accuracy", "accuracy_by_batch",
    "pattern_features", "learned_boost", "adjust_confidence", "confidence_score", "learn_patterns", "graph_nodes", "node_features",
    "graph_edges", "graph_pooling", "similar_topk", "exemplar_findings", "dbscan_clusters", "anomaly_distance", "classifier_eval",
    "balanced_split", "explanation_cache", "debounce_updates", "version_changes", "live_summary", "sliding_stats",
]


def run(build, spark, folder):
    start = time.perf_counter()
    build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def corpus_lines(spark, folder):
    from siftline.operators.scan import explode_lines
    from siftline.views import code_files

    return explode_lines(code_files(spark, folder), "file_id").count()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("siftline-bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        build = catalog.QUERIES[name]
        run(build, spark, folder)
        seconds[name] = round(run(build, spark, folder), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "warm seconds over the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if "rule_scan" in seconds:
        result["rule_scan_lines_per_second"] = round(corpus_lines(spark, folder) / seconds["rule_scan"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()

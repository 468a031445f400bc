"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from docflow import get_session
from docflow.plans.catalogue import queries

HEADLINE = (
    "dfg_counts",
    "footprint_order_flow",
    "trace_variants",
    "time_relations",
    "event_log_merged",
    "repeat_index",
    "case_variants",
    "median_time",
    "json_leaves",
    "array_profiles",
    "date_normalize",
    "rule_counts",
    "rule_counts_arrays",
    "key_classes",
    "components",
    "reference_entries",
    "relation_instances",
    "content_relations",
    "arc_usage",
    "verified_flows",
    "number_features",
    "business_pattern",
    "corr_per_supplier",
    "attribute_similarity",
    "first_cover",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(cores=cores)
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    names = sys.argv[1:] or HEADLINE
    # One small query starts the JVM's compiler and the Python gateway before anything is timed.
    registered["dfg_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all). Each query runs once to warm up the JVM's code
for its shape, on the smallest data, and is then timed once, its whole result computed and dropped.
"""

from __future__ import annotations

import json
import os
import re
import time

from phylospark.plans import catalog
from phylospark.session import local_session

HEADLINE = (
    "faith_pd", "node_counts", "unweighted", "unweighted_fp64", "weighted_normalized", "weighted_unnormalized", "unweighted_bypass", "generalized_a05", "weighted_normalized_vaw",
    "weighted_normalized_wide", "meta_skipping_missing_values", "subsample_with", "subsample_without", "multi_subsample_unweighted", "permanova_p", "gower_center", "pcoa_axes", "stripes_partial_merge",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), int(os.environ.get("BENCH_PARTITIONS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in HEADLINE:
        if os.path.isdir(small):
            queries[name](spark, small).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

`python bench.py all` times every named query. A query is timed as the driver would use it: the whole plan runs and
its rows are discarded. One cheap query warms the session up first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "hist_length_log", "hist_size", "hist_extra", "filter_https", "slice_out", "convert", "merge_flows", "sort_flows",
    "sort_index", "series_packets", "series_rolling", "anonymize", "cdf_unit", "summary_cdf", "kde_grid",
    "label_coverage", "top_sample", "features_bits", "entropy_bits", "reduction_curve", "coverage_sampling_size",
    "coverage_records_size", "occupancy", "generate_sample", "csv_roundtrip", "array_roundtrip", "occupancy_thresholds",
    "decisions_roundtrip", "anon_prefixes",
]
EM_ITERATIONS = 400


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from weirflow.operators import fitting, histogram
    from weirflow.plans import QUERIES
    from weirflow.plans.fixtures import flows
    from weirflow.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="weirflow-bench")
    names = list(QUERIES) if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE
    QUERIES["hist_length"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    rows = flows(spark, sf_dir).count()
    extra = {}
    if not sys.argv[1:]:
        h = histogram.hist(flows(spark, sf_dir), "length", 12)
        start = time.time()
        fitting.fit_many(h, {m: {"uniform": 6, "lognorm": 4} for m in ("flows", "octets")}, EM_ITERATIONS)
        times["em_fit_flows_and_octets_400"] = round(time.time() - start, 3)
        sizes = histogram.hist(flows(spark, sf_dir), "size", 12)
        start = time.time()
        fitting.fit_many(sizes, {m: {"pareto": 1, "lognorm": 4} for m in ("flows", "octets")}, EM_ITERATIONS)
        times["em_fit_sizes_400"] = round(time.time() - start, 3)
        extra["em_iterations"] = EM_ITERATIONS
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "flow analytics headline queries", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "flow_rows": rows, "cpus": cpus, **extra}))
    spark.stop()


if __name__ == "__main__":
    main()

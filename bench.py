"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. A run
builds the plan and computes every row, which a sink without output consumes.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

from fieldlens.plans.catalogue import QUERIES
from fieldlens.session import build_session

HEADLINE = (
    "case_summary",
    "fit_summary",
    "production_by_month",
    "production_by_reservoir",
    "production_by_reservoir_fanout",
    "actual_series_oil",
    "actual_series_by_dims",
    "actual_series_by_well",
    "fit_series_oil",
    "fit_series_wide_band",
    "fit_band",
    "actual_with_band",
    "cumulative",
    "top_wells",
    "top_layers",
    "crossplot_oil",
    "crossplot_injectant",
    "crossplot_selected",
    "well_paths",
    "well_centroids",
    "well_options",
    "merge_selection",
    "artefact_paths",
)


RUNS = 3


def seconds(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cores}]", cores, spark_driver_memory="8g", spark_ui_showConsoleProgress="false", spark_ui_enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    names = sys.argv[1:] or HEADLINE
    for name in names:
        run(name)
    passes = [{name: seconds(lambda name=name: run(name)) for name in names} for _ in range(RUNS)]
    times = {name: round(statistics.median(one[name] for one in passes), 3) for name in names}
    result = {
        "metric": "headline queries, warm, sum of medians of three runs",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

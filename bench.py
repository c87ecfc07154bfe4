"""Time the headline queries: prints one JSON line.

Every query starts from cleared caches and a forgotten reference distribution, so each time includes
reading the tables. Results are written to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "axis_register_center", "fingerprint_axes", "percentile_profile", "copy_risk", "copy_overlap_exact", "nearest_neighbors",
    "bank_rhythm", "bank_form", "patterns_harmony", "ground_truth", "encoding_cost", "bar_chords",
    "lever_har_chromaticism",
)


def main() -> None:
    from stavelake.plans import registry
    from stavelake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    picks = sys.argv[1:] or HEADLINE
    spark = local_session(cores, app="bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    queries, times = registry.build(), {}
    for name in picks:
        spark.catalog.clearCache()
        registry.forget()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"), "lineitem_rows": rows, "cores": cores,
    }))


if __name__ == "__main__":
    main()

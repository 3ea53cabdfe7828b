"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced to full evaluation with the ``noop`` sink (no collect)
after one warm-up run of the flagship query (JVM start, codegen), and timed
``BENCH_REPEATS`` times (default 2); the best run is reported, which damps
noise from a shared machine. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "event_features",       # A1-A11, P1-P5: the flagship statistics
    "clean_text",           # T1-T9 over whole documents
    "stratified_split",     # R1 + J3
    "label_join",           # J1 + P8
    "padded_posts",         # W1 + W2
    "drop_posts",           # R2
    "pool_mean",            # V1
    "pool_attentive",       # V4
    "post_results",         # J6 + P10
    "metrics_macro",        # E1-E4
    "loss_ce_weighted_smoothed",  # E6
    "length_stats",         # A15
    "modality_mix",         # S12 + J5 + E15
    "read_posts",           # S1: write event CSVs, parse them
    "cleaned_cache",        # S5: two runs over the cache
    "embed_posts",          # E14 over whole texts
    "train_classifier",     # E13
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tremor.plans.registry import QUERIES
    from tremor.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "2")))
    times = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(min(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

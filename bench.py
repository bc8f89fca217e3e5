"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, optional). Each query is executed in full with the ``noop`` writer
(no rows collected to the driver); the value is the sum of the per-query seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "n1_node_sketch",
    "k13_sig_bits_128",
    "g2_random_walk_visits",
    "n2_walk_sketch",
    "g3_personalized_pagerank",
    "k6_text_simhash",
    "m7_top_pairs_hamming",
    "r2_precision_at_100",
    "u1_incremental_sketch",
    "t5_stream_sketch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from graphsig.plans.catalog import QUERIES
    from graphsig.session import build_session

    spark = build_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="graphsig-bench")
    # warm-up (JIT, Python workers, file listing): the flagship on the smallest scale factor
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(small):
        QUERIES["n1_node_sketch"](spark, small).write.format("noop").mode("overwrite").save()

    timings = {}
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {timings[name]} s", file=sys.stderr)
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {
        "metric": "headline_queries_total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

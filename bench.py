"""Benchmark: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is computed in full into the noop sink or a written table; W11 is an aggregate by itself.
The W* tables are written once (not timed) as bucketed Parquet tables, like tables stored
``distributed by (a)``; each timed query is the mean of BENCH_RUNS runs (default 1).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from canopy.session import get_spark, scratch_path  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    scratch = tempfile.mkdtemp(prefix="canopy-bench-", dir="/tmp")
    spark = get_spark(master=f"local[{cpus}]", app="canopy-bench", shuffle_partitions=int(cpus) * 2, extra={
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        "spark.sql.warehouse.dir": f"{scratch}/warehouse",
        "spark.checkpoint.dir": f"{scratch}/checkpoints",
        "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    })
    spark.sparkContext.setCheckpointDir(f"{scratch}/checkpoints")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    from canopy.operators import workload as W
    from canopy.plans import all_queries
    from canopy.sources.tables import table

    buckets = int(cpus) * 2
    t1g, t2g = W.tables_from(table(spark, sf_dir, "lineitem"))
    t1g.write.bucketBy(buckets, "a").sortBy("a").mode("overwrite").saveAsTable("test1")
    t2g.write.bucketBy(buckets, "a").sortBy("a").mode("overwrite").saveAsTable("test2")
    t1, t2 = spark.table("test1"), spark.table("test2")
    q = all_queries()

    def sink(df, name=None):
        """Computes every column of every row; a count would let the optimizer drop what it does not need."""
        df.write.mode("overwrite").format("noop").save()

    cases = {
        "W1_colocated_join": lambda: sink(W.w1_colocated_join(t1, t2)),
        "W2_one_side_join": lambda: sink(W.w2_one_side_join(t1, t2)),
        "W3_two_side_join": lambda: sink(W.w3_two_side_join(t1, t2)),
        "W4_cast_join": lambda: sink(W.w4_cast_join(t1, t2)),
        "W5_text_join": lambda: sink(W.w5_text_join(t1, t2)),
        "W6_md5": lambda: sink(W.w6_md5(t2)),
        "W7_skewed_row_number": lambda: sink(W.w7_skewed_row_number(t2)),
        "W8_window_max": lambda: sink(W.w8_window_max(t2)),
        "W9_join_write": lambda: W.w9_join_write(t1, t2, scratch_path(spark, "w9")),
        "W10_redistributed_write": lambda: W.w10_redistributed_write(t1, t2, scratch_path(spark, "w10")),
        "W11_regex_count": lambda: W.w11_regex_count(table(spark, sf_dir, "documents"), "text").first(),
    }
    for name in ["H1", "H9", "C6", "GC3", "GC7", "M3", "Q2", "SK2", "SK3", "X1", "K2", "C5"]:
        if name in q:
            cases[name] = (lambda nm: lambda: sink(q[nm](spark, sf_dir), nm))(name)

    only = [s for s in os.environ.get("BENCH_ONLY", "").split(",") if s]
    times = {}
    for name, fn in cases.items():
        if only and name not in only:
            continue
        fn()  # warm-up (JIT, file listing); not timed
        t0 = time.time()
        for _ in range(runs):
            fn()
        times[name] = round((time.time() - t0) / runs, 3)
    published = [k for k in times if k.split("_")[0] in {f"W{i}" for i in range(1, 10)}]
    print(json.dumps({"metric": "total_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "rows_test1": t1.count(), "rows_test2": t2.count(), "cpus": int(cpus),
                      "w_baseline_sec": round(sum(times[k] for k in published), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()

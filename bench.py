"""Benchmark the headline queries.

Runs each query to completion through the ``noop`` sink (the whole plan executes, nothing
is collected) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints one JSON line.
A warm-up run of the flagship query is done first and not counted; each query then runs
``$BENCH_RUNS`` times (default 2, every run does the full work) and its best time counts,
which damps the run-to-run noise of a shared machine.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "quip_overlap",
    "quip_chains",
    "matched_segments",
    "max_over_golds",
    "corpus_bleu",
    "evaluate",
    "experiment_grid",
    "run_expand",
    "summary_mean_std",
    "prompt_dataset_table",
    "relative_change",
    "stratified_sample",
    "popularity_curve",
    "kilt_provenance",
    "qa_multihop_provenance",
    "bloom_contract",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from groundeval.plans.catalog import load_all
    from groundeval.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(max(8, int(cpus)))})
    reg = load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in reg]
    reg[names[0]].build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "best_of": runs}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs
twice: ``queries`` holds the second run, ``first_run`` the first, in which the
JVM still compiles and Python workers start.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "corpus_wer",
    "cmvn_stats",
    "batch_by_bucket",
    "batch_greedy",
    "align_labels",
    "loss_report",
    "frame_signal",
    "build_dictionary",
    "encode_tokens",
    "error_totals",
    "label_offsets",
    "scan_manifest",
    "apply_cmvn",
    "span_mask",
    "log_mel",
    "resample_series",
    "throughput",
    "best_hypothesis",
    "ctc_score",
    "assemble_training_set",
    "decode_and_score",
    "stream_cmvn",
]


def main() -> None:
    from phonolake.plans.queries import CATALOGUE
    from phonolake.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    runs: list[dict[str, float]] = [{}, {}]
    for seconds in runs:
        for name in names:
            begun = time.perf_counter()
            CATALOGUE[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begun, 3)
            print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    first, second = runs
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(second.values()), 3),
        "unit": "sec",
        "queries": second,
        "first_run": first,
        "first_run_value": round(sum(first.values()), 3),
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs $BENCH_RUNS times (2 by default: one to warm up, one that counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

from lexlake.catalog import REGISTRY
from lexlake.session import build_session

# One or more of each section of the operator inventory, the heavy ones included.
HEADLINE = [
    "scan_delimited", "json_field", "runs_by_file", "duplicate_content", "corpus_filter", "stream_corpus",
    "html_to_text", "markup_dictionary", "extract_elements", "decode_list", "filter_elements", "join_left_multi",
    "join_left_list", "join_contains", "agg_ordered_list", "agg_sorted_set", "combination_counts", "histogram",
    "length_summary", "element_counts", "metric_grouping_sets", "first_per_key", "trim_quotas", "stratified_take",
    "holdout_unseen", "stratified_split", "kwic", "parse_list", "recompute_metrics", "render_prompt", "parse_label",
    "token_f1", "best_candidate", "corpus_log_prob", "score_matrix", "vocabulary", "encode_pad", "mask_target",
    "batch_answer", "curated_splits", "assembled_nodes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or [n for n in HEADLINE if n in REGISTRY]
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(f"local[{cpus}]", "bench", shuffle_partitions=int(cpus), driver_memory="16g")
    REGISTRY["value_counts"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(min(taken), 3)
    result = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

"""Seconds of the headline queries: one run to warm up, then the median of three; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "label_durations", "switch_timeline", "run_lengths", "sustained_runs", "median_filter3", "best_sliding_window", "tumbling_windows", "hopping_windows", "segments_to_frames", "majority_vote",
    "confusion_matrix", "macro_f1", "equal_error_rate", "lm_tokenize", "ngram_counts", "kn_discounts", "kn_score_sequence", "script_tokens", "text_to_ipa", "dict_translate", "pack_chunks",
    "l2_normalize", "delta_features", "frame_energy", "stats_pool", "attention_pool", "dtw_pairs", "topk_per_group",
]


def main() -> None:
    os.environ.setdefault("LEXIFRAME_MASTER", f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    from lexiframe.plans import registry
    from lexiframe.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            t = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_text",
    "word_count",
    "hash_split",
    "stratified_split",
    "term_doc_freq",
    "top_vocab",
    "tfidf_l2",
    "encode_sequence",
    "linear_contributions",
    "label_distribution",
    "weighted_bce",
    "batch_mean_loss",
    "classification_report",
    "threshold_sweep",
    "best_threshold",
    "roc_auc",
    "average_precision",
    "bucket_metrics",
    "noise_invariants",
    "flip_count",
    "evaluation_report",
    "pool_mean_max",
    "lexical_scorer",
    "tier1_fit",
    "tier1_scores",
    "tier2_fit",
    "tier2_scores",
    "tier1_evaluation",
    "explain_top10",
    "stream_equals_batch",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from quietroom.catalog import QUERIES
    from quietroom.catalog.models import fitted
    from quietroom.session import local_session

    spark = local_session(cpus, "bench")
    spark.conf.set("quietroom.textPartitions", cpus)  # the tables are single files
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        if name.endswith("_fit"):
            fitted(spark, folder, name.removesuffix("_fit"))
        else:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name:24s} {timings[name]:8.3f}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")),
        "documents": docs,
    }
    if "tier1_scores" in timings:
        result["tier1_ms_per_comment"] = round(1000 * timings["tier1_scores"] / docs, 4)
    if "tier2_scores" in timings:
        result["tier2_ms_per_comment"] = round(1000 * timings["tier2_scores"] / docs, 4)
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

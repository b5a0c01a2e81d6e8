"""Decisions from probabilities and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietroom.functions.scores import (
    any_over_half,
    flag_list,
    predictions_array,
    scores_map,
    verdict,
)
from quietroom.session import join_bounded
from quietroom.settings import DEFAULT_THRESHOLD


def apply_thresholds(long: DataFrame, thresholds: DataFrame, n_labels: int) -> DataFrame:
    """Add ``pred`` to a long table from a ``(label, threshold)`` table.

    Thresholds have one row per label column, so that side stays small; a label
    without a row uses 0.5.
    """
    limit = F.coalesce(F.col("threshold"), F.lit(DEFAULT_THRESHOLD))
    return (
        join_bounded(long, thresholds.select("label", "threshold"), "label", "left", n_labels)
        .withColumn("pred", (F.col("prob") >= limit).cast("int"))
        .drop("threshold")
    )


def predict_labels(
    scored: DataFrame, labels: list[str], thresholds: dict[str, float] | None = None
) -> DataFrame:
    """Add the 0/1 array ``pred`` to a scored table; thresholds are plan constants."""
    return scored.withColumn("pred", predictions_array(labels, F.col("prob"), thresholds))


def response(
    scored: DataFrame,
    labels: list[str],
    thresholds: dict[str, float] | None,
    keep: list[str],
) -> DataFrame:
    """Scores map, flags and verdicts of each comment."""
    prob = F.col("prob")
    return scored.select(
        *keep,
        scores_map(labels, prob).alias("scores"),
        flag_list(labels, prob, thresholds).alias("flags"),
        any_over_half(prob).alias("any_over_half"),
    ).withColumn("verdict", verdict(F.col("flags")))


def flips(clean: DataFrame, noisy: DataFrame, keys: list[str]) -> DataFrame:
    """Per label: rows compared and rows whose decision changed under noise."""
    joined = clean.select(*keys, F.col("pred").alias("pred_clean")).join(
        noisy.select(*keys, F.col("pred").alias("pred_noisy")), keys
    )
    changed = F.col("pred_clean") != F.col("pred_noisy")
    return joined.groupBy("label").agg(
        F.count("*").alias("n_rows"), F.count(F.when(changed, 1)).alias("n_flips")
    )


def flips_wide(paired: DataFrame, labels: list[str]) -> DataFrame:
    """The same counts when both decisions are on one row: no join, one output row per task."""
    counts = [
        F.count(F.when(F.col("pred")[i] != F.col("pred_noisy")[i], 1)).alias(name)
        for i, name in enumerate(labels)
    ]
    total = paired.agg(F.count("*").alias("n_rows"), *counts)
    return total.unpivot(["n_rows"], labels, "label", "n_flips").select(
        "label", "n_rows", "n_flips"
    )

"""Length slices, noisy copies and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietroom.functions.noise import random_swaps
from quietroom.functions.text import length_bucket, word_count
from quietroom.operators.metrics import macro
from quietroom.session import join_bounded
from quietroom.settings import NOISE_LEVEL, SEED


def with_length(df: DataFrame, text: str = "comment_text") -> DataFrame:
    """Add word count and length bucket of the raw text."""
    return df.withColumn("n_words", word_count(F.col(text))).withColumn(
        "bucket", length_bucket(F.col("n_words"))
    )


def with_noise(
    df: DataFrame,
    key: str = "id",
    text: str = "comment_text",
    level: float = NOISE_LEVEL,
    seed: int = SEED,
) -> DataFrame:
    """Add ``noisy``; noise goes on the raw text, cleaning comes after it."""
    return df.withColumn("noisy", random_swaps(F.col(text), F.col(key), level, seed))


def variants(df: DataFrame, noisy: str = "noisy", text: str = "comment_text") -> DataFrame:
    """Each row twice, as ``clean`` and ``noisy`` variant, in one pass over the input."""
    pair = F.array(
        F.struct(F.lit("clean").alias("variant"), F.col(text).alias("_t")),
        F.struct(F.lit("noisy").alias("variant"), F.col(noisy).alias("_t")),
    )
    rest = [c for c in df.columns if c not in (noisy, text)]
    return df.select(*rest, F.inline(pair)).withColumnRenamed("_t", text)


def bucket_macro(per_label: DataFrame) -> DataFrame:
    """Macro scores of the short and long slice; an empty slice has NULLs."""
    spark = per_label.sparkSession
    buckets = spark.createDataFrame([("short",), ("long",)], "bucket string")
    scores = macro(per_label.where(F.col("bucket").isin("short", "long")), ["bucket"])
    return join_bounded(buckets, scores, "bucket", "left", 2)


def noise_drop(macro_by_variant: DataFrame) -> DataFrame:
    def of(variant: str):
        return F.max(F.when(F.col("variant") == variant, F.col("f1")))

    return macro_by_variant.agg(
        of("clean").alias("clean_f1"), of("noisy").alias("noisy_f1")
    ).withColumn("noise_drop", F.col("clean_f1") - F.col("noisy_f1"))


def compare_models(macro_by_model: DataFrame, facts: DataFrame) -> DataFrame:
    """Scores per model next to latency and size, with latency relative to the fastest.

    One row per model, so the unpartitioned window sees a handful of rows.
    """
    joined = macro_by_model.join(facts, "model")
    return joined.select(
        "model",
        F.col("f1").alias("f1_score"),
        F.col("recall").alias("recall_safety"),
        "latency_ms",
        "size_mb",
        (F.col("latency_ms") / F.min("latency_ms").over(W.partitionBy())).alias("latency_ratio"),
    )

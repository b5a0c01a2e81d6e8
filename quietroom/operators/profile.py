"""Table profile and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietroom.operators.reshape import labels_long
from quietroom.settings import POS_WEIGHT_EPSILON


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def head(df: DataFrame, key: str = "id", n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)


def label_distribution(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """Positives and their share per label, in one pass without a row blow-up.

    The sums for all labels come from one wide aggregate; only its single row is
    turned into one row per label.
    """
    sums = [F.sum(F.col(c)).cast("bigint").alias(c) for c in label_cols]
    total = df.agg(F.count("*").alias("n_rows"), *sums)
    return labels_long(total, label_cols, ["n_rows"], "positives").select(
        "label",
        "n_rows",
        "positives",
        F.try_divide(F.col("positives").cast("double"), F.col("n_rows")).alias("share"),
    )


def label_report(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """``label, found, n_rows, positives`` of every label asked for; absent ones have no positives."""
    present = [c for c in label_cols if c in df.columns]
    sums = [F.sum(F.col(c)).cast("bigint").alias(c) for c in present]
    entries = [
        F.struct(
            F.lit(c).alias("label"),
            F.lit(c in present).alias("found"),
            (F.col(c) if c in present else F.lit(None).cast("bigint")).alias("positives"),
        )
        for c in label_cols
    ]
    total = df.agg(F.count("*").alias("n_rows"), *sums)
    return total.select("n_rows", F.inline(F.array(*entries)))


def pos_weights(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """Negatives over positives per label, over the whole table."""
    pos = F.col("positives").cast("double")
    return label_distribution(df, label_cols).select(
        "label", ((F.col("n_rows") - pos) / (pos + POS_WEIGHT_EPSILON)).alias("pos_weight")
    )


def balanced_weights(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """``N / (2 * n_class)`` per label and class; absent classes have no row."""
    dist = label_distribution(df, label_cols)
    both = dist.select(
        "label",
        "n_rows",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("y"), (F.col("n_rows") - F.col("positives")).alias("n")),
                F.struct(F.lit(1).alias("y"), F.col("positives").alias("n")),
            )
        ),
    )
    return both.where("n > 0").select(
        "label", "y", (F.col("n_rows") / (F.lit(2.0) * F.col("n"))).alias("weight")
    )

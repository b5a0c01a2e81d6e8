"""Wide and long forms of labels and scores.

A *scored* table is wide: ``id, y ARRAY<INT>, prob ARRAY<DOUBLE>`` in label order.
Its long form has one row per comment and label. Both directions used here are
narrow, so reshaping never shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietroom.functions.scores import label_array

EMPTY_TEXT = "empty_text"


def labels_long(
    df: DataFrame, label_cols: list[str], keep: list[str], value: str = "y"
) -> DataFrame:
    return df.unpivot(keep, label_cols, "label", value)


def label_values(label_cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("int") for c in label_cols])


def scored_long(scored: DataFrame, labels: list[str], keep: list[str]) -> DataFrame:
    """One row per comment and label with ``label, prob`` and, if present, ``y``/``pred``."""
    fields = [label_array(labels).alias("label")]
    fields += [F.col(c) for c in ("y", "prob", "pred") if c in scored.columns]
    return scored.select(*keep, F.inline(F.arrays_zip(*fields)))


def scores_table(df: DataFrame, scores: str, keep: list[str]) -> DataFrame:
    """A scores map as rows of class and probability."""
    return df.select(*keep, F.explode(scores).alias("class", "probability"))


def stack(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Append tables by column name, each tagged with its name."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, tagged)


def validate_requests(df: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """Add ``reason``: NULL for an accepted text, otherwise why it is rejected.

    ``strict`` also rejects texts of whitespace only.
    """
    body = F.col(text)
    empty = body.isNull() | (F.length(body) == 0)
    if strict:
        empty = empty | (F.regexp_count(body, F.lit(r"(?U)[^\s\x1c-\x1f]")) == 0)
    return df.withColumn("reason", F.when(empty, EMPTY_TEXT))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNull()).drop("reason")


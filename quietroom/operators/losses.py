"""Weighted cross entropy over a table."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietroom.functions.hashing import digest
from quietroom.functions.scores import bce_with_logits
from quietroom.settings import BATCH_SIZE, SEED


def row_loss(logits: list[Column], targets: list[Column], weights: list[Column]) -> Column:
    """Mean loss of one comment over its labels."""
    terms = [bce_with_logits(x, y, w) for x, y, w in zip(logits, targets, weights)]
    return reduce(add, terms) / F.lit(float(len(terms)))


def mean_loss(df: DataFrame, loss: str = "loss") -> DataFrame:
    return df.agg(F.avg(loss).alias("mean_loss"))


def batch_mean_loss(
    df: DataFrame,
    by: list[str] | None = None,
    key: str = "id",
    loss: str = "loss",
    batch_size: int = BATCH_SIZE,
    seed: int = SEED,
) -> DataFrame:
    """Mean of the batch means per group, a short last batch counting as a full one.

    Rows of full batches all weigh the same, so only the rows of the last, short
    batch have to be told apart. There are fewer of those than ``batch_size``: a
    rank limit, applied before the shuffle, keeps the last few rows of each task
    and group, and nothing is numbered or sorted as a whole.
    """
    by = by or []
    rows = df.select(
        *by, digest(F.col(key), seed=seed).alias("_h"), F.col(key).alias("_k"), loss
    )
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(loss).alias("total"))
    latest = W.partitionBy(*by).orderBy(F.desc("_h"), F.desc("_k"))
    tail = (
        rows.withColumn("_r", F.row_number().over(latest))
        .where(F.col("_r") < batch_size)
        .groupBy(*by)
        .agg(F.collect_list(F.struct("_r", F.col(loss).alias("_l"))).alias("last"))
    )
    facts = whole.unionByName(tail, allowMissingColumns=True)
    merged = facts.groupBy(*by).agg(
        *[F.any_value(c, F.lit(True)).alias(c) for c in ("n", "total", "last")]
    )
    n, total = F.col("n"), F.col("total")
    short = n % batch_size
    # Summed in row order, so that the result does not depend on arrival.
    ordered = F.array_sort(F.filter("last", lambda e: e["_r"] <= short))
    last = F.aggregate(ordered, F.lit(0.0), lambda acc, e: acc + e["_l"])
    full = (total - last) / F.lit(float(batch_size))
    partial = F.when(short > 0, last / short).otherwise(F.lit(0.0))
    batches = F.floor(n / batch_size) + F.when(short > 0, 1).otherwise(0)
    return merged.where(n > 0).select(
        *by,
        batches.cast("bigint").alias("n_batches"),
        ((full + partial) / batches).alias("batch_mean_loss"),
        (total / n).alias("mean_loss"),
    )

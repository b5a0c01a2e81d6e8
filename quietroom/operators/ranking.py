"""Exact positions in hash order without sorting a table in one task.

A row's place in a random order is decided by its md5 digest. Digests are dealt to
ranges, as many as the session has shuffle partitions; the row counts of the ranges
give the offset of each, and only rows of one range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietroom.functions.hashing import digest
from quietroom.session import materialize
from quietroom.settings import BATCH_SIZE, SEED


def range_parts(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` stored in ranges of ``order``, with the number of the range as ``_part``.

    Stored once, so that every later pass, and every retry, sees the same ranges.
    """
    ranged = df.repartitionByRange(*order)
    return materialize(ranged.withColumn("_part", F.spark_partition_id()), name)


def hash_position(
    df: DataFrame, key: str = "id", seed: int = SEED, name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row in the shuffled order of ``seed``.

    Only the key and its digest are sorted; other columns of ``df`` are joined back by the key,
    which is to be unique.
    """
    keyed = df.select(key, digest(F.col(key), seed=seed).alias("_h"))
    placed = range_positions(keyed, ["_h", key], "digests", name).select(key, name)
    return placed if df.columns == [key] else df.join(placed, key)


def range_positions(
    df: DataFrame, order: list[str], folder: str, name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row by ``order``, which is to be unique."""
    parts = range_parts(df, order, folder)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.join(offsets, "_part").select(*df.columns, (F.col("_offset") + inside).alias(name))


def batch_numbers(
    df: DataFrame, key: str = "id", batch_size: int = BATCH_SIZE, seed: int = SEED
) -> DataFrame:
    """Add the 0-based number of the batch each row falls into, in shuffled order."""
    placed = hash_position(df, key, seed, name="_p")
    return placed.withColumn(
        "batch", F.floor((F.col("_p") - 1) / F.lit(batch_size)).cast("bigint")
    ).drop("_p")


def shuffled(df: DataFrame, key: str = "id", seed: int = SEED) -> DataFrame:
    """Rows in the shuffled order of ``seed`` (a range-partitioned sort)."""
    return df.orderBy(digest(F.col(key), seed=seed), key)


def rank_cuts(
    keyed: DataFrame,
    key: str,
    stratum: str,
    tenths: tuple[int, ...],
    digits: int = 4,
) -> DataFrame:
    """The digest and key of the last row within each cut, per stratum.

    ``keyed`` has ``stratum``, ``key`` and the digest ``_h``. A cut of ``t``
    tenths holds the first ``n * t div 10`` rows of the stratum. Counting rows per
    digest bucket tells in which bucket a cut falls, so only the rows of those
    buckets are ranked, not the table.
    """
    bucketed = keyed.select(stratum, key, "_h", F.substring("_h", 1, digits).alias("_b"))
    sizes = bucketed.groupBy(stratum, "_b").agg(F.count("*").alias("_n"))
    whole = W.partitionBy(stratum)
    running = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    places = sizes.select(
        F.col(stratum).alias("_s"),
        "_b",
        F.sum("_n").over(running).alias("_upto"),
        "_n",
        F.sum("_n").over(whole).alias("_total"),
    ).select(
        "_s",
        "_b",
        F.explode(F.array(*[F.lit(t) for t in tenths])).alias("_cut"),
        (F.col("_upto") - F.col("_n")).alias("_before"),
        "_upto",
        "_total",
    )
    target = F.expr("_total * _cut div 10")
    hit = places.where((target > F.col("_before")) & (target <= F.col("_upto"))).select(
        "_s", "_b", "_cut", (target - F.col("_before")).alias("_need")
    )
    # One bucket per stratum and cut: the join keeps 1/16**digits of the rows.
    edge = bucketed.withColumnRenamed("_b", "_eb").join(
        hit, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_eb") == F.col("_b"))
    )
    place = F.row_number().over(W.partitionBy("_s", "_cut").orderBy("_h", key))
    last = edge.withColumn("_p", place).where(F.col("_p") == F.col("_need"))
    wide = [
        F.max(F.when(F.col("_cut") == t, F.struct("_h", key))).alias(f"_c{t}") for t in tenths
    ]
    return last.groupBy("_s").agg(*wide)

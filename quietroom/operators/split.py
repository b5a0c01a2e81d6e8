"""Reproducible train/validation/test membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietroom.functions.hashing import digest, digest_number
from quietroom.operators.ranking import rank_cuts
from quietroom.settings import SEED


def hash_split(key: Column, train_percent: int = 80, seed: int = SEED) -> Column:
    """``train`` or ``test`` from the key alone; narrow and stateless."""
    draw = digest_number(digest(key, seed=seed)) % 100
    return F.when(draw < train_percent, "train").otherwise("test")


def stratified_split(
    df: DataFrame,
    key: str = "id",
    stratum: str = "toxic",
    seed: int = SEED,
    digits: int = 4,
) -> DataFrame:
    """Add ``split`` with exact 80/10/10 shares inside every class of ``stratum``.

    Each class is ordered by key digest. The two cut points per class are found
    first; a row then only compares its digest with them, so the table itself is
    not sorted however unbalanced the classes are. There is one row of cut points per
    class; whether they are sent along or shuffled is decided when their size is known.
    """
    keyed = df.withColumn("_h", digest(F.col(key), seed=seed))
    cuts = rank_cuts(keyed.select(key, stratum, "_h"), key, stratum, (8, 9), digits)
    placed = keyed.join(cuts, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    me = F.struct(F.col("_h"), F.col(key))
    split = (
        F.when(F.coalesce(me <= F.col("_c8"), F.lit(False)), "train")
        .when(F.coalesce(me <= F.col("_c9"), F.lit(False)), "val")
        .otherwise("test")
    )
    return placed.withColumn("split", split).drop("_h", "_s", "_c8", "_c9")


def in_split(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)

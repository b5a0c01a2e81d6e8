"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietroom.llm.base import shared_path
from quietroom.session import drop_folder, shuffles_released


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the ``u, v`` edges; root is the smallest node reachable.

    Each step writes its edges to the shared folder, so a lost executor costs one step, and joins on
    nodes that many edges share can be split by the engine. Nulls and loops are ignored; repeated
    edges count once. The number of steps is about the logarithm of the longest path.
    """
    spark = edges.sparkSession
    schema = "u bigint, v bigint"
    pairs = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    path = None
    current = pairs.distinct()
    while True:
        following = shared_path(spark, "edges")
        with shuffles_released(spark):
            current.write.parquet(following)
        if path:
            drop_folder(spark, path)
        path = following
        stored = spark.read.schema(schema).parquet(path)
        if _is_star_forest(stored):
            break
        both = stored.unionByName(stored.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), "m")
        current = (
            small.unionByName(least)
            .select(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("v"))
            .where("u <> v")
            .distinct()
        )
    found = stored.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(
        stored.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every ``u`` has one edge only and no ``v`` is a ``u``."""
    above = F.struct(F.lit(1).alias("up"), F.lit(0).alias("down"))
    below = F.struct(F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), above.alias("is")),
        F.struct(F.col("v").alias("node"), below.alias("is")),
    )).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.is.up").alias("up"), F.sum("e.is.down").alias("down"))
    return seen.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()

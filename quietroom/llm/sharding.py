"""Reproducible shuffle into shards by a Feistel permutation. DataFrame functions only.

Rows are numbered from 0 by their hash order, with one shuffle of narrow rows; a Feistel network
over pairs (x mod a, x div a), a the least whole number with a * a >= n, permutes the numbers.
Values outside 0..n-1 walk on along their cycle until they come back inside. The permuted number p
gives shard p mod s and slot p div s, so both follow from the row number, the row count and the
key alone, and ``row_at`` goes the other way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietroom.llm.base import query, table

PRIME = 2**31 - 1
ROUNDS = 6
# Steps along a cycle. A step misses with a probability of about 2 / sqrt(n), at most 3 / 4, and
# tables of up to 64 rows have no longer cycle; a row that still is outside raises an error.
WALK = 64
MAX_BUCKETS = 65_536
BUCKET_ROWS = 64


def round_keys(key: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Coefficients of the round functions, by a fixed multiplicative generator."""
    state, out = key % PRIME or 1, []
    for _ in range(rounds):
        row = []
        for _ in range(3):
            state = state * 48_271 % PRIME
            row.append(state)
        out.append(tuple(row))
    return out


def side(n: int) -> int:
    a = math.isqrt(n)
    return max(1, a if a * a >= n else a + 1)


def _mix(x, c):
    """A cubic over the field of PRIME elements; every product stays below 2^62."""
    return (((c[0] * x + c[1]) % PRIME * x + c[2]) % PRIME * x + c[0]) % PRIME


def one_pass(rows: DataFrame, n: int, keys: list[tuple[int, int, int]]) -> DataFrame:
    """``__p``: one pass of the network over ``__p``, a projection for each round."""
    a = side(n)
    rows = rows.withColumns({"__l": F.col("__p") % a, "__r": F.floor(F.col("__p") / a)})
    for c in keys:
        turned = (F.col("__l") + _mix(F.col("__r"), c)) % a
        rows = rows.withColumns({"__l": F.col("__r"), "__r": turned})
    return rows.withColumn("__p", F.col("__l") + F.col("__r") * a).drop("__l", "__r")


def walked(p: Column, n: int, keys: list[tuple[int, int, int]]) -> Column:
    """``p`` moved along its cycle into 0..n-1; the fold runs for values outside only."""
    a = side(n)
    rounds = [
        F.struct(
            *[F.lit(x).cast("long").alias(f"c{i}") for i, x in enumerate(c)],
            F.lit(k == len(keys) - 1).alias("last"),
        )
        for k, c in enumerate(keys)
    ]
    start = F.struct((p % a).alias("l"), F.floor(p / a).alias("r"), F.lit(False).alias("done"))

    def turn(s: Column, c: Column) -> Column:
        left, right = s["r"], (s["l"] + _mix(s["r"], [c["c0"], c["c1"], c["c2"]])) % a
        inside = c["last"] & (left + right * a < n)
        moved = F.struct(left.alias("l"), right.alias("r"), inside.alias("done"))
        return F.when(s["done"], s).otherwise(moved)

    def number(s: Column) -> Column:
        lost = F.raise_error(F.lit("cycle longer than the walk; choose another key"))
        return F.when(s["done"], s["l"] + s["r"] * a).otherwise(lost.cast("long"))

    steps = F.flatten(F.array_repeat(F.array(*rounds), WALK))
    return F.when(p < n, p).otherwise(F.aggregate(steps, start, turn, number))


def permuted(rows: DataFrame, number: str, n: int, key: int, into: str) -> DataFrame:
    """``into``: the place of row ``number`` among ``n``, a permutation that ``key`` selects."""
    keys = round_keys(key)
    first = one_pass(rows.withColumn("__p", F.col(number).cast("long")), n, keys)
    return first.withColumn(into, walked(F.col("__p"), n, keys)).drop("__p")


def place_of(number: int, n: int, key: int) -> int:
    """``permuted`` for one number, without Spark."""
    a, keys, p = side(n), round_keys(key), number
    while True:
        left, right = p % a, p // a
        for c in keys:
            left, right = right, (left + _mix(right, c)) % a
        p = left + right * a
        if p < n:
            return p


def row_at(place: int, n: int, key: int) -> int:
    """The row number at a place: the inverse of ``place_of``."""
    a, keys, p = side(n), round_keys(key), place
    while True:
        left, right = p % a, p // a
        for c in reversed(keys):
            left, right = (right - _mix(left, c)) % a, left
        p = left + right * a
        if p < n:
            return p


def numbered(rows: DataFrame, order: list[str], n: int, into: str) -> DataFrame:
    """Number ``n`` rows from 0 in the order of (xxhash64(order), order).

    The hash range is cut into buckets, at most MAX_BUCKETS of them, so the broadcast table of
    bucket offsets stays below 1 MB; a bucket holds about BUCKET_ROWS rows until there are more
    than 4 million rows, and n / MAX_BUCKETS beyond.
    """
    bits = max(1, min(MAX_BUCKETS, math.ceil(n / BUCKET_ROWS)) - 1).bit_length()
    hashed = rows.withColumn("__h", F.xxhash64(*order)).withColumn(
        "__bucket", F.shiftrightunsigned("__h", 64 - bits)
    )
    sizes = hashed.groupBy("__bucket").count()
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy("__bucket").orderBy("__h", *order)
    return (
        hashed.withColumn("__rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn(into, F.col("__offset") + F.col("__rank") - 1)
        .drop("__h", "__bucket", "__rank", "__offset")
    )


def shard_rows(docs: DataFrame, shards: int, key: int = 42) -> DataFrame:
    """Put every row of ``doc_id, text`` into a shard and a slot, in shuffled order.

    Returns ``doc_id, size, text_crc32, row_number, shard, slot``: row counts of the shards differ
    by one at most and slots count from 0 without gaps. Equal rows, and rows of one id, get places
    of their own; which of several equal rows gets which place makes no difference. A null text has
    size 1 and checksum 0; a null id is a value like others. Further columns are not used. An empty
    table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    n = docs.select("doc_id").count()
    rows = numbered(narrow, ["doc_id", "text_crc32", "size"], n, "row_number")
    return permuted(rows, "row_number", n, key, "__place").select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (F.col("__place") % shards).cast("int").alias("shard"),
        F.floor(F.col("__place") / shards).cast("long").alias("slot"),
    )


@query("op5_sharding")
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return shard_rows(docs, 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

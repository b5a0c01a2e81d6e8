"""Fixed-length token ids per comment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietroom.functions.hashing import digest
from quietroom.functions.text import clean_text, sequence_pieces
from quietroom.operators.ranking import range_positions
from quietroom.operators.vocabulary import corpus_counts, most_frequent
from quietroom.settings import BATCH_SIZE, MAX_LEN, SEED

# Fixed ids of the special tokens; vocabulary words follow by frequency.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
SPECIAL_TOKENS = 4
# Lengths that may share a batch of dynamic width.
LENGTH_CLASS = 8


def word_ids(df: DataFrame, max_words: int, text: str = "comment_text") -> DataFrame:
    """``term, token_id`` of the ``max_words`` most frequent words."""
    counts = corpus_counts(df, sequence_pieces(clean_text(F.col(text))))
    return most_frequent(counts, max_words).select(
        "term", (F.col("idx") + SPECIAL_TOKENS).cast("int").alias("token_id")
    )


def encode_sequences(
    df: DataFrame,
    words: DataFrame,
    key: str = "id",
    text: str = "comment_text",
    max_len: int = MAX_LEN,
) -> DataFrame:
    """``ids``, ``mask`` and ``token_type_ids`` of length ``max_len`` per comment.

    At most ``max_len - 2`` words of a comment are looked up in ``words`` and regrouped by key
    as small integers. The lookup carries no hint: small vocabularies are sent along, and where
    one is shuffled, frequent words are split over tasks.
    """
    pieces = F.slice(sequence_pieces(clean_text(F.col(text))), 1, max_len - 2)
    placed = df.select(key, F.posexplode_outer(pieces).alias("pos", "term"))
    found = placed.join(words, "term", "left")
    token = F.when(F.col("pos").isNotNull(), F.coalesce("token_id", F.lit(UNK)))
    listed = found.groupBy(key).agg(
        F.sort_array(
            F.collect_list(F.when(token.isNotNull(), F.struct("pos", token.alias("token"))))
        ).alias("_l")
    )
    body = F.transform("_l", lambda e: e["token"])
    used = F.size("_l") + 2
    return listed.select(
        key,
        F.concat(
            F.array(F.lit(CLS)), body, F.array(F.lit(SEP)), F.array_repeat(F.lit(PAD), max_len - used)
        ).alias("ids"),
        F.concat(
            F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), max_len - used)
        ).alias("mask"),
        F.array_repeat(F.lit(0), max_len).alias("token_type_ids"),
    )


def word_lengths(
    df: DataFrame, key: str = "id", text: str = "comment_text", max_len: int = MAX_LEN
) -> DataFrame:
    """``key, n_used``: how many ids of ``encode_sequences`` are not padding."""
    pieces = F.size(sequence_pieces(clean_text(F.col(text))))
    return df.select(key, F.least(pieces + 2, F.lit(max_len)).alias("n_used"))


def length_batches(
    lengths: DataFrame,
    key: str = "id",
    batch_size: int = BATCH_SIZE,
    class_width: int = LENGTH_CLASS,
    seed: int = SEED,
) -> DataFrame:
    """``key, n_used, batch, width``: batches of about equal lengths, padded to their longest.

    Lengths are cut into classes of ``class_width``; within a class the order is that of the keys'
    digests. Batches run through the classes, so only a batch between two classes mixes lengths.
    Rows are dealt to ranges of that order, stored once, and the counts of the ranges give the
    positions, so neither a frequent length nor the table is sorted in one task. Keys are distinct.
    """
    keyed = lengths.select(
        key,
        "n_used",
        F.floor((F.col("n_used") - 1) / class_width).alias("_c"),
        digest(F.col(key), seed=seed).alias("_h"),
    )
    placed = range_positions(keyed, ["_c", "_h", key], "length-batches")
    batch = F.floor((F.col("position") - 1) / F.lit(batch_size)).cast("bigint")
    numbered = placed.select(key, "n_used", batch.alias("batch"))
    widths = numbered.groupBy("batch").agg(F.max("n_used").alias("width"))
    return numbered.join(widths, "batch").select(key, "n_used", "batch", "width")


def padded_to(encoded: DataFrame, batches: DataFrame, key: str = "id") -> DataFrame:
    """``encode_sequences`` rows cut to their batch's width, with ``batch``."""
    rows = encoded.join(batches.select(key, "batch", "width"), key)
    cut = [F.slice(c, F.lit(1), F.col("width")).alias(c) for c in ("ids", "mask", "token_type_ids")]
    return rows.select(key, "batch", *cut)

"""Mean and max pooling of token vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietroom.session import materialize

# Words whose vectors are gathered at a time.
WORDS_AT_ONCE = 20_000
# Texts of a block, which share the vectors of their words.
BLOCK_TEXTS = 8192


def pool_groups(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean and max over the vectors of each group, concatenated.

    The summariser keeps one mean and one max vector per group and merges partial
    ones, so a group of any size moves a few vectors per task, not its rows.
    """
    rows = df.select(by, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    pooled = rows.groupBy(by).agg(
        Summarizer.mean(F.col("_v")).alias("_mean"),
        Summarizer.max(F.col("_v")).alias("_max"),
        F.count("*").alias("n"),
    )
    return pooled.select(
        by,
        "n",
        F.concat(vector_to_array("_mean"), vector_to_array("_max")).alias("pooled"),
    )


def pool_counts(matrix, indices: Column, counts: Column) -> Column:
    """Pool the word vectors of one comment from its word counts.

    ``matrix`` is a broadcast array with one row per vocabulary word. A comment
    without known words gets zeros.
    """

    @F.pandas_udf("array<float>")
    def pooled(index: pd.Series, count: pd.Series) -> pd.Series:
        table = matrix.value
        width = table.shape[1]
        sizes = np.array([0 if i is None else len(i) for i in index])
        out = np.zeros((len(index), 2 * width), dtype=np.float32)
        held = np.flatnonzero(sizes)
        # A few thousand words at a time, whatever the texts.
        parts = np.split(held, np.unique(np.cumsum(sizes[held]) // WORDS_AT_ONCE, return_index=True)[1][1:])
        for part in parts if len(held) else []:
            rows = table[np.concatenate([index.iloc[i] for i in part])]
            weights = np.concatenate([count.iloc[i] for i in part]).astype(np.float32)
            starts = np.cumsum(sizes[part]) - sizes[part]
            total = np.add.reduceat(rows * weights[:, None], starts, axis=0)
            out[part, :width] = total / np.add.reduceat(weights, starts)[:, None]
            out[part, width:] = np.maximum.reduceat(rows, starts, axis=0)
        return pd.Series(list(out))

    return pooled(indices, counts)


def _pool_block(key: str, width: int, texts: pa.Table, found: pa.Table) -> pa.Table:
    """``key, pooled`` of the texts of one block; ``found`` has the vectors of its words."""
    keys, lists = texts.column(key).combine_chunks(), texts.column("terms").combine_chunks()
    # Rows that share a key are one text; those without a key stay without words.
    code = keys.dictionary_encode()
    codes = pc.fill_null(code.indices, -1).to_numpy().astype(np.int64)
    held = np.repeat(codes, pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    half = width // 2
    out = np.zeros((len(code.dictionary) + 1, width))  # the last row is that of rows without a key
    if found.num_rows:
        table = np.stack(found.column("vector").to_numpy()).astype(np.float64)
        known = found.column("term").combine_chunks().dictionary_encode()
        at = pc.fill_null(pc.index_in(lists.flatten(), known.dictionary), -1).to_numpy().astype(np.int64)
        used = (at >= 0) & (held >= 0)
        # A term may have several vectors: all of them count.
        order = np.argsort(known.indices.to_numpy(), kind="stable")
        sizes = np.bincount(known.indices.to_numpy(), minlength=len(known.dictionary))
        first = np.cumsum(sizes) - sizes
        pairs, times = np.unique(held[used] * len(sizes) + at[used], return_counts=True)
        text, term = np.divmod(pairs, len(sizes))
        many = sizes[term]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        text, times = np.repeat(text, many), np.repeat(times, many).astype(np.float64)
        row = order[np.repeat(first[term], many) + place]
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        # Whole texts, a few thousand words at a time.
        cuts = np.unique(starts // WORDS_AT_ONCE, return_index=True)[1][1:] if len(starts) else []
        for part in np.split(starts, cuts) if len(starts) else []:
            low = part[0]
            after = starts[np.searchsorted(starts, part[-1]) + 1 :]
            high = after[0] if len(after) else len(text)
            vectors, weights = table[row[low:high]], times[low:high]
            total = np.add.reduceat(vectors * weights[:, None], part - low, axis=0)
            out[text[part], :half] = total / np.add.reduceat(weights, part - low)[:, None]
            out[text[part], half:] = np.maximum.reduceat(vectors, part - low, axis=0)
    offsets = np.arange(len(codes) + 1, dtype=np.int32) * width
    pooled = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[codes].ravel()))
    return pa.table({key: keys, "pooled": pooled})


def block_vectors(placed: DataFrame, vectors: DataFrame) -> DataFrame:
    """``_of, term, vector``: each distinct word of a ``_block`` once, however many texts have it."""
    of = F.col("_block").alias("_of")
    words = placed.select(of, F.explode(F.array_distinct("terms")).alias("term")).distinct()
    return words.join(vectors.select("term", "vector"), "term").select("_of", "term", "vector")


def pool_terms(
    tokens: DataFrame, vectors: DataFrame, key: str, width: int, block_texts: int = BLOCK_TEXTS
) -> DataFrame:
    """``key, pooled``: mean and max of the word vectors of ``key, terms``, by a join on the words.

    ``vectors`` has ``term, vector`` and may be of any size; a table bucketed by ``term`` is not
    shuffled. Texts are dealt to blocks by their key; each distinct word of a block is joined with
    its vector once and sent to the block, so what is sent is a vocabulary for every
    ``block_texts`` texts and not a vector for every word. ``width`` is that of the
    result; a text without known words gets zeros.
    """
    blocks = max(1, -(-tokens.select(key).count() // block_texts))
    drawn = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.monotonically_increasing_id())
    block = F.pmod(drawn, F.lit(blocks)).alias("_block")
    placed = materialize(tokens.select(key, block, "terms"), "pool-texts")
    found = block_vectors(placed, vectors)

    def pooled(texts: pa.Table, known: pa.Table) -> pa.Table:
        return _pool_block(key, width, texts, known)

    kind = tokens.schema[key].dataType.simpleString()
    return (
        placed.groupBy("_block")
        .cogroup(found.groupBy("_of"))
        .applyInArrow(pooled, f"`{key}` {kind}, pooled array<double>")
    )

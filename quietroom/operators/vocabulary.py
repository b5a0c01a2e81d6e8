"""Term counts and bounded vocabularies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietroom.session import join_bounded, materialize
from quietroom.settings import MAX_FEATURES

# Counters of a partition's sketch. A term that makes up more than one in so many of all terms is
# never lost; the 20,000th most frequent n-gram of a language is far above that.
SKETCH_COUNTERS = 1_000_000
# Array elements that a Python worker counts at once.
ELEMENTS_AT_ONCE = 500_000


def term_frequencies(df: DataFrame, terms: Column, pairs: bool = False) -> DataFrame:
    """Corpus count ``tf`` and document count ``df`` of every term.

    Each task counts its arrays, many rows together, and sends each term of theirs once with
    both counts; these are summed in the one shuffle, which is keyed by term only. With ``pairs``
    the terms are words without spaces, and adjacent ones joined by a space count as well.
    """
    return _summed(_partial_counts(df, terms, pairs))


def _partial_counts(df: DataFrame, terms: Column, pairs: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lists in _pieces(batch.column(0)):
                yield from _counted(lists, pairs)

    return df.select(terms.alias("_terms")).mapInArrow(run, "term string, tf bigint, df bigint")


def _pieces(lists: pa.ListArray, most: int = ELEMENTS_AT_ONCE) -> Iterator[pa.ListArray]:
    """The rows, some at a time: with no more than ``most`` elements, or one row."""
    ends = np.cumsum(_sizes(lists))
    low = 0
    while low < len(lists):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lists.slice(low, high - low)
        low = high


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _counted(lists: pa.ListArray, pairs: bool) -> Iterator[pa.RecordBatch]:
    """``term, tf, df`` over some rows, each term once.

    A number says which term an occurrence is and in which row; sorted, equal ones lie together.
    """
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    words, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if not len(at):
        return
    rows, n = len(lists), len(words)
    row = np.repeat(np.arange(rows), _sizes(lists))
    found = at * rows + row
    if pairs:
        # Terms below n are words; the others hold the first word's number, from 1 on, times n.
        two = (at[:-1] + 1) * n + at[1:]
        missing = pc.is_null(words).to_numpy(zero_copy_only=False)
        if missing.any():
            two = np.where(missing[at[:-1]] | missing[at[1:]], np.flatnonzero(missing)[0], two)
        found = np.append(found, (two * rows + row[1:])[row[1:] == row[:-1]])
    found.sort()
    starts = np.flatnonzero(np.diff(found, prepend=-1))  # of a term in a row
    term = found[starts] // rows
    first = np.flatnonzero(np.diff(term, prepend=-1))
    tf = np.diff(np.append(starts[first], len(found)))
    df = np.diff(np.append(first, len(starts)))
    left, right = np.divmod(term[first], n)
    single = int(np.searchsorted(left, 1))
    names = words.take(pa.array(right[:single]))
    if single < len(left):
        joined = pc.binary_join_element_wise(
            words.take(pa.array(left[single:] - 1)), words.take(pa.array(right[single:])), " "
        )
        names = pa.concat_arrays([names, joined])
    yield pa.RecordBatch.from_arrays([names, pa.array(tf), pa.array(df)], ["term", "tf", "df"])


def _summed(entries: DataFrame) -> DataFrame:
    return entries.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def corpus_counts(df: DataFrame, terms: Column) -> DataFrame:
    """``term, tf`` only, for uses that need no document counts."""
    return df.select(F.explode(terms).alias("term")).groupBy("term").agg(
        F.count("*").alias("tf")
    )


def most_frequent(counts: DataFrame, limit: int = MAX_FEATURES) -> DataFrame:
    """The ``limit`` most frequent terms with their 0-based rank ``idx``.

    Ties go to the smaller term. A histogram over the bit length of the counts
    (at most 64 rows) shows which magnitudes can reach the limit; the long tail of
    rare terms is dropped by that filter before the top-k sort.
    """
    magnitude = F.length(F.bin("tf"))
    # Every count is positive; naming them all keeps both readers of ``counts``
    # on the same columns, so that its shuffle is done once and read twice.
    present = [F.col(c) > 0 for c in counts.columns if c in ("tf", "df")]
    sizes = counts.groupBy(magnitude.alias("_m")).agg(
        F.count(F.when(reduce(and_, present), 1)).alias("_n")
    )
    larger = W.orderBy(F.desc("_m")).rowsBetween(W.unboundedPreceding, -1)
    needed = sizes.withColumn("_above", F.coalesce(F.sum("_n").over(larger), F.lit(0)))
    lowest = needed.where(F.col("_above") < limit).agg(F.min("_m"))
    top = (
        counts.where(magnitude >= F.lit(lowest.scalar()))
        .orderBy(F.desc("tf"), "term")
        .limit(limit)
    )
    place = F.row_number().over(W.orderBy(F.desc("tf"), "term"))
    return top.withColumn("idx", place - 1)


def vocabulary(
    df: DataFrame, terms: Column, limit: int = MAX_FEATURES, pairs: bool = False
) -> DataFrame:
    """``term, tf, df, idx`` of the ``limit`` most frequent terms."""
    return most_frequent(term_frequencies(df, terms, pairs), limit)


def frequent_sketch(
    df: DataFrame, terms: Column, counters: int = SKETCH_COUNTERS, pairs: bool = False
) -> tuple[DataFrame, int]:
    """``term, low`` of the terms that can be frequent, and by how much ``low`` can be short.

    Every partition counts its terms in at most ``2 * counters`` places; when they are full, the
    count of the ``counters``-th largest is taken off all of them, and what is left with nothing
    goes. A term's count is thus at least the sum of its places, ``low``, and at most that plus the
    sum of what the partitions took off; a term without a place has no more than the latter. A
    worker holds the places and what ELEMENTS_AT_ONCE elements add to them, whatever its batches.
    """

    def run(batches):
        held = pa.table({"term": pa.array([], pa.string()), "low": pa.array([], pa.int64())})
        taken = 0
        for batch in batches:
            for lists in _pieces(batch.column(0)):
                for found in _counted(lists, pairs):
                    new = pa.table([found.column("term"), found.column("tf")], ["term", "low"])
                    both = pa.concat_tables([held, new]).group_by("term", use_threads=False)
                    held = both.aggregate([("low", "sum")]).rename_columns(["term", "low"])
                if len(held) > 2 * counters:
                    low = held.column("low").to_numpy()
                    least = int(np.partition(low, len(low) - 1 - counters)[len(low) - 1 - counters])
                    left = held.filter(pa.array(low > least))
                    held = left.set_column(1, "low", pc.subtract(left.column("low"), least))
                    taken += least
        yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "low": [taken]})
        yield from held.to_batches()

    listed = df.select(F.filter(terms, lambda t: t.isNotNull()).alias("_terms"))
    parts = listed.mapInArrow(run, "term string, low bigint")
    merged = materialize(parts.groupBy("term").agg(F.sum("low").alias("low")), "term-sketch")
    error = merged.where("term IS NULL").agg(F.coalesce(F.sum("low"), F.lit(0))).first()[0]
    return merged.where("term IS NOT NULL"), error


def prefiltered_vocabulary(
    df: DataFrame,
    terms: Column,
    limit: int = MAX_FEATURES,
    counters: int = SKETCH_COUNTERS,
    pairs: bool = False,
) -> DataFrame:
    """``vocabulary`` with exact counts of those terms only that can be among the most frequent.

    The ``limit``-th largest lower bound of the sketch is a count that at least ``limit`` terms
    reach. If it is above the sketch's error, no term without a place can be among them, and of the
    others only those whose upper bound reaches it are counted. Otherwise the sketch proves nothing,
    and all terms are counted. ``df`` is read twice and should be a stored table.
    """
    sketch, error = frequent_sketch(df, terms, counters, pairs)
    lows = sketch.orderBy(F.desc("low")).limit(limit)
    reached, least = lows.agg(F.count("*"), F.min("low")).first()
    if error and (reached < limit or least <= error):
        return vocabulary(df, terms, limit, pairs)
    possible = sketch.where(F.col("low") + error >= F.lit(least or 0)).select("term")
    wanted = materialize(possible, "possible-terms")
    parts = _partial_counts(df, terms, pairs)
    kept = join_bounded(parts, wanted, "term", "left_semi", wanted.count())
    return most_frequent(_summed(kept), limit)

"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item gets a 64-bit SimHash of its weighted 5-word shingles. Windows of a document
that are as long as an item are fingerprinted the same way and looked up in a multi-index: six
blocks of the fingerprint with all values within RADIUS // 6 flipped bits, so that every
fingerprint within RADIUS bits is found. Candidates are verified by exact weighted Jaccard
similarity of the shingles. A window that shares no shingle with any item of its length has
similarity 0 and is not fingerprinted. A document with fewer words than an item is one window, as
long as it has enough shingles to reach the similarity. Everything happens inside the scan of the
documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.llm.base import query, table, with_arrow_columns
from quietroom.llm.words import NOT_ALPHANUMERIC, shingles, word_hashes
from quietroom.session import drop_folder, settled_path

_U = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
# Equal-sized sets of similarity 0.8 differ in 0.152 of their bits on average, 9.7 of 64 with a
# deviation of 2.9; 18 bits lose about 3 in 1000 of those at 0.8 exactly, and none that are closer.
RADIUS = 18
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
# Benchmark characters that one pass over the documents carries along; more take several passes.
PASS_CHARS = 20_000_000
SPAN = 16_384
FILTER_BITS = 20


def fingerprints(grams: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of ``grams[s : s + count]`` for each start; ties of a bit count as 0."""
    low, high = int(starts.min()), int(starts.max()) + count
    bits = np.unpackbits(grams[low:high].view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    ones = sums[starts - low + count] - sums[starts - low]
    return np.packbits(2 * ones > count, axis=1).view(_U).ravel()


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets given as arrays of hashes."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


@dataclass
class SizeIndex:
    """The items of one length in words."""

    words: int
    items: list[int] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)

    def build(self) -> None:
        whole = [np.array([0]) for _ in self.grams]
        self.prints = np.concatenate(
            [fingerprints(g, s, len(g)) for g, s in zip(self.grams, whole, strict=True)]
        )
        reach = RADIUS // len(BLOCKS)
        keys, owners = [], []
        for number, (shift, width) in enumerate(BLOCKS):
            flips = [0]
            for r in range(1, reach + 1):
                flips += [sum(1 << b for b in c) for c in combinations(range(width), r)]
            flips = np.array(flips)
            value = ((self.prints >> _U(shift)) & _U((1 << width) - 1)).astype(np.int64)
            near = value[:, None] ^ flips[None, :]
            keys.append((near + (number << 11)).ravel())
            owners.append(np.repeat(np.arange(len(value)), len(flips)))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.owners = owners[order]
        self.offsets = np.searchsorted(keys[order], np.arange((len(BLOCKS) << 11) + 1))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) positions of all fingerprints within RADIUS bits."""
        pairs = []
        for number, (shift, width) in enumerate(BLOCKS):
            value = ((prints >> _U(shift)) & _U((1 << width) - 1)).astype(np.int64)
            key = value + (number << 11)
            lows, counts = self.offsets[key], self.offsets[key + 1] - self.offsets[key]
            window = np.repeat(np.arange(len(prints)), counts)
            inner = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
            pairs.append(window * len(self.items) + self.owners[np.repeat(lows, counts) + inner])
        found = np.unique(np.concatenate(pairs))
        window, item = found // len(self.items), found % len(self.items)
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], item[near]


class LeakIndex:
    """Finds windows of texts that are similar to benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.sizes: dict[int, SizeIndex] = {}
        words, ends = hashed(pa.array(texts, pa.string()))
        for i, item in enumerate(ids):
            own = words[ends[i] : ends[i + 1]]
            if len(own):
                group = self.sizes.setdefault(len(own), SizeIndex(len(own)))
                group.items.append(item)
                group.grams.append(shingles(own, SHINGLE))
        # shingle -> item lengths that hold it, for each width of shingle
        self.holders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {min(SHINGLE, n) for n in self.sizes}:
            rows = [
                np.stack([g, np.full(len(g), n, _U)], axis=1)
                for n, group in self.sizes.items()
                if min(SHINGLE, n) == width
                for g in group.grams
            ]
            rows = np.unique(np.concatenate(rows), axis=0)
            mask = np.zeros(1 << FILTER_BITS, bool)
            mask[(rows[:, 0] & _U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.holders[width] = (mask, rows[:, 0].copy(), rows[:, 1].astype(np.int64))
        for group in self.sizes.values():
            group.build()

    def matches(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item found."""
        best: dict[int, tuple[float, int, int]] = {}
        for width, (mask, keys, lengths) in self.holders.items():
            if len(words) < width:
                continue
            grams = shingles(words, width)
            maybe = np.flatnonzero(mask[(grams & _U((1 << FILTER_BITS) - 1)).astype(np.int64)])
            if not len(maybe):
                continue
            low = np.searchsorted(keys, grams[maybe], "left")
            count = np.searchsorted(keys, grams[maybe], "right") - low
            where = np.repeat(maybe, count)
            inner = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
            length = lengths[np.repeat(low, count) + inner]
            for n in np.unique(length):
                self._windows(self.sizes[int(n)], grams, where[length == n], width, best)
        return [(item, *found) for item, found in sorted(best.items())]

    def _windows(self, group, grams, hits, width, best) -> None:
        """Fingerprint and verify all windows of the group's length that hold one of the hits.

        A shorter text is one window, unless it is too short for the similarity.
        """
        count = group.words - width + 1
        if len(grams) < count:  # the whole text is the only window
            if len(grams) < self.similarity * count:
                return
            count = len(grams)
        last = len(grams) - count
        marks = np.zeros(last + 2, np.int64)
        np.add.at(marks, np.clip(hits - count + 1, 0, last + 1), 1)
        np.add.at(marks, np.clip(hits + 1, 0, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(marks)[: last + 1] > 0)
        for block in np.split(starts, np.flatnonzero(np.diff(starts // SPAN)) + 1):
            if not len(block):
                continue
            window, item = group.candidates(fingerprints(grams, block, count))
            for w, i in zip(block[window], item, strict=True):
                found = weighted_jaccard(grams[w : w + count], group.grams[i])
                name = group.items[i]
                if found >= self.similarity and found > best.get(name, (0,))[0]:
                    best[name] = (found, int(w), count + width - 1)


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(pc.utf8_lower(column), NOT_ALPHANUMERIC)


def benchmark_passes(benchmark: DataFrame, pass_chars: int) -> int:
    chars = benchmark.agg(F.sum(F.char_length("text"))).first()[0] or 0
    return max(1, -(-chars // pass_chars))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """``docs`` with ``leaks``, an array of the benchmark items that each text contains.

    ``docs`` has ``text``, ``benchmark`` has ``item_id, text``. An entry has ``item_id, similarity,
    start, n_words``: the best window as long as the item (the whole text if that is shorter),
    counted in words from 0, whose weighted 5-word shingles are at least ``similarity`` alike; the first of equal windows. Words are runs
    of letters and digits in lower case. Null and empty texts, on either side, match nothing, nor
    do items with a null id; repeated items give one entry for each id. Other columns pass through,
    one named ``leaks`` is replaced; an empty table on either side finds nothing. A benchmark of
    more than ``pass_chars`` characters is worked through in slices of that size, one pass after the
    other: what a pass finds is stored and its slice given up before the next one is read, so one is
    held at a time.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    slices = benchmark_passes(items, pass_chars)
    entry = "array<struct<item_id: bigint, similarity: double, start: bigint, n_words: bigint>>"
    kind = pa.list_(
        pa.struct(
            [("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64())]
            + [("n_words", pa.int64())]
        )
    )
    found, columns, before = docs.drop("leaks"), [], None
    for number in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == number).collect()
        index = spark.sparkContext.broadcast(
            LeakIndex([r["item_id"] for r in part], [r["text"] for r in part], similarity)
        )

        def compute(batch, index=index):
            words, ends = hashed(batch.column(batch.schema.get_field_index("text")))
            rows = []
            for i in range(len(ends) - 1):
                own = index.value.matches(words[ends[i] : ends[i + 1]])
                rows.append(
                    [dict(zip(("item_id", "similarity", "start", "n_words"), m)) for m in own]
                )
            return [pa.array(rows, kind)]

        columns.append(f"__leaks{number}")
        found = with_arrow_columns(found, compute, [f"{columns[-1]} {entry}"])
        if number + 1 < slices:
            path = settled_path(spark, lambda df=found: df, "llm-leaks")
            found = spark.read.schema(found.schema).parquet(path)
            index.destroy()
            if before:
                drop_folder(spark, before)
            before = path
    return found.withColumn("leaks", F.concat(*columns)).drop(*columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY):
    """The rows of ``docs`` that contain no benchmark item."""
    return find_leaks(docs, benchmark, similarity).where(F.size("leaks") == 0).drop("leaks")


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each benchmark item that a document contains."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, folder, "benchmark"))
    return found.where(F.size("leaks") > 0).select("doc_id", F.inline("leaks"))

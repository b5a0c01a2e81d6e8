"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to SYMBOLS symbols. Words one edit apart have reduced words at most one edit
apart, so the full one-edit neighbourhood of each distinct reduced word, itself included, is joined
with the reduced vocabulary; the words behind each hit are verified on their letters. Neighbours are
never spelled out: a 64-bit polynomial hash of a reduced word, from which the hash of each neighbour
follows by its prefix in one step, stands for it, and a collision is no more than one candidate more.

Words are counted where the texts lie, document by document; what one task has counted goes on as
(word, count) rows. Forms are followed by pointer jumping: each step doubles the way that is behind,
and a way is short, as the count at least doubles with each form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.llm.base import query, shared_path, slices, stored, table, with_arrow_columns
from quietroom.llm.words import mix
from quietroom.session import drop_folder, shuffles_released

_U = np.uint64
SYMBOLS = 8
LEAST_CHARS = 5
LEAST_COUNT = 3
MARKED = 97
# Distinct words that a task counts before it hands them on, and characters looked at in one go.
HELD_WORDS = 200_000
CHUNK = 1 << 20

_RUN = re.compile("[a-zÀ-ÿ]+")
_OTHER = re.compile("[^a-zÀ-ÿ]")
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_LENGTH = _U(0xA0761D6478BD642F)
_VALUES = mix(np.arange(1, SYMBOLS + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))


def runs(text: str) -> Counter:
    """How often each maximal run of letters occurs; only A-Z are lower-cased."""
    text = text.encode().lower().decode()  # bytes know no other upper case
    found, at = Counter(), 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            gap = _OTHER.search(text, end)
            end = gap.start() if gap else len(text)
        found.update(_RUN.findall(text[at:end]))
        at = end
    return found


def word_counts(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    marked: int | None = MARKED,
) -> DataFrame:
    """``word, n``: the words of all texts with at least these lengths and counts.

    ``marked`` damages runs: where it divides the CRC-32 h of ``doc_id:run``, the run loses its code
    point h modulo its length; a null id counts as an empty one.
    """

    def counts(batches) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                ["word", "n"],
            )

        for batch in (part for whole in batches for part in slices(whole)):
            for name, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                begun = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in runs(text or "").items():
                    if marked is not None:
                        drawn = zlib.crc32(word.encode(), begun)
                        if not drawn % marked:
                            at = drawn % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield block()
                    held.clear()
        yield block()

    found = docs.select("doc_id", "text").mapInArrow(counts, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _finished(value: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(value + length.astype(_U) * _LENGTH)


class _Reduced:
    """Reduced words as values of polynomials, all words of a batch side by side."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(_U)
        self.length = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(self.length) - self.length
        self.owner = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(codes)) - start[self.owner]
        steps = np.full(int(self.length.max(initial=0)) + 1, _BASE, _U)
        steps[0] = 1
        self.power = np.multiply.accumulate(steps)
        self.symbol = (mix(codes * _U(0x2545F4914F6CDD1D) + _U(11)) % _U(SYMBOLS)).astype(np.int64)
        self.term = _VALUES[self.symbol] * self.power[self.place]
        total = np.concatenate([np.zeros(1, _U), np.cumsum(self.term, dtype=_U)])
        self.value = total[start + self.length] - total[start]
        self.before = total[:-1] - total[start][self.owner]

    def hashes(self) -> np.ndarray:
        return _finished(self.value, self.length)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all reduced words at most one edit away, each once, and their owners."""
        owner, place, symbol = self.owner, self.place, self.symbol
        length, whole, at = self.length[owner], self.value[owner], self.power[self.place]
        after = whole - self.before
        previous = np.where(place > 0, np.roll(symbol, 1), -1)
        following = np.where(place < length - 1, np.roll(symbol, -1), -1)
        everyone = np.arange(len(self.length))
        last = symbol[np.cumsum(self.length) - 1]
        hashes, owners = [self.hashes()], [everyone]
        # Of a stretch of equal symbols the last one is deleted, and none is put behind an equal one.
        own = following != symbol
        shorter = self.before + (after - self.term) * _U(_BASE_INVERSE)
        hashes.append(_finished(shorter[own], length[own] - 1))
        owners.append(owner[own])
        for x in range(SYMBOLS):
            other = symbol != x
            changed = whole + (_VALUES[x] - _VALUES[symbol]) * at
            hashes.append(_finished(changed[other], length[other]))
            owners.append(owner[other])
            new = previous != x
            longer = self.before + _VALUES[x] * at + after * _U(_BASE)
            hashes.append(_finished(longer[new], length[new] + 1))
            owners.append(owner[new])
            new = last != x
            longer = self.value + _VALUES[x] * self.power[self.length]
            hashes.append(_finished(longer[new], self.length[new] + 1))
            owners.append(everyone[new])
        return np.concatenate(hashes), np.concatenate(owners)


def with_reduced(words: DataFrame) -> DataFrame:
    """``words`` with ``reduced``, the hash of each reduced word."""

    def compute(batch):
        found = _Reduced(batch.column(batch.schema.get_field_index("word")).to_pylist())
        return [pa.array(found.hashes().view(np.int64))]

    return with_arrow_columns(words, compute, ["reduced bigint"])


def neighbourhoods(words: DataFrame) -> DataFrame:
    """``reduced, near``: each distinct reduced word with its whole one-edit neighbourhood."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 256)):
            near, owner = _Reduced(batch.column("word").to_pylist()).neighbours()
            yield pa.RecordBatch.from_arrays(
                [batch.column("reduced").take(pa.array(owner)), pa.array(near.view(np.int64))],
                ["reduced", "near"],
            )

    one = words.groupBy("reduced").agg(F.min("word").alias("word"))
    return one.mapInArrow(run, "reduced bigint, near bigint")


def near_words(words: DataFrame) -> DataFrame:
    """``word, other, other_n``: all ordered pairs of words exactly one edit apart."""
    known = words.select(F.col("reduced").alias("near")).distinct()
    hits = neighbourhoods(words).join(known, "near")
    others = words.select(
        F.col("reduced").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n")
    )
    return (
        hits.join(words.select("reduced", "word"), "reduced")
        .join(others, "near")
        .where(F.levenshtein("word", "other", 1) == 1)
        .select("word", "other", "other_n")
    )


def followed(forms: DataFrame) -> DataFrame:
    """``word, root`` for the ``word, form`` rows: the last form of each chain."""
    spark = forms.sparkSession
    schema = "word string, root string"
    path = shared_path(spark, "forms")
    forms.select("word", F.col("form").alias("root")).write.parquet(path)
    while True:
        now = spark.read.schema(schema).parquet(path)
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        following = shared_path(spark, "forms")
        step = now.join(ahead, "root", "left")
        with shuffles_released(spark):
            step.select("word", F.coalesce("next", "root").alias("root")).write.parquet(following)
        drop_folder(spark, path)
        path = following


def spelling_variants(words: DataFrame) -> DataFrame:
    """Group the ``word, n`` rows by the more frequent spellings one edit away.

    Two words are near if they differ by one inserted, deleted or replaced code point. The form of
    a word is its near word of largest ``n``, of equal ones the smallest in code-point order, if
    that is at least twice the word's own; its root is where forms lead to, or the word itself.
    Returns ``word, form, root, n, n_near, form_n``, a row for each word. Words are distinct and
    not empty; rows with a null word are left out, those with a null ``n`` count as 0. Further
    columns are not used; an empty table gives an empty table.
    """
    clean = words.where("word <> ''").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    vocabulary = stored(with_reduced(clean), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(vocabulary).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best")
    )
    enough = F.col("form_n") >= 2 * F.col("n")
    found = (
        vocabulary.join(near, "word", "left")
        .withColumn("form_n", -F.col("best.less"))
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.form")).alias("form"),
            F.when(enough, F.col("form_n")).alias("form_n"),
        )
    )
    found = stored(found, "near-words")
    roots = followed(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, folder, "documents")))

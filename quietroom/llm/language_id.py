"""Language identification by the nearest of several centroids per language.

Texts become L2-normalised TF-IDF vectors of hashed letter 1- to 3-grams. Each language gets a few
centroids by spherical k-means over a bounded sample of its labelled rows; document frequencies
cover all training rows. A text takes the language of the centroid with the largest cosine, which
is also its score; texts farther from every centroid than texts of its language are rejected.

Short texts are farther away than long ones, so the bar of a language goes by the evidence in a
text: its number of letters or of different gram buckets, whichever is less. Every training row
counts whole at its own level, and cut to its first ``e`` letters at each level ``e`` it reaches;
the bar is the ``LOW`` quantile of their cosines with the nearest centroid, by labelled language.
Texts of the lowest level, under 64 letters, tell languages of one script badly apart: their bar is
halved so that clean words pass, which mostly holds back unseen scripts only.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.llm.base import held_out, query, slices, table, with_arrow_columns
from quietroom.llm.words import CHUNK, utf8

DIMENSIONS = 4096
# At most about so many labelled rows of each language take part in the clustering.
SAMPLE_ROWS = 1000
CLUSTERS = 4
ITERATIONS = 10
# Texts farther away than this are rejected whatever was learned.
MAX_DISTANCE = 0.97
# Least evidence of each level, the share of training rows below its bar, and steps of a cosine.
LEVELS = (1, 64, 256)
LOW = 0.001
# Of the bar of the lowest level, as a single word may be unlike all that training rows start with.
SHORT_SHARE = 0.5
STEPS = 1000
HISTOGRAM = pa.schema(
    [("lang", pa.string()), ("level", pa.int64()), ("step", pa.int64()), ("n", pa.int64())]
)
UNKNOWN = "und"

# ASCII letters and all bytes of other characters count as letters, the rest as one space.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams of lower-cased bytes; those of spaces only are left out."""
    letters = _LETTER[data]
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    codes = np.where(letters, data, 32)[keep].astype(np.uint64)
    codes = np.concatenate([[np.uint64(32)], codes])
    solid = codes != 32
    out = []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, 4):
        tail = codes[n - 1 :]
        value = value[: len(tail)] * np.uint64(257) + tail
        used = np.zeros(len(tail), bool)
        for i in range(n):
            used |= solid[i : len(solid) - n + 1 + i]
        hashed = (value[used] + np.uint64(n)) * _MULTIPLIERS[n - 1]
        out.append(((hashed >> np.uint64(16)) % np.uint64(DIMENSIONS)).astype(np.int64))
    return out


def gram_counts(column: pa.Array):
    """Yield (first row, counts) blocks: a row of ``DIMENSIONS`` gram counts for each text."""
    data, offsets = utf8(pc.utf8_lower(column))
    row, n = 0, len(offsets) - 1
    while row < n:
        start, rows = row, []
        size = 0
        while row < n and len(rows) < 256 and size < CHUNK:
            counts = np.zeros(DIMENSIONS, np.float32)
            for lo in range(int(offsets[row]), int(offsets[row + 1]), CHUNK):
                for grams in _grams(data[lo : min(lo + CHUNK, int(offsets[row + 1]))]):
                    counts += np.bincount(grams, minlength=DIMENSIONS)
            size += int(offsets[row + 1] - offsets[row])
            rows.append(counts)
            row += 1
        yield start, np.stack(rows)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts) * idf
    norms = np.linalg.norm(weights, axis=1, keepdims=True)
    return np.divide(weights, norms, out=weights, where=norms > 0)


def spherical_kmeans(vectors: np.ndarray, clusters: int, iterations: int) -> np.ndarray:
    """Unit centroids; starts from far apart rows, so equal input gives equal output."""
    best = vectors @ vectors.mean(axis=0)
    chosen = [int(np.argmax(best))]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(clusters, len(vectors)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(iterations):
        owner = np.argmax(vectors @ centroids.T, axis=1)
        for k in range(len(centroids)):
            members = vectors[owner == k]
            if len(members):
                mean = members.mean(axis=0)
                centroids[k] = mean / max(np.linalg.norm(mean), 1e-12)
    return centroids


def letter_starts(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of each letter."""
    return _LETTER[data] & ((data & 0xC0) != 0x80)


def letter_counts(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(pc.utf8_lower(column))
    return np.array(
        [letter_starts(data[a:b]).sum() for a, b in zip(offsets, offsets[1:])], np.int64
    )


def first_letters(column: pa.Array, letters: int) -> pa.Array:
    """Each text up to its letter number ``letters``, counted from 1, and what follows that one."""
    data, offsets = utf8(column)
    out = []
    for lo, hi in zip(offsets, offsets[1:]):
        at = np.flatnonzero(letter_starts(data[lo:hi] | 0x20))
        end = lo + at[letters] if len(at) > letters else hi
        out.append(data[lo:end].tobytes().decode())
    return pa.array(out, pa.string())


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # one for each centroid
    centroids: np.ndarray
    idf: np.ndarray
    bars: np.ndarray | None = None  # least cosine by level (0: below all) and centroid

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, cosine, level and least cosine of each text."""
        names, scores, levels, least = [], [], [], []
        letters = letter_counts(column)
        for start, counts in gram_counts(column):
            evidence = np.minimum(letters[start : start + len(counts)], (counts > 0).sum(axis=1))
            level = np.searchsorted(LEVELS, evidence, "right")
            levels.append(level)
            if not len(self.languages):
                names += [UNKNOWN] * len(counts)
                scores.append(np.zeros(len(counts)))
                least.append(np.zeros(len(counts)))
                continue
            cosines = weigh(counts, self.idf) @ self.centroids.T
            best = np.argmax(cosines, axis=1)
            names += [self.languages[i] for i in best]
            scores.append(np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(float))
            least.append(np.zeros(len(best)) if self.bars is None else self.bars[level, best])
        parts = (np.concatenate(x) if x else np.empty(0) for x in (scores, levels, least))
        return names, *parts


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each gram bucket occurs, over all rows, and the number of rows."""

    def run(batches):
        seen, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for _, counts in gram_counts(batch.column(0)):
                seen += (counts > 0).sum(axis=0)
                rows += len(counts)
        yield pa.RecordBatch.from_pydict({"i": [*range(DIMENSIONS), -1], "df": [*seen, rows]})

    found = texts.mapInArrow(run, "i bigint, df bigint").groupBy("i").agg(F.sum("df").alias("df"))
    frequencies, rows = np.zeros(DIMENSIONS), 0
    for i, count in found.collect():  # DIMENSIONS + 1 rows
        if i < 0:
            rows = count
        else:
            frequencies[i] = count
    return frequencies, rows


def learned_bars(known: DataFrame, model: LanguageModel, low: float) -> np.ndarray:
    """``model.bars`` from all rows of ``text, lang``; a level no row reaches has the bar below it."""
    shared = known.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts, langs = part.column(0), part.column(1).to_pylist()
                _, scores, levels, _ = shared.value.predict(texts)
                found = Counter(zip(langs, levels.tolist(), (scores * STEPS).astype(int).tolist()))
                for level, letters in enumerate(LEVELS, 1):
                    rows = np.flatnonzero(levels >= level)
                    cut = first_letters(texts.take(pa.array(rows)), letters)
                    steps = (shared.value.predict(cut)[1] * STEPS).astype(int).tolist()
                    found.update((langs[i], level, step) for i, step in zip(rows, steps))
                rows = [(*key, n) for key, n in found.items() if key[1]]
                names = ("lang", "level", "step", "n")
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], HISTOGRAM)

    counted = known.select("text", "lang").mapInArrow(
        run, "lang string, level bigint, step bigint, n bigint"
    )
    steps: dict[tuple[str, int], np.ndarray] = {}
    # At most STEPS + 1 rows for each language and level.
    for r in counted.groupBy("lang", "level", "step").agg(F.sum("n").alias("n")).collect():
        own = steps.setdefault((r["lang"], r["level"]), np.zeros(STEPS + 1, np.int64))
        own[r["step"]] += r["n"]
    bars = np.zeros((len(LEVELS) + 1, len(model.languages)))
    for i, lang in enumerate(model.languages):
        for level in range(1, len(LEVELS) + 1):
            bars[level, i] = bars[level - 1, i]
            if (lang, level) in steps:
                total = np.cumsum(steps[lang, level])
                bars[level, i] = np.searchsorted(total, low * total[-1], "right") / STEPS
    bars[1] *= SHORT_SHARE
    return bars


def fit(
    docs: DataFrame, sample_rows: int = SAMPLE_ROWS, clusters: int = CLUSTERS
) -> LanguageModel:
    """Learn from the rows of ``doc_id, text, lang`` that are not held out and have a language."""
    known = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    frequencies, rows = document_frequencies(known.select("text"))
    idf = (np.log((1 + rows) / (1 + frequencies)) + 1).astype(np.float32)

    sizes = known.groupBy("lang").count().collect()  # one row for each language
    share = F.lit(0.0)
    for lang, count in sizes:
        share = F.when(F.col("lang") == lang, min(1.0, sample_rows / count)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000.0
    sample = known.where(draw < share)

    def cluster(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"]).head(2 * sample_rows)
        blocks = [weigh(c, idf) for _, c in gram_counts(pa.array(group["text"], pa.string()))]
        vectors = np.concatenate(blocks)
        vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
        if not len(vectors):
            return pd.DataFrame({"lang": [], "centroid": []})
        found = spherical_kmeans(vectors, clusters, ITERATIONS)
        return pd.DataFrame({"lang": [key[0]] * len(found), "centroid": [*map(list, found)]})

    fitted = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>")
    found = sorted(fitted.collect(), key=lambda r: (r["lang"], list(r["centroid"])))
    model = LanguageModel(
        [r["lang"] for r in found],
        np.array([r["centroid"] for r in found], np.float32).reshape(-1, DIMENSIONS),
        idf,
    )
    return replace(model, bars=learned_bars(known, model, LOW)) if found else model


def identify(
    docs: DataFrame, model: LanguageModel, max_distance: float = MAX_DISTANCE
) -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``; the ``text`` column alone decides.

    A null text or one without a letter is ``und`` with score 0 and rejected. Any other text gets
    the nearest centroid's language; it is rejected where its cosine is below the bar of that
    language for texts with as much evidence, or its distance 1 - cosine exceeds ``max_distance``. Ties go to the first language by name. Other columns pass through, those with
    the names of the results are replaced; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB, see DIMENSIONS

    def compute(batch):
        column = batch.column(batch.schema.get_field_index("text"))
        names, scores, _, least = shared.value.predict(column)
        letters = [t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()]
        names = [name if ok else UNKNOWN for name, ok in zip(names, letters, strict=True)]
        scores = np.where(letters, scores, 0.0)
        far = ~np.array(letters, bool) | (1 - scores > max_distance) | (scores < least)
        return pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far)

    fields = ["lang_pred string", "score double", "rejected boolean"]
    return with_arrow_columns(docs, compute, fields)


@query("op3_language_id")
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )

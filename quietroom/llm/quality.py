"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and word hashes of whole texts. Trees are grown level by level from
histograms of quantile bins over a bounded sample of labelled rows, with logistic loss, and kept as
flat arrays: a complete binary tree per row, so that scoring steps a whole batch down one level at
a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.llm.base import held_out, query, table, with_arrow_columns
from quietroom.llm.words import utf8, word_hashes

# At most about so many labelled rows take part in the fit; they are sent to all executors.
SAMPLE_ROWS = 20_000
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
PENALTY = 1.0

CLASSES = ["upper", "lower", "digit", "space", "newline", "stop", "mark", "symbol", "beyond"]
STATISTICS = [
    "log_bytes",
    "log_words",
    *[f"share_{name}" for name in CLASSES],
    "mean_word",
    "distinct_words",
    "repeated_words",
    "repeated_symbols",
    "words_per_line",
]

_CLASS = np.full(256, CLASSES.index("symbol"))
_CLASS[65:91] = CLASSES.index("upper")
_CLASS[97:123] = CLASSES.index("lower")
_CLASS[48:58] = CLASSES.index("digit")
_CLASS[[9, 11, 12, 13, 32]] = CLASSES.index("space")
_CLASS[10] = CLASSES.index("newline")
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = CLASSES.index("stop")
_CLASS[[ord(c) for c in "!?"]] = CLASSES.index("mark")
_CLASS[128:] = CLASSES.index("beyond")
_CLASS = _CLASS.astype(np.uint8)
SLICE = 1 << 20


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; a null or empty text is all zeros."""
    data, offsets = utf8(column)
    words, ends = word_hashes(column)
    rows = np.zeros((len(column), len(STATISTICS)))
    for i in range(len(column)):
        size, own = int(offsets[i + 1] - offsets[i]), words[ends[i] : ends[i + 1]]
        if not size:
            continue
        counts, runs = np.zeros(len(CLASSES), np.int64), 0
        for at in range(int(offsets[i]), int(offsets[i + 1]), SLICE):
            piece = data[at : min(at + SLICE, int(offsets[i + 1]))]
            kinds = _CLASS[piece]
            counts += np.bincount(kinds, minlength=len(CLASSES))
            signs = kinds[1:] >= CLASSES.index("mark")
            runs += int(((piece[1:] == piece[:-1]) & signs).sum())
        n = len(own)
        solid = size - counts[CLASSES.index("space")] - counts[CLASSES.index("newline")]
        rows[i] = [
            np.log1p(size),
            np.log1p(n),
            *(counts / size),
            solid / max(n, 1),
            len(np.unique(own)) / max(n, 1),
            (own[1:] == own[:-1]).sum() / max(n, 1),
            runs / size,
            n / (counts[CLASSES.index("newline")] + 1),
        ]
    return rows


@dataclass(frozen=True)
class Forest:
    """``trees`` complete binary trees; node i has children 2i + 1 and 2i + 2, leaves come last."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; values above it go right
    value: np.ndarray  # trees x leaves

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        at = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(
            self.feature, self.threshold, self.value, strict=True
        ):
            node = np.zeros(len(rows), np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (rows[at, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(rows: np.ndarray, target: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost ``trees`` trees of ``depth`` levels on rows of statistics and 0/1 targets."""
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    if not len(rows):
        return Forest(0.0, feature, threshold, value)
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    width = rows.shape[1]
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = [np.unique(np.quantile(rows[:, f], quantiles)) for f in range(width)]
    # bin b of a feature holds the values in (cuts[b - 1], cuts[b]]
    binned = np.stack(
        [np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], axis=1
    )
    total = np.full(len(rows), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = target - p, p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            place = node - first
            best = np.zeros(n)
            for f, c in enumerate(cuts):
                key = place * BINS + binned[:, f]
                g = np.bincount(key, slope, n * BINS).reshape(n, BINS)
                h = np.bincount(key, curve, n * BINS).reshape(n, BINS)
                gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                gain = gl**2 / (hl + PENALTY) + gr**2 / (hr + PENALTY)
                gain -= gl[:, -1:] ** 2 / (hl[:, -1:] + PENALTY)
                gain = gain[:, : len(c)]
                if not gain.size:
                    continue
                cut = np.argmax(gain, axis=1)
                found = gain[np.arange(n), cut]
                better = np.flatnonzero(found > best + 1e-9)
                best[better] = found[better]
                feature[t, first + better] = f
                threshold[t, first + better] = c[cut[better]]
            right = rows[np.arange(len(rows)), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        g = np.bincount(leaf, slope, leaves)
        h = np.bincount(leaf, curve, leaves)
        value[t] = RATE * g / (h + PENALTY)
        total += value[t][leaf]
    return Forest(start, feature, threshold, value)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Learn ``quality`` of the rows of ``labels`` that are not held out, from the texts of ``docs``.

    A label counts as 1 if it is 1, as 0 otherwise; null labels and labels without a text row are
    left out. More than ``sample_rows`` labels are thinned by a hash of the id.
    """
    known = labels.where(~held_out() & F.expr("quality IS NOT NULL AND doc_id IS NOT NULL"))
    known = known.select("doc_id", (F.col("quality") == 1).cast("double").alias("target"))
    share = min(1.0, sample_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) / 1_000_000.0
    sample = known.where(draw < share)  # so many rows of 16 bytes: small enough to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def compute(batch):
        rows = statistics(batch.column(batch.schema.get_field_index("text")))
        return [pa.array(list(rows), pa.list_(pa.float64()))]

    found = with_arrow_columns(texts, compute, ["statistics array<double>"])
    rows = found.select("doc_id", "statistics", "target").orderBy("doc_id", "statistics").collect()
    shape = (len(rows), len(STATISTICS))
    return grow(
        np.array([r["statistics"] for r in rows]).reshape(shape),
        np.array([r["target"] for r in rows]),
    )


def quality_scores(docs: DataFrame, forest: Forest) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from 0.5 on).

    Only ``text`` decides. Null and empty texts have all statistics 0 and are scored like others.
    Other columns pass through, those with the names of the results are replaced; an empty table
    gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # TREES x 2^DEPTH numbers

    def compute(batch):
        rows = statistics(batch.column(batch.schema.get_field_index("text")))
        scores = shared.value.scores(rows)
        return pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))

    return with_arrow_columns(docs, compute, ["score double", "predicted int"])


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    forest = fit(docs, table(spark, folder, "labels"))
    return quality_scores(docs, forest).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted"
    )

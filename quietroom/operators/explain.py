"""Word-drop explanations of any scorer, for a batch of comments.

Every comment is scored with random subsets of its words removed, and a weighted
linear model on the subsets gives each word a weight per label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietroom.functions.text import WORD
from quietroom.settings import EXPLAIN_FEATURES, EXPLAIN_SAMPLES, SEED

# Fixed values of the published method.
KERNEL_WIDTH = 25.0
DISTANCE_SCALE = 100.0
SELECT_ALPHA = 0.01
FIT_ALPHA = 1.0
# Comments of a task that makes their variants: these are what takes time, not the texts.
COMMENTS_PER_TASK = 200


def _draw(word: Column, key: Column, sample: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key, sample, word)


def _limit(draws: Column, key: Column, sample: Column, seed: int) -> Column:
    """The largest draw that is still dropped in this sample.

    The number of dropped words is uniform on 1..D and the words with the smallest
    draws go, which is a uniform subset of that size. Sample 0 keeps every word.
    """
    drops = F.pmod(F.xxhash64(F.lit(seed), key, sample), F.size(draws)).cast("int") + 1
    # In compiled code; array_sort calls a comparator for each pair.
    return F.when(
        (sample > 0) & (F.size(draws) > 0), F.element_at(F.sort_array(draws), drops)
    )


def perturb(
    df: DataFrame,
    key: str = "id",
    text: str = "comment_text",
    samples: int = EXPLAIN_SAMPLES,
    seed: int = SEED,
) -> DataFrame:
    """``key, sample, text, words, mask`` with ``samples`` variants per comment.

    ``mask`` has a 0 or 1 for each distinct word of the comment, whether the variant keeps it;
    ``words`` has those words in sample 0 and is NULL in the others.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = df.select(
        F.col(key),
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_words"),
        F.split(body, WORD).alias("_gaps"),
    ).withColumn("words", F.array_distinct("_words"))
    k, s = F.col(key), F.col("sample")
    sampled = (
        split.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("_draws", F.transform("words", lambda w: _draw(w, k, s, seed)))
        .withColumn("limit", _limit(F.col("_draws"), k, s, seed))
    )
    limit = F.col("limit")
    flags = F.transform("_draws", lambda d: F.when(limit.isNull() | (d > limit), "1").otherwise("0"))
    left = F.transform(
        "_words",
        lambda w: F.when(limit.isNull() | (_draw(w, k, s, seed) > limit), w).otherwise(""),
    )
    pieces = F.zip_with(
        "_gaps", left, lambda g, w: F.concat(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit("")))
    )
    return sampled.select(
        key,
        "sample",
        F.array_join(pieces, "").alias(text),
        F.when(s == 0, F.col("words")).alias("words"),
        F.array_join(flags, "").alias("mask"),
    )


def scored_variants(
    df: DataFrame,
    scorer,
    key: str = "id",
    text: str = "comment_text",
    samples: int = EXPLAIN_SAMPLES,
    seed: int = SEED,
) -> DataFrame:
    """``key, sample, prob, words, mask`` of the variants of every comment that has a word.

    Comments are dealt by their key to as many tasks as their number asks for, however few files they
    come in. Grouping variants by key then needs no shuffle, unless the scorer runs in Python.
    """
    # Before the variants are made: above them the filter would draw every mask a second time.
    worded = df.select(key, text).where(F.col(text).rlike(WORD))
    tasks = max(1, -(-worded.count() // COMMENTS_PER_TASK))
    variants = perturb(worded.repartition(tasks, key), key, text, samples, seed)
    return scorer.score(variants, text=text).select(key, "sample", "prob", "words", "mask")


def _ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """Weighted ridge coefficients with a free intercept, solved over the samples."""
    share = w / w.sum()
    xc = (x - share @ x) * np.sqrt(w)[:, None]
    yc = (y - share @ y) * np.sqrt(w)[:, None]
    return xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(len(w)), yc)


def kernel_weights(mask: np.ndarray) -> np.ndarray:
    """How much each variant counts, by the share of words it keeps."""
    kept = mask.sum(axis=1)
    distance = (1.0 - np.sqrt(kept / mask.shape[1])) * DISTANCE_SCALE
    return np.sqrt(np.exp(-(distance**2) / KERNEL_WIDTH**2))


def _explain_one(mask: np.ndarray, probs: np.ndarray, features: int):
    """Per label: (word positions, weights), strongest first."""
    weight = kernel_weights(mask)
    first = _ridge(mask, probs, weight, SELECT_ALPHA)
    for label in range(probs.shape[1]):
        order = np.argsort(-np.abs(first[:, label]), kind="stable")[:features]
        fitted = _ridge(mask[:, order], probs[:, [label]], weight, FIT_ALPHA)[:, 0]
        place = np.argsort(-np.abs(fitted), kind="stable")
        yield order[place], fitted[place]


def explain(
    df: DataFrame,
    scorer,
    key: str = "id",
    text: str = "comment_text",
    features: int = EXPLAIN_FEATURES,
    samples: int = EXPLAIN_SAMPLES,
    seed: int = SEED,
    variants: DataFrame | None = None,
) -> DataFrame:
    """``key, label, token, weight, rank``: the strongest words per comment and label.

    Comments travel once, before their variants are made and scored; each comment's ``samples``
    rows are solved together. A comment without words has no rows. ``variants`` are those that
    ``scored_variants`` gives for the same arguments, where they are stored already.
    """
    labels = list(scorer.labels)
    scored = scored_variants(df, scorer, key, text, samples, seed) if variants is None else variants

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        flags = np.frombuffer("".join(pdf["mask"]).encode(), np.uint8) == ord("1")
        mask = flags.reshape(len(pdf), -1).astype(np.float64)
        probs = np.stack(pdf["prob"].to_numpy()).astype(np.float64)
        names = pdf["words"].iloc[0]
        out = []
        for label, (where, weights) in zip(labels, _explain_one(mask, probs, features)):
            for rank, (at, weight) in enumerate(zip(where, weights), start=1):
                out.append((pdf[key].iloc[0], label, names[at], float(weight), rank))
        return pd.DataFrame(out, columns=[key, "label", "token", "weight", "rank"])

    kind = df.schema[key].dataType.simpleString()
    return scored.groupBy(key).applyInPandas(
        solve, f"{key} {kind}, label string, token string, weight double, rank int"
    )


def fidelity(
    explanations: DataFrame,
    df: DataFrame,
    scorer,
    key: str = "id",
    text: str = "comment_text",
    samples: int = EXPLAIN_SAMPLES,
    seed: int = SEED,
    variants: DataFrame | None = None,
) -> DataFrame:
    """``key, label, slope, r2`` of each explanation by ``explain`` of the same rows and options.

    The weights are put back into the local model they come from. Of a ridge fit, the
    kernel-weighted residuals are orthogonal to every word's column but for the ridge term: ``slope``
    is the largest absolute difference from that, next to nothing for a true fit. ``r2`` is the
    weighted share of the variants' variance that the words explain; NULL where scores do not vary.
    ``variants`` as in ``explain``.
    """
    labels = list(scorer.labels)
    scored = scored_variants(df, scorer, key, text, samples, seed) if variants is None else variants

    def check(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one) and len(two):
            one = one.sort_values("sample")
            flags = np.frombuffer("".join(one["mask"]).encode(), np.uint8) == ord("1")
            mask = flags.reshape(len(one), -1).astype(np.float64)
            probs = np.stack(one["prob"].to_numpy()).astype(np.float64)
            weight = kernel_weights(mask)
            place = {word: i for i, word in enumerate(one["words"].iloc[0])}
            share = weight / weight.sum()
            for label, found in two.groupby("label"):
                x = mask[:, [place[t] for t in found["token"]]]
                y, beta = probs[:, labels.index(label)], found["weight"].to_numpy()
                centred, level = x - share @ x, y - share @ y
                rest = level - centred @ beta
                slope = np.abs(centred.T @ (weight * rest) - FIT_ALPHA * beta).max()
                spread = share @ level**2
                r2 = 1 - (share @ rest**2) / spread if spread > 1e-18 else None
                out.append((one[key].iloc[0], label, float(slope), r2))
        return pd.DataFrame(out, columns=[key, "label", "slope", "r2"])

    kind = df.schema[key].dataType.simpleString()
    return scored.groupBy(key).cogroup(explanations.groupBy(key)).applyInPandas(
        check, f"{key} {kind}, label string, slope double, r2 double"
    )

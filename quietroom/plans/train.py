"""Training jobs: split, fit, report, keep the best."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.functions.text import clean_text
from quietroom.operators.losses import row_loss
from quietroom.operators.metrics import classification_report
from quietroom.operators.profile import pos_weights
from quietroom.operators.split import hash_split
from quietroom.operators.tfidf import (
    FittedVocabulary,
    terms_of_tokens,
    tfidf_stages,
    with_terms,
    with_tokens,
)
from quietroom.plans.scorers import Scorer, TfidfScorer, fit, fit_penalties
from quietroom.session import materialize
from quietroom.settings import MAX_FEATURES


@dataclass
class Trained:
    scorer: Scorer
    report: DataFrame


def predict_over_half(scored: DataFrame) -> DataFrame:
    """0/1 predictions of the linear tiers: strictly above one half."""
    return scored.withColumn(
        "pred", F.transform("prob", lambda p: (p > F.lit(0.5)).cast("int"))
    )


def train(
    comments: DataFrame,
    labels: list[str],
    tier: str = "tier1",
    save_to: str | None = None,
    **options,
) -> Trained:
    """Clean, split 80/20 by key, fit on the train part, report on the rest."""
    prepared = comments.select(
        "id", clean_text(F.col("comment_text")).alias("comment_text"), *labels
    ).withColumn("split", hash_split(F.col("id")))
    scorer = fit(prepared.where("split = 'train'"), labels, tier, **options)
    rest = prepared.where("split = 'test'")
    report = classification_report(predict_over_half(scorer.scored(rest)), labels)
    if save_to is not None:
        scorer.save(comments.sparkSession, save_to)
    return Trained(scorer, report)


def best_candidate(losses: DataFrame) -> DataFrame:
    """The candidate of lowest loss from ``candidate, seq, val_loss``; the earliest of equals."""
    usable = losses.where(F.col("val_loss").isNotNull() & ~F.isnan("val_loss"))
    order = F.struct("val_loss", "seq")
    return usable.agg(
        F.min_by("candidate", order).alias("candidate"), F.min("val_loss").alias("val_loss")
    )


def save_best(scorers: dict[str, Scorer], losses: DataFrame, path: str) -> str | None:
    """Store the scorer that ``best_candidate`` names; None when no loss is usable."""
    name = best_candidate(losses).first()["candidate"]
    if name is not None:
        scorers[name].save(losses.sparkSession, path)
    return name


@dataclass
class Candidates:
    """Scorers fitted with different penalties, and ``candidate, seq, val_loss`` of each."""

    scorers: dict[str, TfidfScorer]
    losses: DataFrame

    def keep_best(self, spark: SparkSession, path: str) -> str | None:
        """Save the scorer of the lowest loss, the earliest of equals, and name it."""
        return save_best(self.scorers, self.losses, path)


def fit_candidates(
    train_rows: DataFrame,
    validation: DataFrame,
    labels: list[str],
    penalties: dict[str, float],
    text: str = "comment_text",
    max_features: int = MAX_FEATURES,
    max_iter: int = 100,
    clean: bool = True,
    partitions: int | None = None,
) -> Candidates:
    """Fit tier 1 once per named penalty and measure the loss of each on ``validation``.

    Vocabulary and features are made once for all candidates. Their coefficients are one matrix,
    with a column for each candidate and label, so the validation texts are read in a single pass.
    The loss is the mean cross entropy with positives weighted as in the training rows; no rows
    give NULL losses, which are never best.
    """
    spark = train_rows.sparkSession
    tokens = with_tokens(train_rows.select(text, *labels), text, clean).drop(text)
    tokens = materialize(tokens, "tokens")
    stages = tfidf_stages(FittedVocabulary.fit_tokens(tokens, limit=max_features))
    fitted = fit_penalties(
        stages.transform(terms_of_tokens(tokens)), labels, list(penalties.values()), max_iter, partitions=partitions
    )
    scorers = {
        name: TfidfScorer(labels, stages, models, clean)
        for name, models in zip(penalties, fitted, strict=True)
    }
    models = [model for each in fitted for model in each]
    matrix = np.stack([model.coefficients.toArray() for model in models], axis=1)
    shared = spark.sparkContext.broadcast(matrix)  # max_features rows of a few numbers
    raw = F.unwrap_udt(F.col("features"))
    margins = _margins(shared, np.array([m.intercept for m in models]), raw["indices"], raw["values"])
    held = stages.transform(with_terms(validation.select(text, *labels), text, clean))
    scored = held.select(margins.alias("margins"), *labels)
    weights = {r["label"]: r["pos_weight"] for r in pos_weights(train_rows, labels).collect()}
    losses = []
    for at in range(len(scorers)):
        logits = [F.col("margins")[at * len(labels) + i] for i in range(len(labels))]
        targets = [F.col(c) for c in labels]
        losses.append(row_loss(logits, targets, [F.lit(float(weights[c])) for c in labels]))
    found = scored.agg(F.array(*[F.avg(x) for x in losses]).alias("losses"))
    names = F.array(*[F.lit(name) for name in scorers])
    rows = found.select(F.posexplode(F.arrays_zip(names.alias("candidate"), "losses")).alias("seq", "_e"))
    return Candidates(
        scorers,
        materialize(
            rows.select("_e.candidate", "seq", F.col("_e.losses").alias("val_loss")),
            "validation-losses",
        ),
    )


def _margins(matrix, intercepts: np.ndarray, indices: Column, values: Column) -> Column:
    """Dot products of sparse rows with each column of a broadcast matrix, plus the intercepts."""

    @F.pandas_udf("array<double>")
    def margins(index: pd.Series, value: pd.Series) -> pd.Series:
        sizes = np.array([len(i) for i in index], dtype=np.int64)
        out = np.tile(intercepts, (len(index), 1))
        held = np.flatnonzero(sizes)
        if len(held):
            rows = matrix.value[np.concatenate(index.to_list()).astype(np.int64)]
            products = rows * np.concatenate(value.to_list())[:, None]
            out[held] += np.add.reduceat(products, (np.cumsum(sizes) - sizes)[held], axis=0)
        return pd.Series(list(out))

    return margins(indices, values)

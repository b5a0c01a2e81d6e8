"""One scorer interface over three tiers of models.

A scorer adds ``prob ARRAY<DOUBLE>`` in label order to any table with a text
column, batch or streaming, without a shuffle.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles, StorageLevel, cloudpickle, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, Word2Vec
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietroom.functions.hashing import digest, digest_number
from quietroom.functions.scores import sigmoid
from quietroom.functions.text import clean_text, token_text, word_tokens
from quietroom.operators.optimality import certificate, objective_gradients
from quietroom.operators.pooling import pool_counts, pool_terms
from quietroom.operators.profile import balanced_weights
from quietroom.operators.reshape import label_values
from quietroom.operators.tfidf import (
    FittedVocabulary,
    terms_of_tokens,
    tfidf_stages,
    vector_entries,
    with_terms,
    with_tokens,
)
from quietroom.operators.vocabulary import corpus_counts, most_frequent
from quietroom.session import materialize, write_bytes
from quietroom.settings import MAX_FEATURES, SEED


VECTOR_SIZE = 300
# Word2Vec averages the vectors of so many partitions; the fitted model depends on the number.
W2V_PARTITIONS = 8
# Beyond so many words in each, Word2Vec gets more partitions: its tasks stay as long whatever the input.
W2V_WORDS = 4_000_000


class Scorer:
    """Texts in, one probability per label out."""

    labels: list[str]

    def score(self, df: DataFrame, text: str = "comment_text") -> DataFrame:
        raise NotImplementedError

    def scored(self, df: DataFrame, key: str = "id", text: str = "comment_text") -> DataFrame:
        """``key, prob`` plus ``y`` when all label columns are present."""
        out = self.score(df, text)
        cols = [F.col(key), F.col("prob")]
        if set(self.labels) <= set(df.columns):
            cols.append(label_values(self.labels).alias("y"))
        return out.select(*cols)


def _probabilities(
    models: list[LogisticRegressionModel], df: DataFrame, predictions: str | None = None
) -> DataFrame:
    """Add ``prob``, and the library's own 0/1 predictions under the name asked for."""
    for i, model in enumerate(models):
        df = model.transform(df)
    if predictions:
        own = [F.col(f"_d{i}").cast("int") for i in range(len(models))]
        df = df.withColumn(predictions, F.array(*own))
    probs = [vector_to_array(f"_p{i}")[1] for i in range(len(models))]
    extra = [f"_{kind}{i}" for kind in ("p", "r", "d") for i in range(len(models))]
    return df.withColumn("prob", F.array(*probs)).drop(*extra)


def fit_penalties(
    featured: DataFrame,
    labels: list[str],
    penalties: list[float],
    max_iter: int = 100,
    parallelism: int = 4,
    partitions: int | None = None,
) -> list[list[LogisticRegressionModel]]:
    """For each penalty one balanced binary logistic regression per label, over shared features.

    The per-row weights sum to the row count, so a penalty of 1 equals C = 1 of the
    usual summed loss. ``partitions`` merges those of the input for the iterations.
    """
    featured = featured.select("features", *labels)
    if partitions:
        featured = featured.coalesce(partitions)
    featured = featured.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = class_weights(featured, labels)
        n = featured.count()

        def fit(job: tuple[float, int]) -> LogisticRegressionModel:
            penalty, i = job
            per_class = weights[labels[i]]
            total = n if len(per_class) == 2 else n * sum(per_class.values())
            lr = LogisticRegression(
                labelCol="_y",
                weightCol="_w",
                regParam=penalty / max(total, 1),
                standardization=False,
                maxIter=max_iter,
                probabilityCol=f"_p{i}",
                rawPredictionCol=f"_r{i}",
                predictionCol=f"_d{i}",
            )
            rows = featured.select(
                "features",
                F.col(labels[i]).cast("double").alias("_y"),
                class_weight(labels[i], per_class).alias("_w"),
            )
            return lr.fit(rows)

        jobs = [(penalty, i) for penalty in penalties for i in range(len(labels))]
        with ThreadPoolExecutor(max_workers=min(parallelism, len(jobs))) as pool:
            spark = featured.sparkSession
            models = list(pool.map(inheritable_thread_target(spark)(fit), jobs))
        return [models[at : at + len(labels)] for at in range(0, len(models), len(labels))]
    finally:
        featured.unpersist()


def fit_label_models(
    featured: DataFrame, labels: list[str], max_iter: int = 100, partitions: int | None = None
) -> list[LogisticRegressionModel]:
    return fit_penalties(featured, labels, [1.0], max_iter, partitions=partitions)[0]


def class_weights(rows: DataFrame, labels: list[str]) -> dict[str, dict[int, float]]:
    """The balanced weight of each label's classes; two rows per label column are collected."""
    weights: dict[str, dict[int, float]] = {name: {} for name in labels}
    for row in balanced_weights(rows, labels).collect():
        weights[row["label"]][row["y"]] = row["weight"]
    return weights


def class_weight(label: str, per_class: dict[int, float]) -> Column:
    return F.when(F.col(label) == 1, F.lit(per_class.get(1, 1.0))).otherwise(
        F.lit(per_class.get(0, 1.0))
    )


def _frequent_words(tokens: DataFrame, limit: int) -> tuple[list[str], int]:
    """At most ``limit`` of the most frequent words, by rank, and the count of the last.

    Words as frequent as the first one that is left out are left out too, so that the count tells
    kept words from others; unless nothing would be left.
    """
    rows = most_frequent(corpus_counts(tokens, F.col("terms")), limit + 1).orderBy("idx").collect()
    if not rows:
        raise ValueError("no words in the fitted texts")
    least = rows[-1]["tf"] + 1 if len(rows) > limit and rows[0]["tf"] > rows[-1]["tf"] else 1
    kept = [r for r in rows[:limit] if r["tf"] >= least]
    return [r["term"] for r in kept], kept[-1]["tf"]


def _w2v_partitions(tokens: DataFrame, least: int, words: int = W2V_WORDS) -> int:
    """As many as give each about ``words`` words, and ``least`` at least."""
    return max(least, -(-(tokens.agg(F.sum(F.size("terms"))).first()[0] or 0) // words))


def _tokens(df: DataFrame, text: str, clean: bool) -> DataFrame:
    body = token_text(F.col(text)) if clean else F.lower(F.coalesce(text, F.lit("")))
    return df.withColumn("terms", word_tokens(body))


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def _read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


@dataclass
class TfidfScorer(Scorer):
    """Tier 1: TF-IDF over 1-2-grams and one logistic regression per label."""

    labels: list[str]
    features: PipelineModel
    models: list[LogisticRegressionModel]
    clean: bool = True

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        labels: list[str],
        text: str = "comment_text",
        max_features: int = MAX_FEATURES,
        max_iter: int = 100,
        clean: bool = True,
        partitions: int | None = None,
    ) -> TfidfScorer:
        """Fit on ``text`` and ``labels``; the input is stored once and read by every pass."""
        tokens = materialize(with_tokens(train.select(text, *labels), text, clean).drop(text), "tokens")
        stages = tfidf_stages(FittedVocabulary.fit_tokens(tokens, limit=max_features))
        models = fit_label_models(
            stages.transform(terms_of_tokens(tokens)), labels, max_iter, partitions=partitions
        )
        return cls(labels, stages, models, clean)

    @property
    def vocabulary(self) -> list[str]:
        return self.features.stages[0].vocabulary

    def coefficients(self) -> dict[str, list[float]]:
        return {
            name: [float(v) for v in model.coefficients.toArray()]
            for name, model in zip(self.labels, self.models)
        }

    def intercepts(self) -> list[float]:
        return [float(model.intercept) for model in self.models]

    def optimality(self, train: DataFrame, text: str = "comment_text") -> DataFrame:
        """How near each label's model is to the optimum on the rows it was fitted on.

        ``label, n_features, max_gradient, intercept_gradient, gap`` of the mean weighted loss with
        its penalty; see ``operators.optimality``.
        """
        rows = self.features.transform(with_terms(train.select(text, *self.labels), text, self.clean))
        weights = class_weights(train, self.labels)
        kept, total = [], []
        for i, name in enumerate(self.labels):
            weight = class_weight(name, weights[name])
            kept.append((weight * (F.col("prob")[i] - F.col(name))).alias(f"_g{i}"))
            total += [F.sum(weight).alias(f"_w{i}"), F.sum(f"_g{i}").alias(f"_b{i}")]
        scored = _probabilities(self.models, rows).select("*", *kept)
        totals = materialize(scored.agg(*total), "residual-totals")
        residuals = [f"_g{i}" for i in range(len(self.labels))]
        entries = scored.select(*residuals, F.inline(vector_entries("features")))
        table = train.sparkSession.createDataFrame(
            [(i, *map(float, row)) for i, row in enumerate(zip(*self.coefficients().values()))],
            "idx int, " + ", ".join(f"`{c}` double" for c in self.labels),
        )
        penalties = [model.getOrDefault("regParam") for model in self.models]
        gradients = objective_gradients(entries, totals, table, self.labels, penalties)
        means = [
            F.struct(F.lit(c).alias("label"), (F.col(f"_b{i}") / F.col(f"_w{i}")).alias("intercept_gradient"))
            for i, c in enumerate(self.labels)
        ]
        found = certificate(gradients, dict(zip(self.labels, penalties, strict=True)))
        return found.join(totals.select(F.inline(F.array(*means))), "label").select(
            "label", "n_features", "max_gradient", "intercept_gradient", "gap"
        )

    def tfidf(self, df: DataFrame, key: str = "id", text: str = "comment_text") -> DataFrame:
        """``key, term, tfidf`` of the terms that the models see."""
        featured = self.features.transform(with_terms(df.select(key, text), text, self.clean))
        entries = featured.select(key, F.inline(vector_entries("features")))
        names = df.sparkSession.createDataFrame(
            list(enumerate(self.vocabulary)), "idx int, term string"
        )
        return entries.join(names, "idx").select(key, "term", F.col("value").alias("tfidf"))

    def score(
        self, df: DataFrame, text: str = "comment_text", predictions: str | None = None
    ) -> DataFrame:
        featured = self.features.transform(with_terms(df, text, self.clean))
        return _probabilities(self.models, featured, predictions).drop(
            "terms", "counts", "weighted", "features"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        whole = PipelineModel([*self.features.stages, *self.models])
        whole.write().overwrite().save(f"{path}/model")
        _write_meta(spark, f"{path}/meta", {"tier": "tier1", "labels": self.labels, "clean": self.clean})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfScorer:
        meta = _read_meta(spark, f"{path}/meta")
        stages = PipelineModel.load(f"{path}/model").stages
        cut = len(stages) - len(meta["labels"])
        return cls(meta["labels"], PipelineModel(stages[:cut]), stages[cut:], meta["clean"])


@dataclass
class PooledScorer(Scorer):
    """Tier 2: learned word vectors, mean and max pooling, logistic regression per label."""

    labels: list[str]
    counts: CountVectorizerModel
    matrix: np.ndarray
    models: list[LogisticRegressionModel]
    clean: bool = True

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        labels: list[str],
        text: str = "comment_text",
        vector_size: int = VECTOR_SIZE,
        max_words: int = MAX_FEATURES,
        max_iter: int = 100,
        w2v_partitions: int = W2V_PARTITIONS,
        w2v_passes: int = 1,
        clean: bool = True,
        partitions: int | None = None,
        seed: int = SEED,
    ) -> PooledScorer:
        """Fit on ``text`` and ``labels``.

        Training leaves out words rarer than the last of the ``max_words`` kept ones; the table of
        vectors has ``max_words`` rows of ``vector_size`` numbers.
        """
        spark = train.sparkSession
        tokens = materialize(_tokens(train.select(text, *labels), text, clean).drop(text), "tokens")
        terms, least = _frequent_words(tokens, max_words)
        counts = CountVectorizerModel.from_vocabulary(
            terms, inputCol="terms", outputCol="counts"
        )
        w2v = Word2Vec(
            inputCol="terms",
            outputCol="_w2v",
            vectorSize=vector_size,
            minCount=least,
            numPartitions=_w2v_partitions(tokens, w2v_partitions),
            maxIter=w2v_passes,
            seed=seed,
        ).fit(tokens.select("terms"))
        kept = spark.createDataFrame(list(enumerate(terms)), "idx int, word string")
        matrix = np.zeros((len(terms), vector_size), dtype=np.float32)
        trained = w2v.getVectors().join(kept, "word").collect()  # one row for each kept word
        if len(trained) != len(terms):
            raise RuntimeError(f"{len(terms) - len(trained)} kept words have no vector")
        for row in trained:
            matrix[row["idx"]] = row["vector"].toArray()
        scorer = cls(labels, counts, matrix, [], clean)
        scorer.models = fit_label_models(
            scorer._featured(tokens), labels, max_iter, partitions=partitions
        )
        return scorer

    def _featured(self, tokens: DataFrame) -> DataFrame:
        shared = tokens.sparkSession.sparkContext.broadcast(self.matrix)
        counted = self.counts.transform(tokens)
        raw = F.unwrap_udt(F.col("counts"))
        pooled = pool_counts(shared, raw["indices"], raw["values"])
        return counted.withColumn(
            "features", array_to_vector(pooled.cast("array<double>"))
        ).drop("counts", "terms")

    def score(self, df: DataFrame, text: str = "comment_text") -> DataFrame:
        tokens = _tokens(df, text, self.clean)
        return _probabilities(self.models, self._featured(tokens)).drop("features")

    def vector_table(self, spark: SparkSession) -> DataFrame:
        """``term, vector`` of the kept words."""
        rows = zip(self.counts.vocabulary, self.matrix.tolist(), strict=True)
        return spark.createDataFrame(list(rows), "term string, vector array<float>")

    def score_by_join(
        self,
        df: DataFrame,
        vectors: DataFrame,
        key: str = "id",
        text: str = "comment_text",
    ) -> DataFrame:
        """``key, prob`` with word vectors from a table of any size, by joins on the words.

        ``vectors`` has ``term, vector``. Nothing is broadcast but the models' coefficients. Keys
        are distinct.
        """
        tokens = _tokens(df.select(key, text), text, self.clean).select(key, "terms")
        features = F.col("pooled")
        pooled = pool_terms(tokens, vectors, key, 2 * self.matrix.shape[1])
        probs = []
        for model in self.models:
            weights = F.array(*[F.lit(float(v)) for v in model.coefficients.toArray()])
            products = F.zip_with(features, weights, lambda x, w: x * w)
            margin = F.aggregate(products, F.lit(float(model.intercept)), lambda a, x: a + x)
            probs.append(sigmoid(margin))
        return pooled.select(key, F.array(*probs).alias("prob"))

    def save(self, spark: SparkSession, path: str) -> None:
        PipelineModel([self.counts, *self.models]).write().overwrite().save(f"{path}/model")
        rows = list(enumerate(self.matrix.tolist()))
        table = spark.createDataFrame(rows, "idx int, vector array<float>")
        table.write.mode("overwrite").parquet(f"{path}/vectors")
        meta = {"tier": "tier2", "labels": self.labels, "clean": self.clean}
        _write_meta(spark, f"{path}/meta", meta)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PooledScorer:
        meta = _read_meta(spark, f"{path}/meta")
        stages = PipelineModel.load(f"{path}/model").stages
        rows = spark.read.parquet(f"{path}/vectors").orderBy("idx").collect()
        matrix = np.array([r["vector"] for r in rows], dtype=np.float32)
        return cls(meta["labels"], stages[0], matrix, stages[1:], meta["clean"])


@dataclass
class BatchScorer(Scorer):
    """Tier 3: any function from a batch of texts to an (N, labels) array.

    ``make_predict`` runs once per Python worker, so a heavy model is loaded once
    and then serves every batch of that worker.
    """

    labels: list[str]
    make_predict: Callable[[], Callable[[list[str]], np.ndarray]]
    batch_size: int = 256
    clean: bool = True

    def score(self, df: DataFrame, text: str = "comment_text") -> DataFrame:
        make, width = self.make_predict, len(self.labels)

        def opened():
            predict = make()

            def scores(texts: np.ndarray) -> np.ndarray:
                block = np.asarray(predict(texts.tolist()), dtype=np.float64)
                if block.shape != (len(texts), width):
                    raise ValueError(f"expected {width} scores per text, got shape {block.shape}")
                return block

            return scores

        probs = predict_batch_udf(
            opened, return_type=T.ArrayType(T.DoubleType()), batch_size=self.batch_size
        )
        body = clean_text(F.col(text)) if self.clean else F.coalesce(text, F.lit(""))
        return df.withColumn("prob", probs(body))

    def save(self, spark: SparkSession, path: str) -> None:
        """The predictor becomes one file, in the pickled form in which Spark ships functions."""
        file = f"predictor-{uuid.uuid4().hex}.pkl"  # files of a job share one folder on executors
        write_bytes(spark, f"{path}/predictor/{file}", cloudpickle.dumps(self.make_predict))
        meta = {"tier": "tier3", "labels": self.labels, "clean": self.clean}
        _write_meta(spark, f"{path}/meta", {**meta, "batch_size": self.batch_size, "file": file})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BatchScorer:
        """The predictor's file goes to every executor with the job and is opened once per worker.

        Opening it runs what is in it: load only what you trust.
        """
        meta = _read_meta(spark, f"{path}/meta")
        file = meta["file"]
        spark.sparkContext.addFile(f"{path}/predictor/{file}")

        def make() -> Callable[[list[str]], np.ndarray]:
            with open(SparkFiles.get(file), "rb") as opened:
                return cloudpickle.load(opened)()

        return cls(meta["labels"], make, meta["batch_size"], meta["clean"])


def lexical_predictor(lexicons: dict[str, list[str]]) -> Callable[[], Callable]:
    """A deterministic stand-in for a pretrained model: share of label words, saturating."""

    def make() -> Callable[[list[str]], np.ndarray]:
        import re

        patterns = [
            re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b")
            for words in lexicons.values()
        ]

        def predict(texts: list[str]) -> np.ndarray:
            series = pd.Series(texts, dtype=object)
            hits = np.stack([series.str.count(p).to_numpy(float) for p in patterns], axis=1)
            return hits / (hits + 1.0)

        return predict

    return make


@dataclass
class DigestScorer(Scorer):
    """Scores that depend only on the cleaned text, computed by expressions.

    A stand-in model whose output other engines can recompute.
    """

    labels: list[str]
    salt: str = "text"
    steps: int = 50

    def probability(self, label: str, text: Column) -> Column:
        drawn = digest_number(digest(self.salt, label, clean_text(text)))
        return (drawn % self.steps) / F.lit(float(self.steps))

    def score(self, df: DataFrame, text: str = "comment_text") -> DataFrame:
        return df.withColumn(
            "prob", F.array(*[self.probability(name, F.col(text)) for name in self.labels])
        )

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"tier": "digest", "labels": self.labels, "salt": self.salt, "steps": self.steps}
        _write_meta(spark, f"{path}/meta", meta)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DigestScorer:
        meta = _read_meta(spark, f"{path}/meta")
        return cls(meta["labels"], meta["salt"], meta["steps"])


def fit(train: DataFrame, labels: list[str], tier: str = "tier1", **options) -> Scorer:
    """Fit (or, for tier 3, wrap) the scorer of a tier."""
    if tier == "tier1":
        return TfidfScorer.fit(train, labels, **options)
    if tier == "tier2":
        return PooledScorer.fit(train, labels, **options)
    if tier == "tier3":
        return BatchScorer(labels, **options)
    raise ValueError(f"unknown tier: {tier}")


def load(spark: SparkSession, path: str) -> Scorer:
    tier = _read_meta(spark, f"{path}/meta")["tier"]
    kinds = {"tier1": TfidfScorer, "tier2": PooledScorer, "tier3": BatchScorer}
    return {**kinds, "digest": DigestScorer}[tier].load(spark, path)

"""TF-IDF features over 1- and 2-grams.

Counting terms of a known vocabulary happens inside each row, so turning texts
into vectors needs no shuffle; only fitting the vocabulary does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietroom.functions.text import ngrams, token_text, word_tokens
from quietroom.operators.vocabulary import vocabulary
from quietroom.session import join_bounded
from quietroom.settings import MAX_FEATURES


def with_tokens(df: DataFrame, text: str = "comment_text", clean: bool = True) -> DataFrame:
    """Add the array ``tokens``, whose n-grams are the terms: a third of what those take.

    Tokens are lower-cased either way; ``clean`` adds the missing-text rule.
    """
    body = token_text(F.col(text)) if clean else F.lower(F.coalesce(text, F.lit("")))
    return df.withColumn("tokens", word_tokens(body))


def with_terms(df: DataFrame, text: str = "comment_text", clean: bool = True) -> DataFrame:
    """Add the n-gram array ``terms`` of what ``with_tokens`` finds."""
    body = token_text(F.col(text)) if clean else F.lower(F.coalesce(text, F.lit("")))
    return (
        df.withColumn("_tokens", word_tokens(body))
        .withColumn("terms", ngrams(F.col("_tokens")))
        .drop("_tokens")
    )


def terms_of_tokens(df: DataFrame) -> DataFrame:
    """``terms`` in place of ``tokens``."""
    return df.withColumn("terms", ngrams(F.col("tokens"))).drop("tokens")


@dataclass
class FittedVocabulary:
    """At most ``max_features`` terms with their document counts; held on the driver."""

    terms: list[str]
    doc_counts: list[int]
    n_docs: int

    @classmethod
    def fit(cls, df: DataFrame, terms: str = "terms", limit: int = MAX_FEATURES):
        return cls._of(df, vocabulary(df, F.col(terms), limit))

    @classmethod
    def fit_tokens(cls, df: DataFrame, tokens: str = "tokens", limit: int = MAX_FEATURES):
        """``fit`` on the n-grams of ``tokens``, counted without making them for every text."""
        return cls._of(df, vocabulary(df, F.col(tokens), limit, pairs=True))

    @classmethod
    def _of(cls, df: DataFrame, found: DataFrame):
        rows = found.orderBy("idx").collect()
        return cls([r["term"] for r in rows], [r["df"] for r in rows], df.count())

    def idf(self) -> list[float]:
        return [math.log((1 + self.n_docs) / (1 + d)) + 1.0 for d in self.doc_counts]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            list(enumerate(self.terms)), "idx int, term string"
        )


def tfidf_stages(vocab: FittedVocabulary) -> PipelineModel:
    """``terms`` to the normalised vector ``features``."""
    if not vocab.terms:
        raise ValueError("no terms in the fitted texts")
    counts = CountVectorizerModel.from_vocabulary(
        vocab.terms, inputCol="terms", outputCol="counts", minTF=1.0
    )
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense(vocab.idf()), inputCol="counts", outputCol="weighted"
    )
    unit = Normalizer(p=2.0, inputCol="weighted", outputCol="features")
    return PipelineModel([counts, weigh, unit])


def vector_entries(vector: str) -> Column:
    """The stored entries of a sparse vector as an array of ``idx, value``."""
    raw = F.unwrap_udt(F.col(vector))
    return F.arrays_zip(raw["indices"].alias("idx"), raw["values"].alias("value"))


def _termed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, "terms") if "terms" in df.columns else with_terms(df.select(key, text), text)


def tfidf_long(
    df: DataFrame, vocab: FittedVocabulary, key: str = "id", text: str = "comment_text"
) -> DataFrame:
    """``key, term, tfidf`` for every vocabulary term of every comment; ``terms`` are used if there."""
    vectors = tfidf_stages(vocab).transform(_termed(df, key, text))
    entries = vectors.select(key, F.inline(vector_entries("features")))
    names = vocab.table(df.sparkSession)
    return join_bounded(entries, names, "idx", "inner", len(vocab.terms)).select(
        key, "term", F.col("value").alias("tfidf")
    )


def linear_contributions(
    df: DataFrame,
    vocab: FittedVocabulary,
    coefficients: dict[str, list[float]],
    key: str = "id",
    text: str = "comment_text",
    top: int = 10,
) -> DataFrame:
    """The strongest ``coefficient * tfidf`` terms per comment and label.

    The products and their ranking are per row, so there is no shuffle; only the
    few kept entries meet the term names. Equal strengths go to the more frequent
    term. ``terms`` are used if there.
    """
    featured = tfidf_stages(vocab).transform(_termed(df, key, text))
    fields = []
    for i, (label, values) in enumerate(coefficients.items()):
        weighed = ElementwiseProduct(
            scalingVec=Vectors.dense(values), inputCol="features", outputCol=f"_w{i}"
        )
        featured = weighed.transform(featured)
        strength = F.transform(
            F.filter(vector_entries(f"_w{i}"), lambda e: e["value"] != 0),
            lambda e: F.struct(
                (-F.round(F.abs(e["value"]), 9)).alias("order"),
                e["idx"].alias("idx"),
                e["value"].alias("weight"),
            ),
        )
        # The plain order of structs, in compiled code; array_sort calls a comparator for each pair.
        best = F.slice(F.sort_array(strength), 1, top)
        fields.append(F.struct(F.lit(label).alias("label"), best.alias("best")))
    per_label = featured.select(key, F.inline(F.array(*fields)))
    kept = per_label.select(key, "label", F.posexplode("best").alias("_p", "_e")).select(
        key, "label", (F.col("_p") + 1).alias("rank"), "_e.idx", "_e.weight"
    )
    names = vocab.table(df.sparkSession)
    return join_bounded(kept, names, "idx", "inner", len(vocab.terms)).select(
        key, "label", "rank", F.col("term").alias("token"), "weight"
    )

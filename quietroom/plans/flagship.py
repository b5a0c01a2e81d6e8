"""From labelled and unlabelled documents to flags for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.operators.decide import response
from quietroom.operators.reshape import scored_long
from quietroom.operators.split import in_split
from quietroom.operators.thresholds import optimize_thresholds
from quietroom.plans.scorers import fit
from quietroom.session import dealt
from quietroom.sources.comments import split_comments


def moderated_documents(
    spark: SparkSession, folder: str, labels: tuple[str, ...] = ("toxic", "quality")
) -> DataFrame:
    """``id, scores, flags, any_over_half, verdict`` of every document.

    Fit on the train part, thresholds tuned on the validation part, then one
    narrow pass over all documents.
    """
    names = list(labels)
    stored = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    documents = dealt(stored, "doc_id")
    parts = split_comments(documents, spark.read.parquet(f"{folder}/labels.parquet"), names)
    scorer = fit(in_split(parts, "train"), names)
    validation = scored_long(scorer.scored(in_split(parts, "val")), names, ["id"])
    # One row per label.
    tuned = {r["label"]: r["threshold"] for r in optimize_thresholds(validation).collect()}
    texts = documents.select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))
    return response(scorer.score(texts), names, tuned, ["id"])

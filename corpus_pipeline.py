"""The corpus pipeline: each stage takes the documents that the stage before kept.

Language identification drops what it rejects, line dedup rewrites texts, the n-gram join leaves
the smallest id of each group of near duplicates, decontamination drops documents that contain a
benchmark item, and packing turns what is left into pieces of training sequences. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.llm import decontamination, language_id, packing
from quietroom.llm.line_dedup import line_dedup
from quietroom.llm.ngram_join import ngram_join, one_of_each
from quietroom.session import drop_folder, settled_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that are null, have no letter or are far from every known language."""
    found = language_id.identify(docs.select(*COLUMNS), language_id.fit(docs))
    return found.where("NOT rejected").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines they share with other documents; ``n_chars`` follows the text."""
    return line_dedup(docs.select(*COLUMNS)).select(
        "doc_id",
        F.col("kept").alias("text"),
        "lang",
        "source",
        F.char_length("kept").cast("long").alias("n_chars"),
    )


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of each group of five-word shingle sets at least 0.8 alike."""
    return one_of_each(docs.select(*COLUMNS), ngram_join(docs, k=5, percent=80)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminate(docs.select(*COLUMNS), benchmark)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# The language model and the tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    When a stage's result is written, its work folders and the table of the stage before are removed.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = settled_path(spark, partial(stage, spark, docs, sf_dir), f"llm-{name}")
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

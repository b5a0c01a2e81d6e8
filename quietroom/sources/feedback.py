"""User corrections as append-only CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.functions.text import iso_time, pipe_join, pipe_split

# Fixed column order of the feedback file.
FEEDBACK_SCHEMA = "timestamp string, text string, suggested_labels string, user_comment string"
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true"}


def feedback_rows(events: DataFrame) -> DataFrame:
    """Feedback events in file form: ISO time and labels joined by ``|``."""
    return events.select(
        iso_time(F.col("timestamp")).alias("timestamp"),
        "text",
        pipe_join(F.col("suggested_labels")).alias("suggested_labels"),
        "user_comment",
    )


def stamp_now(events: DataFrame) -> DataFrame:
    return events.withColumn("timestamp", F.current_timestamp())


def append_feedback(events: DataFrame, path: str) -> None:
    """Append; every part file carries the header once."""
    feedback_rows(events).write.mode("append").options(**CSV_OPTIONS).csv(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    raw = (
        spark.read.schema(FEEDBACK_SCHEMA)
        .options(**CSV_OPTIONS)
        .option("multiLine", True)
        .option("emptyValue", "")
        .csv(path)
    )
    labels = F.coalesce(F.col("suggested_labels"), F.lit(""))
    return raw.withColumn("suggested_labels", pipe_split(labels))

"""Streaming scoring, feedback collection and the side output of rejected requests.

All three are stateless: a micro-batch is scored by the same narrow plan as a
table, so throughput grows with the number of input files and executors.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quietroom.operators.decide import response
from quietroom.operators.reshape import accepted, validate_requests
from quietroom.plans.scorers import Scorer
from quietroom.sources.feedback import CSV_OPTIONS, feedback_rows


def request_stream(
    spark: SparkSession, path: str, schema, files_per_trigger: int = 1000, fmt: str = "parquet"
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )


def respond(
    requests: DataFrame,
    scorer: Scorer,
    thresholds: dict[str, float] | None = None,
    keep: list[str] | None = None,
    text: str = "text",
    strict: bool = False,
) -> DataFrame:
    """Validate, score and decide; works on tables and streams alike."""
    valid = accepted(validate_requests(requests, text, strict))
    scored = scorer.score(valid, text)
    return response(scored, list(scorer.labels), thresholds, keep or ["id"])


def start_scoring(responses: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append responses to a parquet table, each exactly once."""
    return (
        responses.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_feedback(events: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append feedback events to a CSV table, each exactly once."""
    return (
        feedback_rows(events)
        .writeStream.format("csv")
        .outputMode("append")
        .options(**CSV_OPTIONS)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_validation(
    requests: DataFrame,
    out: str,
    checkpoint: str,
    text: str = "text",
    strict: bool = False,
    **trigger,
) -> StreamingQuery:
    """Write accepted and rejected requests apart, reading each micro-batch once.

    A repeated micro-batch overwrites its own folder, so a retry adds no row twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_requests(batch, text, strict)
        outcome = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
        checked.withColumn("outcome", outcome).write.mode("overwrite").partitionBy(
            "outcome"
        ).parquet(f"{out}/batch_id={batch_id}")

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_measured(
    requests: DataFrame,
    scorer: Scorer,
    out: str,
    checkpoint: str,
    thresholds: dict[str, float] | None = None,
    keep: list[str] | None = None,
    text: str = "text",
    strict: bool = False,
    **trigger,
) -> StreamingQuery:
    """Answer requests, and write with each micro-batch what it took and gave.

    ``out/answers`` has a row for every request, the answer of an accepted one and the reason of a
    rejected one; ``out/batches`` one row per micro-batch (see ``read_batches``). A batch is read and
    scored once; it is counted from two columns of what has been written. A repeated micro-batch
    overwrites its own folders, so a retry counts nothing twice.
    """
    keep = keep or ["id"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = validate_requests(batch, text, strict)
        scored = scorer.score(checked, text)
        # Rejected requests pass through without an answer; there are few of them.
        answers = response(scored, list(scorer.labels), thresholds, [*keep, "reason"])
        given = [c for c in answers.columns if c not in (*keep, "reason")]
        accepted_row = F.col("reason").isNull()
        rows = answers.select(
            *keep, "reason", *[F.when(accepted_row, F.col(c)).alias(c) for c in given]
        )
        folder = f"{out}/answers/batch_id={batch_id}"
        started = time.perf_counter()
        rows.write.mode("overwrite").parquet(folder)
        seconds = time.perf_counter() - started
        facts = spark.read.schema(rows.schema).parquet(folder).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(accepted_row, 1)).alias("accepted"),
            F.count("reason").alias("rejected"),
            F.count(F.when(F.size("flags") > 0, 1)).alias("flagged"),
            F.lit(seconds).alias("seconds"),
        )
        facts.write.mode("overwrite").parquet(f"{out}/batches/batch_id={batch_id}")

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """``batch_id, n_rows, accepted, rejected, flagged, seconds, rows_per_second`` by micro-batch."""
    rows = spark.read.parquet(f"{out}/batches")
    speed = F.col("n_rows") / F.greatest("seconds", F.lit(1e-9))
    return rows.withColumn("rows_per_second", speed)


def read_requests(spark: SparkSession, out: str, outcome: str) -> DataFrame:
    """The accepted or the rejected requests; only that part of the files is read."""
    return spark.read.parquet(out).where(F.col("outcome") == outcome).drop("outcome")

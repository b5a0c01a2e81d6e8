"""Streaming jobs run to the end of their input, and the feedback sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietroom.catalog.base import LABELS, query, table
from quietroom.catalog.models import fitted
from quietroom.catalog.texts import SQL_LINES, request_lines
from quietroom.functions.text import pipe_join
from quietroom.session import work_path
from quietroom.sources.feedback import append_feedback, read_feedback
from quietroom.streaming.jobs import (
    read_batches,
    read_requests,
    request_stream,
    respond,
    start_feedback,
    start_measured,
    start_scoring,
    start_validation,
)


def _stream(spark, sf, name: str):
    """A table as file stream; the glob lets it be one file or a folder of files."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return request_stream(spark, f"{sf}/{name}[.]parquet", schema)


def _requests(df):
    return df.where("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "text"
    )


@query(
    "stream_equals_batch",
    "SELECT count(*) AS n_batch, count(*) AS n_stream, count(*) AS n_equal "
    "FROM conversations WHERE role = 'user' AND length(text) > 0",
)
def stream_equals_batch(spark, sf):
    """Requests scored as a stream give the same answers as scored as a table."""
    scorer, limits = fitted(spark, sf), {"toxic": 0.4, "quality": 0.6}
    out, mark = work_path(spark, "responses"), work_path(spark, "responses-checkpoint")
    live = respond(_requests(_stream(spark, sf, "conversations")), scorer, limits)
    start_scoring(live, out, mark).awaitTermination()

    def flat(df):
        return df.select(
            "id",
            F.struct(
                *[F.col("scores")[c].alias(c) for c in LABELS], "flags", "any_over_half", "verdict"
            ).alias("answer"),
        )

    streamed = flat(spark.read.parquet(out)).withColumnRenamed("answer", "streamed")
    batch = flat(respond(_requests(table(spark, sf, "conversations")), scorer, limits))
    joined = batch.join(streamed, "id", "full_outer")
    return joined.agg(
        F.count("answer").alias("n_batch"),
        F.count("streamed").alias("n_stream"),
        F.count(F.when(F.col("answer") == F.col("streamed"), 1)).alias("n_equal"),
    )


def _feedback(events):
    """Events as feedback: suggested labels by value, the properties as text."""
    suggested = F.array_compact(
        F.array(F.when(F.col("value") >= 10, "toxic"), F.when(F.col("value") >= 5, "quality"))
    )
    return events.select(
        F.col("ts").alias("timestamp"),
        F.col("props").alias("text"),
        suggested.alias("suggested_labels"),
        F.col("event_type").alias("user_comment"),
    )


_FEEDBACK = (
    "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, props AS text, "
    "concat_ws('|', CASE WHEN value >= 10 THEN 'toxic' END, CASE WHEN value >= 5 THEN 'quality' END) "
    "AS suggested_labels, event_type AS user_comment FROM events"
)


def _shown(feedback):
    return feedback.withColumn("suggested_labels", pipe_join(F.col("suggested_labels")))


@query("feedback_csv_rows", _FEEDBACK)
def feedback_csv_rows(spark, sf):
    """Feedback appended in two writes and read back."""
    path = work_path(spark, "feedback")
    rows = _feedback(table(spark, sf, "events"))
    late = F.coalesce(F.col("user_comment").isin("error", "view"), F.lit(False))
    append_feedback(rows.where(~late), path)
    append_feedback(rows.where(late), path)
    return _shown(read_feedback(spark, path))


@query("stream_feedback", _FEEDBACK)
def stream_feedback(spark, sf):
    path, mark = work_path(spark, "feedback"), work_path(spark, "feedback-checkpoint")
    start_feedback(_feedback(_stream(spark, sf, "events")), path, mark).awaitTermination()
    return _shown(read_feedback(spark, path))


@query(
    "stream_rejects",
    "SELECT conv_id, turn, line, "
    "CASE WHEN length(trim(t)) = 0 THEN 'rejected' ELSE 'accepted' END AS outcome "
    f"FROM ({SQL_LINES})",
)
def stream_rejects(spark, sf):
    """Every line of every message as a request; empty ones go to the side output."""
    requests = request_lines(_stream(spark, sf, "conversations"))
    out, mark = work_path(spark, "requests"), work_path(spark, "requests-checkpoint")
    start_validation(requests, out, mark, strict=True).awaitTermination()
    parts = [
        read_requests(spark, out, name).select(
            "conv_id", "turn", "line", F.lit(name).alias("outcome")
        )
        for name in ("accepted", "rejected")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "stream_batches",
    "SELECT 4::BIGINT AS n_batches, count(*) AS n_rows, count(*) FILTER (length(text) > 0) AS accepted, "
    "count(*) FILTER (length(coalesce(text, '')) = 0) AS rejected, true AS as_table, true AS timed "
    "FROM conversations WHERE role = 'user'",
)
def stream_batches(spark, sf):
    """Counts by micro-batch: their sums are those of the requests scored as a table."""
    scorer, limits = fitted(spark, sf), {"toxic": 0.4, "quality": 0.6}
    requests = _requests(table(spark, sf, "conversations"))
    folder, out = work_path(spark, "request-files"), work_path(spark, "measured")
    requests.repartition(4, "id").sortWithinPartitions("id").write.parquet(folder)
    # Four files, one in each micro-batch.
    live = request_stream(spark, folder, requests.schema, files_per_trigger=1)
    start_measured(live, scorer, out, work_path(spark, "measured-checkpoint"), limits).awaitTermination()
    flagged = respond(requests, scorer, limits).where(F.size("flags") > 0).count()
    return read_batches(spark, out).agg(
        F.count("*").alias("n_batches"),
        *[F.sum(c).alias(c) for c in ("n_rows", "accepted", "rejected")],
        (F.sum("flagged") == flagged).alias("as_table"),
        (F.min("rows_per_second") > 0).alias("timed"),
    )

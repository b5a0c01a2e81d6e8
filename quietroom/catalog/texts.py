"""Text functions over all documents and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietroom.catalog.base import (
    documents,
    query,
    r,
    sql_bucket,
    sql_clean,
    sql_score,
    sql_tokens,
    sql_words,
    table,
    texts,
)
from quietroom.functions import text as T
from quietroom.functions.hashing import hash_score
from quietroom.functions.scores import sigmoid, steps_passed
from quietroom.operators.reshape import validate_requests
from quietroom.operators.robustness import with_length
from quietroom.settings import threshold_grid


@query(
    "clean_text", f"SELECT doc_id AS id, {sql_clean('text')} AS clean FROM documents"
)
def clean(spark, sf):
    return texts(spark, sf).select("id", T.clean_text(F.col("comment_text")).alias("clean"))


@query(
    "word_count",
    f"SELECT doc_id AS id, CAST({sql_words('text')} AS INTEGER) AS n_words FROM documents",
)
def words(spark, sf):
    return with_length(texts(spark, sf)).select("id", "n_words")


@query(
    "length_bucket",
    f"SELECT doc_id AS id, {sql_bucket(sql_words('text'))} AS bucket FROM documents",
)
def bucket(spark, sf):
    return with_length(texts(spark, sf)).select("id", "bucket")


@query(
    "bucket_filter",
    f"SELECT doc_id AS id, text AS comment_text FROM documents WHERE {sql_words('text')} < 20",
)
def short_texts(spark, sf):
    rows = with_length(texts(spark, sf)).where("bucket = 'short'")
    return rows.select("id", "comment_text")


@query(
    "tokens",
    "SELECT doc_id AS id, CAST(len(t) AS INTEGER) AS n_tokens, "
    "coalesce(array_to_string(t, ' '), '') AS tokens "
    f"FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)",
)
def tokens(spark, sf):
    found = T.word_tokens(T.clean_text(F.col("comment_text")))
    return texts(spark, sf).select("id", found.alias("t")).select(
        "id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


@query(
    "ngrams",
    "SELECT doc_id AS id, CAST(len(t) + greatest(len(t) - 1, 0) AS INTEGER) AS n_terms, "
    "md5(coalesce(array_to_string(list_concat(t, list_transform(list_zip(t[:-2], t[2:]), "
    "lambda p: p[1] || ' ' || p[2])), '|'), '')) AS terms "
    f"FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)",
)
def ngrams(spark, sf):
    found = T.word_tokens(T.clean_text(F.col("comment_text")))
    rows = texts(spark, sf).select("id", found.alias("t"))
    return rows.select("id", T.ngrams(F.col("t")).alias("t")).select(
        "id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", "|")).alias("terms")
    )


SQL_LINES = (
    "SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, "
    "unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line FROM conversations"
)


def request_lines(conversations):
    """Every line of every message as a request text of its own."""
    lines = F.posexplode(F.split("text", "\n", -1)).alias("line", "text")
    return conversations.select("conv_id", "turn", lines)


@query(
    "reject_empty",
    "SELECT conv_id, turn, line, CASE WHEN length(t) = 0 THEN 'empty_text' END AS reason, "
    f"CASE WHEN length(trim(t)) = 0 THEN 'empty_text' END AS strict_reason FROM ({SQL_LINES})",
)
def reject_empty(spark, sf):
    """Which lines of the messages, each taken as a request, are rejected."""
    rows = request_lines(table(spark, sf, "conversations"))
    plain = validate_requests(rows)
    strict = validate_requests(plain.withColumnRenamed("reason", "plain"), strict=True)
    return strict.select(
        "conv_id",
        "turn",
        "line",
        F.col("plain").alias("reason"),
        F.col("reason").alias("strict_reason"),
    )


@query(
    "pipe_join",
    "SELECT event_id, concat_ws('|', CASE WHEN value >= 10 THEN 'toxic' END, "
    "CASE WHEN value >= 5 THEN 'quality' END) AS joined, "
    "CAST((value >= 10)::INTEGER + (value >= 5)::INTEGER AS INTEGER) AS n_back FROM events",
)
def pipe_join(spark, sf):
    named = F.array(
        F.when(F.col("value") >= 10, "toxic"), F.when(F.col("value") >= 5, "quality")
    )
    rows = table(spark, sf, "events").select("event_id", F.array_compact(named).alias("labels"))
    joined = rows.select("event_id", T.pipe_join(F.col("labels")).alias("joined"))
    return joined.withColumn("n_back", F.size(T.pipe_split(F.col("joined"))))


@query(
    "score_text",
    f"SELECT doc_id AS id, printf('%.2f', {sql_score(repr('toxic'), 'doc_id')}) AS shown FROM documents",
)
def score_text(spark, sf):
    return documents(spark, sf).select(
        "id", T.score_text(hash_score("toxic", F.col("id"))).alias("shown")
    )


@query(
    "iso_time",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events",
)
def iso_time(spark, sf):
    return table(spark, sf, "events").select("event_id", T.iso_time(F.col("ts")).alias("iso"))


@query(
    "sigmoid",
    "SELECT event_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(value - 10.0::DOUBLE))), 9) AS prob FROM events",
)
def logistic(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", r(sigmoid(F.col("value") - F.lit(10.0))).alias("prob")
    )


@query(
    "grid_values",
    "SELECT doc_id AS id, count(threshold) AS n_reached, round(max(threshold), 9) AS highest FROM ("
    f"SELECT doc_id, prob, threshold FROM (SELECT doc_id, {sql_score(repr('toxic'), 'doc_id')} AS prob FROM documents) d "
    "LEFT JOIN (SELECT 0.1::DOUBLE + i * ((0.1::DOUBLE + 0.05::DOUBLE) - 0.1::DOUBLE) AS threshold "
    "FROM range(17) g(i)) ON prob >= threshold) GROUP BY doc_id",
)
def grid_values(spark, sf):
    """Where each score falls on the threshold grid."""
    grid = threshold_grid()
    reached = steps_passed(hash_score("toxic", F.col("id")), grid)
    steps = documents(spark, sf).select("id", reached.cast("bigint").alias("n_reached"))
    values = F.array(*map(F.lit, grid))
    highest = F.get(values, (F.col("n_reached") - 1).cast("int"))
    return steps.withColumn("highest", r(highest))

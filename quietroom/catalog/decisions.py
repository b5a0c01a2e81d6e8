"""Scores, thresholds, flags and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietroom.catalog.base import (
    LABELS,
    comments,
    documents,
    labels,
    long_scores,
    probabilities,
    query,
    r,
    scored,
    sql_best,
    sql_long,
    sql_score,
    sql_sweep,
    sql_words,
    texts,
)
from quietroom.functions.scores import any_over_half, flag_list, map_get, scores_map, verdict
from quietroom.functions.text import flags_text
from quietroom.operators.decide import apply_thresholds
from quietroom.operators.reshape import scored_long, scores_table
from quietroom.operators.robustness import with_length
from quietroom.operators.thresholds import optimize_thresholds
from quietroom.sources.reports import with_default_thresholds

_T, _Q = (sql_score(repr(name), "doc_id") for name in LABELS)
_SCORES = f"(SELECT doc_id, {_T} AS t, {_Q} AS q FROM documents)"
LIMITS = {"toxic": 0.7, "quality": 0.4}
_FLAGS = "concat_ws(', ', CASE WHEN t >= 0.7::DOUBLE THEN 'toxic' END, CASE WHEN q >= 0.4::DOUBLE THEN 'quality' END)"


def _document_scores(spark, sf):
    return documents(spark, sf).select("id", probabilities().alias("prob"))


@query(
    "scores_map",
    f"SELECT doc_id AS id, 2 AS n_labels, round(t, 9) AS toxic, round(q, 9) AS quality FROM {_SCORES}",
)
def as_map(spark, sf):
    rows = _document_scores(spark, sf).select(
        "id", scores_map(LABELS, F.col("prob")).alias("s")
    )
    return rows.select(
        "id",
        F.size("s").alias("n_labels"),
        r(F.col("s")["toxic"]).alias("toxic"),
        r(F.col("s")["quality"]).alias("quality"),
    )


@query(
    "map_get_default",
    f"SELECT doc_id AS id, round(t, 9) AS toxic, 0.0::DOUBLE AS insult FROM {_SCORES}",
)
def lookups(spark, sf):
    rows = _document_scores(spark, sf).select(
        "id", scores_map(LABELS, F.col("prob")).alias("s")
    )
    return rows.select(
        "id",
        r(map_get(F.col("s"), "toxic", 0.0)).alias("toxic"),
        map_get(F.col("s"), "insult", 0.0).alias("insult"),
    )


@query(
    "scores_explode",
    f"SELECT doc_id AS id, 'toxic' AS class, round(t, 9) AS probability FROM {_SCORES} UNION ALL "
    f"SELECT doc_id, 'quality', round(q, 9) FROM {_SCORES}",
)
def score_rows(spark, sf):
    rows = _document_scores(spark, sf).select(
        "id", scores_map(LABELS, F.col("prob")).alias("s")
    )
    return scores_table(rows, "s", ["id"]).withColumn("probability", r("probability"))


@query(
    "any_over_half",
    f"SELECT doc_id AS id, (t > 0.5::DOUBLE OR q > 0.5::DOUBLE) AS toxic_found FROM {_SCORES}",
)
def over_half(spark, sf):
    return _document_scores(spark, sf).select(
        "id", any_over_half(F.col("prob")).alias("toxic_found")
    )


@query(
    "flag_list",
    f"SELECT doc_id AS id, replace({_FLAGS}, ', ', '|') AS flags, "
    "CAST((t >= 0.7::DOUBLE)::INTEGER + (q >= 0.4::DOUBLE)::INTEGER AS INTEGER) AS n_flags "
    f"FROM {_SCORES}",
)
def flags(spark, sf):
    rows = _document_scores(spark, sf).select(
        "id", flag_list(LABELS, F.col("prob"), LIMITS).alias("f")
    )
    return rows.select("id", F.array_join("f", "|").alias("flags"), F.size("f").alias("n_flags"))


@query("flags_text", f"SELECT doc_id AS id, {_FLAGS} AS shown FROM {_SCORES}")
def shown_flags(spark, sf):
    return _document_scores(spark, sf).select(
        "id", flags_text(flag_list(LABELS, F.col("prob"), LIMITS)).alias("shown")
    )


@query(
    "verdict",
    f"SELECT doc_id AS id, CASE WHEN {_FLAGS} = '' THEN 'safe' ELSE 'toxic' END AS verdict FROM {_SCORES}",
)
def verdicts(spark, sf):
    return _document_scores(spark, sf).select(
        "id", verdict(flag_list(LABELS, F.col("prob"), LIMITS)).alias("verdict")
    )


_BEST = sql_best(f"SELECT label, threshold, f1 FROM ({sql_sweep(f'({sql_long()})')})")


@query(
    "threshold_defaults",
    "SELECT label, round(coalesce(threshold, 0.5::DOUBLE), 9) AS threshold FROM "
    "(VALUES ('toxic'), ('quality'), ('insult')) l(label) LEFT JOIN "
    f"(SELECT * FROM ({_BEST}) WHERE label = 'toxic') USING (label)",
)
def threshold_defaults(spark, sf):
    """Thresholds tuned for one label only; the other labels get the default."""
    tuned = optimize_thresholds(long_scores(spark, sf)).where("label = 'toxic'")
    return with_default_thresholds(tuned, [*LABELS, "insult"]).withColumn(
        "threshold", r("threshold")
    )


@query(
    "apply_thresholds",
    "SELECT doc_id AS id, label, y, round(prob, 9) AS prob, "
    "(prob >= coalesce(threshold, 0.5::DOUBLE))::INTEGER AS pred "
    f"FROM ({sql_long()}) LEFT JOIN (SELECT * FROM ({_BEST}) WHERE label = 'toxic') USING (label)",
)
def decided(spark, sf):
    long = long_scores(spark, sf)
    tuned = optimize_thresholds(long).where("label = 'toxic'")
    return apply_thresholds(long, tuned, len(LABELS)).select(
        "id", "label", "y", r("prob").alias("prob"), "pred"
    )


@query(
    "align_by_key",
    "SELECT p.doc_id AS id, p.label, p.y, (p.prob >= 0.5::DOUBLE)::INTEGER AS pred, "
    f"CAST({sql_words('d.text')} AS INTEGER) AS n_words "
    f"FROM ({sql_long()}) p JOIN documents d USING (doc_id)",
)
def aligned(spark, sf):
    """Predictions next to a property of their text, by key instead of by position."""
    preds = scored(spark, sf).select("id", "y", "prob")
    lengths = with_length(texts(spark, sf)).select("id", "n_words")
    long = scored_long(preds.join(lengths, "id"), LABELS, ["id", "n_words"])
    return long.select(
        "id", "label", "y", (F.col("prob") >= 0.5).cast("int").alias("pred"), "n_words"
    )

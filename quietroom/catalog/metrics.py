"""Losses, metrics, curves and thresholds on hash scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietroom.catalog.base import (
    LABELS,
    SQL_COMMENTS,
    SQL_GRID,
    SQL_SPLIT,
    comments,
    labels,
    long_scores,
    probabilities,
    query,
    r,
    scored,
    sql_best,
    sql_bucket,
    sql_confusion,
    sql_curves,
    sql_digest,
    sql_long,
    sql_ratio,
    sql_score,
    sql_sweep,
    sql_words,
)
from quietroom.operators.curves import ranking_curves
from quietroom.operators.decide import predict_labels
from quietroom.operators.losses import batch_mean_loss, mean_loss, row_loss
from quietroom.operators.metrics import classification_report, confusion, macro_metrics, with_prf
from quietroom.operators.profile import pos_weights
from quietroom.operators.reshape import label_values, scored_long, stack
from quietroom.operators.robustness import bucket_macro, compare_models, with_length
from quietroom.operators.split import stratified_split
from quietroom.operators.thresholds import (
    at_edges,
    optimize_thresholds,
    score_histogram,
    threshold_sweep,
)
from quietroom.plans.train import best_candidate
from quietroom.settings import threshold_grid

_AT_HALF = f"(SELECT *, (prob >= 0.5::DOUBLE)::INTEGER AS pred FROM ({sql_long()}))"


def _rounded(df, *names, digits=9):
    for name in names:
        df = df.withColumn(name, r(name, digits))
    return df


def _decided(spark, sf):
    long = long_scores(spark, sf)
    return long.withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


# --- losses ---------------------------------------------------------------------

_LOGIT = "(({p} - 0.5::DOUBLE) * 8)"


def _sql_row_losses(weighted: bool, *salt: str) -> str:
    """``doc_id, loss`` per labelled id: mean over labels."""
    terms = []
    for name in LABELS:
        x = _LOGIT.format(p=sql_score(*[repr(s) for s in salt], repr(name), "doc_id"))
        weight = (
            f"(SELECT (count(*) - sum({name})) / (sum({name}) + 0.000001::DOUBLE) FROM labels)"
            if weighted
            else "1.0::DOUBLE"
        )
        terms.append(
            f"({weight} * {name} * (greatest(-{x}, 0) + ln(1 + exp(-abs({x})))) "
            f"+ (1 - {name}) * (greatest({x}, 0) + ln(1 + exp(-abs({x})))))"
        )
    return f"SELECT doc_id, ({' + '.join(terms)}) / {len(terms)} AS loss FROM labels"


def _row_losses(spark, sf, *salt, weights=None):
    weights = weights or [F.lit(1.0)] * len(LABELS)
    rows = labels(spark, sf).select(
        "id", label_values(LABELS).alias("y"), probabilities(*salt).alias("prob")
    )
    logits = [(F.col("prob")[i] - F.lit(0.5)) * 8 for i in range(len(LABELS))]
    targets = [F.col("y")[i] for i in range(len(LABELS))]
    return rows.select("id", row_loss(logits, targets, weights).alias("loss"))


@query(
    "weighted_bce",
    f"SELECT count(*) AS n_rows, round(avg(loss), 9) AS mean_loss FROM ({_sql_row_losses(True)})",
)
def weighted_bce(spark, sf):
    table = pos_weights(labels(spark, sf), LABELS)
    weights = [
        F.lit(table.where(F.col("label") == name).select("pos_weight").scalar())
        for name in LABELS
    ]
    return _row_losses(spark, sf, weights=weights).agg(
        F.count("*").alias("n_rows"), r(F.avg("loss")).alias("mean_loss")
    )


@query(
    "batch_mean_loss",
    "SELECT count(*) AS n_batches, round(avg(m), 9) AS batch_mean_loss, "
    "round(sum(s) / sum(n), 9) AS mean_loss FROM ("
    "SELECT b, avg(loss) AS m, sum(loss) AS s, count(*) AS n FROM ("
    f"SELECT loss, (row_number() OVER (ORDER BY {sql_digest('doc_id')}, doc_id) - 1) // 32 AS b "
    f"FROM ({_sql_row_losses(False)})) GROUP BY b)",
)
def batched_loss(spark, sf):
    result = batch_mean_loss(_row_losses(spark, sf))
    return _rounded(result, "batch_mean_loss", "mean_loss")


_SPLIT_LOSSES = (
    f"SELECT split, loss, doc_id FROM ({_sql_row_losses(False)}) JOIN ({SQL_SPLIT}) USING (doc_id)"
)


@query(
    "epoch_losses",
    "SELECT split, count(*) AS n_batches, round(avg(m), 9) AS batch_mean_loss, "
    "round(sum(s) / sum(n), 9) AS mean_loss FROM ("
    "SELECT split, b, avg(loss) AS m, sum(loss) AS s, count(*) AS n FROM (SELECT split, loss, "
    f"(row_number() OVER (PARTITION BY split ORDER BY {sql_digest('doc_id')}, doc_id) - 1) // 32 AS b "
    f"FROM ({_SPLIT_LOSSES}) WHERE split IN ('train', 'val')) GROUP BY split, b) GROUP BY split",
)
def epoch_losses(spark, sf):
    """Training and validation loss as means of their batch means."""
    losses = _row_losses(spark, sf)
    split = stratified_split(labels(spark, sf).select("id", "toxic")).select("id", "split")
    kept = losses.join(split, "id").where(F.col("split").isin("train", "val"))
    return _rounded(batch_mean_loss(kept, ["split"]), "batch_mean_loss", "mean_loss")


_CANDIDATES = [f"epoch{i}" for i in (1, 2, 3)]


@query(
    "best_candidate",
    "SELECT candidate, round(val_loss, 9) AS val_loss FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS candidate, {i} AS seq, avg(loss) AS val_loss FROM ({_sql_row_losses(False, c)})"
        for i, c in enumerate(_CANDIDATES)
    )
    + ") ORDER BY val_loss, seq LIMIT 1",
)
def kept_candidate(spark, sf):
    losses = stack(
        {c: mean_loss(_row_losses(spark, sf, c)) for c in _CANDIDATES}, "candidate"
    ).select(
        "candidate",
        F.substring("candidate", 6, 1).cast("int").alias("seq"),
        F.col("mean_loss").alias("val_loss"),
    )
    return _rounded(best_candidate(losses), "val_loss")


# --- metrics --------------------------------------------------------------------

_ROUNDED_PRF = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"


@query(
    "label_metrics",
    f"SELECT label, tp, fp, fn, tn, {_ROUNDED_PRF} FROM ({sql_confusion(_AT_HALF, 'label')})",
)
def label_metrics(spark, sf):
    rows = with_prf(confusion(_decided(spark, sf), ["label"]))
    return _rounded(rows, "precision", "recall", "f1")


@query(
    "macro_metrics",
    "SELECT round(avg(f1), 9) AS f1, round(avg(precision), 9) AS precision, "
    f"round(avg(recall), 9) AS recall FROM ({sql_confusion(_AT_HALF, 'label')})",
)
def macro_scores(spark, sf):
    return _rounded(macro_metrics(_decided(spark, sf)), "f1", "precision", "recall")


_SWEEP = sql_sweep(f"({sql_long()})")


@query(
    "threshold_sweep",
    f"SELECT label, round(threshold, 9) AS threshold, tp, fp, fn, tn, round(f1, 9) AS f1 FROM ({_SWEEP})",
)
def sweep(spark, sf):
    return _rounded(threshold_sweep(long_scores(spark, sf)), "threshold", "f1")


@query(
    "best_threshold",
    "SELECT label, round(threshold, 9) AS threshold, round(f1, 9) AS f1 FROM ("
    + sql_best(f"SELECT label, threshold, f1 FROM ({_SWEEP})")
    + ")",
)
def best(spark, sf):
    return _rounded(optimize_thresholds(long_scores(spark, sf)), "threshold", "f1")


@query(
    "grid_theta_join",
    "SELECT label, round(threshold, 9) AS threshold, count(*) AS n_reached, "
    "count(*) FILTER (y = 1) AS n_positive "
    f"FROM ({sql_long()}) JOIN ({SQL_GRID}) ON prob >= threshold GROUP BY ALL",
)
def reached_thresholds(spark, sf):
    """Rows at or above every threshold: the comparison of all scores with all thresholds."""
    grid = threshold_grid()
    counts = at_edges(score_histogram(long_scores(spark, sf), [], grid), [], grid)
    return counts.where("tp + fp > 0").select(
        "label",
        r("threshold").alias("threshold"),
        (F.col("tp") + F.col("fp")).alias("n_reached"),
        F.col("tp").alias("n_positive"),
    )


_CURVES = sql_curves(f"({sql_long()})", "label")


@query("roc_auc", f"SELECT label, round(roc_auc, 9) AS roc_auc FROM ({_CURVES})")
def roc_auc(spark, sf):
    return _rounded(ranking_curves(long_scores(spark, sf)).select("label", "roc_auc"), "roc_auc")


@query(
    "average_precision",
    f"SELECT label, round(average_precision, 9) AS average_precision FROM ({_CURVES})",
)
def average_precision(spark, sf):
    """Cut into score buckets whatever the size, as for large tables."""
    curves = ranking_curves(long_scores(spark, sf))
    return _rounded(curves.select("label", "average_precision"), "average_precision")


def _sql_report() -> str:
    conf = sql_confusion(_AT_HALF, "label")
    per_label = f"SELECT label AS row, precision, recall, f1, tp + fn AS support FROM ({conf})"
    micro = (
        f"SELECT 'micro avg', {sql_ratio('sum(tp)', 'sum(tp + fp)')}, {sql_ratio('sum(tp)', 'sum(tp + fn)')}, "
        f"{sql_ratio('2 * sum(tp)', 'sum(2 * tp + fp + fn)')}, sum(tp + fn) FROM ({conf})"
    )
    macro = f"SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(tp + fn) FROM ({conf})"
    weighted = "SELECT 'weighted avg', " + ", ".join(
        sql_ratio(f"sum({m} * (tp + fn))", "sum(tp + fn)") for m in ("precision", "recall", "f1")
    ) + f", sum(tp + fn) FROM ({conf})"
    samples = (
        "SELECT 'samples avg', avg(p), avg(rc), avg(f), sum(s) FROM (SELECT "
        f"{sql_ratio('sum(y * pred)', 'sum(pred)')} AS p, {sql_ratio('sum(y * pred)', 'sum(y)')} AS rc, "
        f"{sql_ratio('2 * sum(y * pred)', 'sum(pred) + sum(y)')} AS f, sum(y) AS s "
        f"FROM {_AT_HALF} GROUP BY doc_id)"
    )
    rows = " UNION ALL ".join([per_label, micro, macro, weighted, samples])
    return f"SELECT row, {_ROUNDED_PRF}, CAST(support AS BIGINT) AS support FROM ({rows})"


@query("classification_report", _sql_report())
def report(spark, sf):
    predicted = predict_labels(scored(spark, sf), LABELS)
    return _rounded(classification_report(predicted, LABELS), "precision", "recall", "f1")


_BUCKETED = (
    "(SELECT label, y, (prob >= 0.5::DOUBLE)::INTEGER AS pred, bucket FROM "
    f"({sql_long()}) JOIN (SELECT doc_id, {sql_bucket(sql_words('text'))} AS bucket "
    f"FROM ({SQL_COMMENTS})) USING (doc_id))"
)


@query(
    "bucket_metrics",
    "SELECT bucket, round(avg(f1), 9) AS f1, round(avg(precision), 9) AS precision, "
    "round(avg(recall), 9) AS recall FROM (VALUES ('short'), ('long')) b(bucket) LEFT JOIN "
    f"({sql_confusion(_BUCKETED, 'bucket, label')}) USING (bucket) GROUP BY bucket",
)
def bucket_scores(spark, sf):
    rows = with_length(comments(spark, sf)).select(
        "bucket", label_values(LABELS).alias("y"), probabilities().alias("prob")
    )
    long = scored_long(predict_labels(rows, LABELS), LABELS, ["bucket"])
    per_label = with_prf(confusion(long, ["bucket", "label"]))
    return _rounded(bucket_macro(per_label), "f1", "precision", "recall")


# Hash functions that stand in for models, with numbers to reckon with.
STAND_INS = [("first", 4, 10), ("second", 6, 30), ("third", 20, 20)]


def _sql_models() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS model, * FROM ({sql_long(m)})" for m, _, _ in STAND_INS
    )
    return f"(SELECT *, (prob >= 0.5::DOUBLE)::INTEGER AS pred FROM ({rows}))"


_FACTS = ", ".join(f"('{m}', {lat}, {size})" for m, lat, size in STAND_INS)


@query(
    "comparison_arithmetic",
    "SELECT model, round(f1, 9) AS f1_score, round(recall, 9) AS recall_safety, latency_ms, size_mb, "
    "round(latency_ms::DOUBLE / min(latency_ms) OVER (), 9) AS latency_ratio FROM "
    f"(SELECT model, avg(f1) AS f1, avg(recall) AS recall FROM ({sql_confusion(_sql_models(), 'model, label')}) "
    f"GROUP BY model) JOIN (VALUES {_FACTS}) f(model, latency_ms, size_mb) USING (model)",
)
def comparison_arithmetic(spark, sf):
    """How scores, latency and size are put next to each other; ``model_comparison`` measures them."""
    rows = stack({m: scored(spark, sf, m) for m, _, _ in STAND_INS}, "model")
    long = scored_long(predict_labels(rows, LABELS), LABELS, ["model"])
    facts = spark.createDataFrame(STAND_INS, "model string, latency_ms int, size_mb int")
    result = compare_models(macro_metrics(long, ["model"]), facts)
    return _rounded(result, "f1_score", "recall_safety", "latency_ratio")


@query(
    "stack_variants",
    "SELECT model, label, count(*) AS n_rows, round(avg(prob), 9) AS mean_prob FROM "
    f"{_sql_models()} GROUP BY model, label",
)
def stacked(spark, sf):
    rows = stack({m: scored(spark, sf, m) for m, _, _ in STAND_INS}, "model")
    return scored_long(rows, LABELS, ["model"]).groupBy("model", "label").agg(
        F.count("*").alias("n_rows"), r(F.avg("prob")).alias("mean_prob")
    )

"""Noise operators and the comparison of clean and noisy decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietroom.catalog.base import (
    LABELS,
    SQL_COMMENTS,
    comments,
    query,
    r,
    sql_clean,
    sql_confusion,
    sql_score,
    sql_swap,
    texts,
)
from quietroom.functions.noise import adjacent_swap, fixed_swap
from quietroom.operators.decide import flips, flips_wide, predict_labels
from quietroom.operators.metrics import macro_metrics
from quietroom.operators.reshape import label_values, scored_long
from quietroom.operators.robustness import noise_drop, variants, with_noise
from quietroom.plans.scorers import DigestScorer


@query(
    "swap_adjacent",
    f"SELECT doc_id AS id, {sql_swap('text', 'doc_id')} AS noisy FROM documents",
)
def swapped(spark, sf):
    noisy = adjacent_swap(F.col("comment_text"), F.col("id"))
    return texts(spark, sf).select("id", noisy.alias("noisy"))


@query(
    "swap_fixed",
    "SELECT doc_id AS id, CASE WHEN length(text) >= 4 THEN substr(text, 1, 2) || substr(text, 4, 1) "
    "|| substr(text, 3, 1) || substr(text, 5) ELSE text END AS noisy FROM documents",
)
def swapped_fixed(spark, sf):
    return texts(spark, sf).select("id", fixed_swap(F.col("comment_text")).alias("noisy"))


@query(
    "noise_invariants",
    "SELECT count(*) AS n_rows, count(*) AS n_same_length, count(*) AS n_same_characters, "
    "count(*) AS n_repeatable, count(*) AS n_within_limit, true AS mostly_changed FROM documents",
)
def noise_invariants(spark, sf):
    """Noise keeps length and characters, repeats exactly, and moves at most 20 percent.

    The second run has another partitioning and other batches; of both runs only digests meet. Of
    the texts that have a swap to make and more than one character, over half must change.
    """
    docs = texts(spark, sf)
    again = with_noise(docs.repartition("id")).select("id", F.md5("noisy").alias("_again"))
    text, noisy = F.col("comment_text"), F.col("noisy")
    split = with_noise(docs).withColumns({"_a": F.split(text, ""), "_b": F.split(noisy, "")})
    moved = F.size(F.filter(F.zip_with("_a", "_b", lambda a, b: a != b), lambda d: d))
    limit = 2 * F.floor(F.length(text) * F.lit(0.1))
    one_by_one = split.select(
        "id",
        F.md5(noisy).alias("_once"),
        (F.length(text) == F.length(noisy)).alias("same_length"),
        (F.array_sort("_a") == F.array_sort("_b")).alias("same_characters"),
        (moved <= limit).alias("within_limit"),
        ((F.length(text) >= 10) & (F.size(F.array_distinct("_a")) > 1)).alias("can_change"),
        (text != noisy).alias("changed"),
    )

    def holds(condition):
        return F.count(F.when(condition, 1))

    return one_by_one.join(again, "id").agg(
        F.count("*").alias("n_rows"),
        holds(F.col("same_length")).alias("n_same_length"),
        holds(F.col("same_characters")).alias("n_same_characters"),
        holds(F.col("_once") == F.col("_again")).alias("n_repeatable"),
        holds(F.col("within_limit")).alias("n_within_limit"),
        (holds(F.col("can_change") & F.col("changed")) * 2 > holds(F.col("can_change"))).alias(
            "mostly_changed"
        ),
    )


def sql_text_scores(text: str) -> dict[str, str]:
    return {c: sql_score(repr("text"), repr(c), sql_clean(text)) for c in LABELS}


def _sql_variants() -> str:
    """``doc_id, variant, label, y, pred`` of the digest scorer on clean and noisy texts."""
    parts = []
    for variant, text in (("clean", "text"), ("noisy", sql_swap("text", "doc_id"))):
        for c, score in sql_text_scores("body").items():
            parts.append(
                f"SELECT doc_id, '{variant}' AS variant, '{c}' AS label, {c} AS y, "
                f"({score} >= 0.5::DOUBLE)::INTEGER AS pred "
                f"FROM (SELECT doc_id, toxic, quality, {text} AS body FROM ({SQL_COMMENTS}))"
            )
    return " UNION ALL ".join(parts)


def _scored_variants(spark, sf):
    """Both variants of every text through one scoring plan."""
    rows = comments(spark, sf).withColumn(
        "noisy", adjacent_swap(F.col("comment_text"), F.col("id"))
    )
    scored = DigestScorer(LABELS).score(variants(rows))
    rows = scored.select("id", "variant", label_values(LABELS).alias("y"), "prob")
    return scored_long(predict_labels(rows, LABELS), LABELS, ["id", "variant"])


_FLIPS = (
    f"WITH v AS ({_sql_variants()}) SELECT c.label, count(*) AS n_rows, "
    "count(*) FILTER (c.pred <> n.pred) AS n_flips FROM v c JOIN v n USING (doc_id, label) "
    "WHERE c.variant = 'clean' AND n.variant = 'noisy' GROUP BY c.label"
)


@query("flip_count", _FLIPS)
def flip_count(spark, sf):
    """Both decisions on one row, so nothing is joined."""
    scorer = DigestScorer(LABELS)
    clean = predict_labels(scorer.score(comments(spark, sf)), LABELS)
    noisy = adjacent_swap(F.col("comment_text"), F.col("id"))
    again = scorer.score(
        clean.withColumnRenamed("pred", "_clean").withColumn("comment_text", noisy)
    )
    both = predict_labels(again, LABELS).select(
        F.col("_clean").alias("pred"), F.col("pred").alias("pred_noisy")
    )
    return flips_wide(both, LABELS)


@query("flip_count_joined", _FLIPS)
def flip_count_joined(spark, sf):
    """The same from two separate prediction tables, by key."""
    long = _scored_variants(spark, sf)
    clean, noisy = (long.where(F.col("variant") == v) for v in ("clean", "noisy"))
    return flips(clean, noisy, ["id", "label"])


_CONFUSION = sql_confusion(f"({_sql_variants()})", "variant, label")


@query(
    "noise_drop",
    "SELECT round(c, 9) AS clean_f1, round(n, 9) AS noisy_f1, round(c - n, 9) AS noise_drop FROM ("
    "SELECT avg(f1) FILTER (variant = 'clean') AS c, avg(f1) FILTER (variant = 'noisy') AS n "
    f"FROM ({_CONFUSION}))",
)
def drop(spark, sf):
    result = noise_drop(macro_metrics(_scored_variants(spark, sf), ["variant"]))
    return result.select(*[r(c).alias(c) for c in ("clean_f1", "noisy_f1", "noise_drop")])

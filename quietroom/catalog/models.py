"""Fitted tiers, explanations and invariants of real scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietroom.catalog.base import (
    LABELS,
    comments,
    parts,
    query,
    r,
    sql_clean,
    table,
    texts,
)
from quietroom.functions.scores import label_array, sigmoid
from quietroom.operators.curves import ranking_curves
from quietroom.operators.explain import explain, fidelity, scored_variants
from quietroom.operators.reshape import label_values, scored_long
from quietroom.operators.robustness import variants, with_noise
from quietroom.operators.split import in_split
from quietroom.plans.evaluate import evaluate_model
from quietroom.plans.scorers import BatchScorer, Scorer, fit, lexical_predictor, load
from quietroom.plans.train import predict_over_half, train
from quietroom.session import dealt, materialize, work_path

# Fixed word lists of the stand-in lexical model.
LEXICONS = {
    "toxic": ["worthless", "stupid", "idiot", "hate", "trash"],
    "quality": ["the", "and", "of", "der", "die", "und", "le", "la", "que"],
}

_fitted: dict[tuple[str, str, str], Scorer] = {}


def fitted(spark, sf, tier: str = "tier1") -> Scorer:
    """The scorer of a tier, fitted once per session on the train part."""
    key = (spark.sparkContext.applicationId, sf, tier)
    if key not in _fitted:
        options = {"make_predict": lexical_predictor(LEXICONS)} if tier == "tier3" else {}
        rows = in_split(parts(spark, sf), "train")
        _fitted[key] = fit(rows, LABELS, tier, **options)
    return _fitted[key]


def forget_fitted() -> None:
    _fitted.clear()


def _probabilities_of(scorer: Scorer, docs):
    return scored_long(scorer.scored(docs), LABELS, ["id"])


@query("tier1_scores")
def tier1_scores(spark, sf):
    return _probabilities_of(fitted(spark, sf), texts(spark, sf))


@query("tier2_scores")
def tier2_scores(spark, sf):
    return _probabilities_of(fitted(spark, sf, "tier2"), texts(spark, sf))


_BOUNDS = (
    "SELECT label, count(*) AS n_rows, count(*) AS n_in_bounds, count(*) AS n_consistent "
    "FROM documents, (VALUES ('toxic'), ('quality')) l(label) GROUP BY label"
)


@query("tier1_prob_bounds", _BOUNDS)
def tier1_prob_bounds(spark, sf):
    """Every probability lies in [0, 1]; one half decides as the library's own predictions do."""
    scorer = fitted(spark, sf)
    decided = predict_over_half(scorer.score(texts(spark, sf), predictions="library"))
    fields = [label_array(LABELS).alias("label"), F.col("prob"), F.col("pred"), F.col("library")]
    rows = decided.select("id", F.inline(F.arrays_zip(*fields)))
    return rows.groupBy("label").agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(F.col("prob").between(0.0, 1.0), 1)).alias("n_in_bounds"),
        F.count(F.when(F.col("library") == F.col("pred"), 1)).alias("n_consistent"),
    )


@query(
    "tier1_recomputed",
    "SELECT label, count(*) AS n_rows, count(*) AS n_equal "
    "FROM documents, (VALUES ('toxic'), ('quality')) l(label) GROUP BY label",
)
def tier1_recomputed(spark, sf):
    """Scores of tier 1 against the sigmoid of intercept + sum of coefficient * tfidf, by joins."""
    scorer, docs = fitted(spark, sf), texts(spark, sf)
    weights = spark.createDataFrame(
        [
            (term, *values)
            for term, *values in zip(scorer.vocabulary, *scorer.coefficients().values(), strict=True)
        ],
        "term string, " + ", ".join(f"{c} double" for c in LABELS),
    )
    products = scorer.tfidf(docs).join(weights, "term")
    sums = products.groupBy("id").agg(*[F.sum(F.col(c) * F.col("tfidf")).alias(c) for c in LABELS])
    joined = scorer.scored(docs).join(sums, "id", "left")
    again = [
        sigmoid(F.coalesce(F.col(c), F.lit(0.0)) + F.lit(b))
        for c, b in zip(LABELS, scorer.intercepts(), strict=True)
    ]
    both = joined.select("id", "prob", F.array(*again).alias("again"))
    rows = both.select(
        "id", F.inline(F.arrays_zip(label_array(LABELS).alias("label"), "prob", "again"))
    )
    close = F.abs(F.col("prob") - F.col("again")) < 1e-9
    return rows.groupBy("label").agg(
        F.count("*").alias("n_rows"), F.count(F.when(close, 1)).alias("n_equal")
    )


@query(
    "tier_skill",
    "SELECT tier, true AS ranks_toxic, true AS varies "
    "FROM (VALUES ('tier1'), ('tier2'), ('tier3')) t(tier)",
)
def tier_skill(spark, sf):
    """On the labelled texts, every tier ranks toxic ones first (AUC of 0.55 at least) and varies."""
    rows = comments(spark, sf)
    tiers = [
        fitted(spark, sf, tier).scored(rows).select("y", "prob", F.lit(tier).alias("tier"))
        for tier in ("tier1", "tier2", "tier3")
    ]
    long = scored_long(tiers[0].union(tiers[1]).union(tiers[2]), LABELS, ["tier"])
    long = materialize(long.where("label = 'toxic'"), "tier-scores")
    spread = long.groupBy("tier").agg((F.max("prob") > F.min("prob")).alias("varies"))
    return ranking_curves(long, ["tier"]).join(spread, "tier").select(
        "tier", (F.col("roc_auc") >= 0.55).alias("ranks_toxic"), "varies"
    )


@query(
    "model_roundtrip",
    "SELECT count(*) AS n_rows, count(*) AS n_equal FROM documents",
)
def model_roundtrip(spark, sf):
    """A saved and reloaded model gives the same scores."""
    scorer = fitted(spark, sf)
    path = work_path(spark, "tier1")
    scorer.save(spark, path)
    before = scorer.score(texts(spark, sf)).withColumnRenamed("prob", "before")
    both = load(spark, path).score(before)
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(F.col("before") == F.col("prob"), 1)).alias("n_equal"),
    )


@query(
    "tier_dispatch",
    "SELECT tier, count(*) AS n_rows, count(*) AS n_full "
    "FROM documents, (VALUES ('tier1'), ('tier2'), ('tier3')) t(tier) GROUP BY tier",
)
def tier_dispatch(spark, sf):
    """All tiers answer through one interface with one probability per label."""
    docs = texts(spark, sf)
    parts = []
    for tier in ("tier1", "tier2", "tier3"):
        rows = fitted(spark, sf, tier).scored(docs)
        full = (F.size("prob") == len(LABELS)) & F.forall("prob", lambda p: p.between(0.0, 1.0))
        parts.append(
            rows.agg(F.count("*").alias("n_rows"), F.count(F.when(full, 1)).alias("n_full")).select(
                F.lit(tier).alias("tier"), "n_rows", "n_full"
            )
        )
    return parts[0].union(parts[1]).union(parts[2])


def sql_hits(label: str, text: str = "text") -> str:
    words = "|".join(LEXICONS[label])
    return (
        rf"len(list_filter(regexp_extract_all({sql_clean(text)}, '[\p{{L}}\p{{N}}_]+'), "
        f"lambda w: regexp_full_match(w, '{words}')))"
    )


@query(
    "lexical_scorer",
    "SELECT doc_id AS id, round(t / (t + 1.0::DOUBLE), 9) AS toxic, round(q / (q + 1.0::DOUBLE), 9) AS quality "
    f"FROM (SELECT doc_id, {sql_hits('toxic')} AS t, {sql_hits('quality')} AS q FROM documents)",
)
def lexical_scores(spark, sf):
    scorer = BatchScorer(LABELS, lexical_predictor(LEXICONS))
    rows = scorer.scored(texts(spark, sf))
    return rows.select("id", *[r(F.col("prob")[i]).alias(c) for i, c in enumerate(LABELS)])


@query("tier1_report")
def tier1_report(spark, sf):
    """Training job of tier 1: 80/20 split by key, fit, classification report."""
    return train(comments(spark, sf), LABELS, "tier1").report


@query("tier1_evaluation")
def tier1_evaluation(spark, sf):
    """Full evaluation of the fitted tier 1 with random character noise."""
    report = evaluate_model(parts(spark, sf), fitted(spark, sf))
    return report.select(
        F.map_entries("thresholds").alias("thresholds"), "metrics.*", "robustness.*"
    )


@query(
    "noisy_rescore",
    "SELECT variant, count(*) AS n_rows, count(*) AS n_scored FROM labels, "
    "(VALUES ('clean'), ('noisy')) v(variant) GROUP BY variant",
)
def noisy_rescore(spark, sf):
    """Clean and noisy copies of the labelled texts through one scoring plan of tier 1."""
    both = variants(with_noise(comments(spark, sf)))
    rows = fitted(spark, sf).score(both).select("variant", "prob", label_values(LABELS).alias("y"))
    good = F.forall("prob", lambda p: p.between(0.0, 1.0))
    return rows.groupBy("variant").agg(
        F.count("*").alias("n_rows"), F.count(F.when(good, 1)).alias("n_scored")
    )


def _requests(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user'")
    return dealt(
        rows.select(
            F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("comment_text")
        ),
        "id",
    )


_WORDS = r"list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_]+'))"


@query(
    "explain_top10",
    "SELECT label, count(*) AS n_explained, CAST(sum(least(n, 10)) AS BIGINT) AS n_tokens, "
    "CAST(sum(least(n, 10)) AS BIGINT) AS n_own_words, CAST(max(least(n, 10)) AS INTEGER) AS last_rank, "
    "count(*) AS n_ordered "
    f"FROM (SELECT len({_WORDS}) AS n FROM conversations WHERE role = 'user'), "
    "(VALUES ('toxic'), ('quality')) l(label) WHERE n > 0 GROUP BY label",
)
def explain_top10(spark, sf):
    """Explanations of all user requests: counts, own words only, strongest first."""
    requests = _requests(spark, sf)
    # Stored once: the counts below read the explanations a single time, but the
    # scorer and the solver run in Python and should not be repeated on a retry.
    rows = materialize(explain(requests, fitted(spark, sf)), "explanations")
    checked = rows.join(requests, "id").withColumn(
        "_own", F.contains("comment_text", F.col("token"))
    )
    per_text = checked.groupBy("id", "label").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("_own"), 1)).alias("own"),
        F.max("rank").alias("last"),
        F.sort_array(F.collect_list(F.struct("rank", F.abs("weight").alias("w")))).alias("ws"),
    )
    strengths = F.transform("ws", lambda e: e["w"])
    ordered = strengths == F.reverse(F.array_sort(strengths))
    return per_text.groupBy("label").agg(
        F.count("*").alias("n_explained"),
        F.sum("n").alias("n_tokens"),
        F.sum("own").alias("n_own_words"),
        F.max("last").alias("last_rank"),
        F.count(F.when(ordered, 1)).alias("n_ordered"),
    )


@query(
    "explanation_fidelity",
    "SELECT label, count(*) AS n_explained, count(*) AS n_fitted, true AS bounded, true AS explains "
    f"FROM (SELECT len({_WORDS}) AS n FROM conversations WHERE role = 'user'), "
    "(VALUES ('toxic'), ('quality')) l(label) WHERE n > 0 GROUP BY label",
)
def explanation_fidelity(spark, sf):
    """Normal equations and weighted R2 of every explanation of a user request."""
    requests, scorer = _requests(spark, sf), fitted(spark, sf)
    # Stored once: both read the same scores of the same variants.
    variants = materialize(scored_variants(requests, scorer), "variants")
    found = materialize(explain(requests, scorer, variants=variants), "explanations")
    rows = fidelity(found, requests, scorer, variants=variants)
    return rows.groupBy("label").agg(
        F.count("*").alias("n_explained"),
        F.count(F.when(F.col("slope") < 1e-8, 1)).alias("n_fitted"),
        (F.max("r2") <= 1).alias("bounded"),
        (F.avg("r2") > 0).alias("explains"),
    )

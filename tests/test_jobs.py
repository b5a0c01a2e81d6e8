import pytest
from pyspark.sql import functions as F

from quietroom.operators.robustness import with_length
from quietroom.plans import scorers
from quietroom.plans.evaluate import evaluate_model, evaluation_report, predictions
from quietroom.plans.scorers import BatchScorer, DigestScorer, TfidfScorer, fit, lexical_predictor
from quietroom.plans.train import save_best, train
from quietroom.streaming.jobs import (
    read_requests,
    request_stream,
    respond,
    start_scoring,
    start_validation,
)

LABELS = ["toxic", "quality"]


@pytest.fixture(scope="module")
def tier1(comments):
    return fit(comments, LABELS, "tier1", max_iter=20)


def probs(scorer, df):
    return {r["id"]: r["prob"] for r in scorer.scored(df).collect()}


def test_tier1_learns_and_reloads(spark, comments, tier1, tmp_path):
    rows = tier1.scored(comments).collect()
    right = sum((r["prob"][0] > 0.5) == (r["y"][0] == 1) for r in rows)
    assert right / len(rows) > 0.9
    path = str(tmp_path / "tier1")
    tier1.save(spark, path)
    again = scorers.load(spark, path)
    assert again.labels == LABELS and again.vocabulary == tier1.vocabulary
    assert probs(again, comments) == probs(tier1, comments)


def test_scores_do_not_depend_on_partitions(comments, tier1):
    assert probs(tier1, comments.repartition(1)) == probs(tier1, comments.repartition(5))


def test_tier1_constant_label(spark):
    rows = [(i, f"word{i % 3} text", i % 2, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, comment_text string, toxic int, quality int")
    got = probs(TfidfScorer.fit(df, LABELS, max_iter=5), df)
    assert all(p[1] == pytest.approx(0.0) for p in got.values())


def test_tier2_fits_and_reloads(spark, comments, tmp_path):
    scorer = fit(comments, LABELS, "tier2", vector_size=8, max_iter=5, w2v_partitions=1)
    path = str(tmp_path / "tier2")
    scorer.save(spark, path)
    first, second = probs(scorer, comments), probs(scorers.load(spark, path), comments)
    assert first == second
    assert all(len(p) == 2 and 0 <= min(p) and max(p) <= 1 for p in first.values())


def test_tier3_runs_any_function(spark):
    df = spark.createDataFrame([(1, "IDIOT idiot"), (2, None), (3, "")], "id int, comment_text string")
    make = lexical_predictor({"toxic": ["idiot"]})
    got = probs(fit(df, ["toxic"], "tier3", make_predict=make, batch_size=1), df)
    assert got == {1: [pytest.approx(2 / 3)], 2: [0.0], 3: [0.0]}
    raw = probs(BatchScorer(["toxic"], make, clean=False), df)
    assert raw[1] == [0.5]
    with pytest.raises(ValueError):
        fit(df, ["toxic"], "tier9")


def test_train_report_and_best(spark, comments, tmp_path):
    done = train(comments, LABELS, save_to=str(tmp_path / "m"), max_iter=5)
    assert [r["row"] for r in done.report.collect()][-1] == "samples avg"
    losses = spark.createDataFrame([("a", 0, 0.3), ("b", 1, 0.2)], "candidate string, seq int, val_loss double")
    assert save_best({"a": None, "b": done.scorer}, losses, str(tmp_path / "best")) == "b"
    assert scorers.load(spark, str(tmp_path / "best")).labels == LABELS


def test_evaluation_is_consistent(comments, tier1):
    report = evaluate_model(comments, tier1).first()
    m, r = report["metrics"], report["robustness"]
    assert set(report["thresholds"]) == set(LABELS)
    assert all(0.0 <= m[k] <= 1.0 for k in ("f1", "precision", "recall", "roc_auc", "pr_auc"))
    assert r["noise_drop"] == pytest.approx(m["f1"] - r["noisy_f1"])


def test_evaluation_empty_slice(comments):
    scorer = DigestScorer(LABELS)
    kept = with_length(comments).where("bucket = 'mid'").drop("n_words", "bucket")
    preds = predictions(kept, scorer, noise=lambda t, k: t).cache()
    report = evaluation_report(preds, LABELS).first()
    assert report["robustness"]["short_f1"] is None and report["robustness"]["long_f1"] is None
    assert report["robustness"]["noise_drop"] == 0.0


def test_stream_equals_batch(spark, comments, tier1, tmp_path):
    source = str(tmp_path / "in")
    rows = comments.select("id", F.col("comment_text").alias("text"))
    rows = rows.union(spark.createDataFrame([(-1, "")], "id long, text string"))
    rows.repartition(3).write.parquet(source)
    live = request_stream(spark, source, rows.schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    start_scoring(respond(live, tier1), out, str(tmp_path / "mark")).awaitTermination()
    start_scoring(respond(live, tier1), out, str(tmp_path / "mark")).awaitTermination()
    key = lambda r: (r["id"], tuple(r["flags"]), tuple(sorted(r["scores"].items())), r["verdict"])
    streamed = sorted(map(key, spark.read.parquet(out).collect()))
    assert streamed == sorted(map(key, respond(rows, tier1).collect()))
    assert len(streamed) == comments.count()


def test_stream_side_output(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "ok"), (2, ""), (3, " ")], "id int, text string")
    df.write.parquet(source)
    live = request_stream(spark, source, df.schema)
    start_validation(live, out, str(tmp_path / "mark"), strict=True).awaitTermination()
    ids = lambda name: sorted(r["id"] for r in read_requests(spark, out, name).collect())
    assert ids("accepted") == [1] and ids("rejected") == [2, 3]


def test_work_folders_are_released(spark):
    from quietroom.session import materialize, release_work
    from quietroom.sources.comments import path_exists

    stored = materialize(spark.range(5), "numbers")
    path = stored.inputFiles()[0].rsplit("/", 1)[0]
    assert stored.count() == 5 and path_exists(spark, path)
    release_work(spark)
    assert not path_exists(spark, path)
    from quietroom.catalog.models import forget_fitted

    forget_fitted()


def test_comments_csv_is_written_by_all_tasks(spark, sf):
    from quietroom import session
    from quietroom.catalog.ingest import split_comments_csv

    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    begun = len(session._folders)
    try:
        split_comments_csv(spark, sf)
    finally:
        spark.conf.set(name, before)
    written = next(p for p in session._folders[begun:] if "large-comments-csv" in p)
    assert spark.read.text(f"{written}/part-*").select("_metadata.file_path").distinct().count() > 2

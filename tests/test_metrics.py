import random

import pytest
from pyspark.sql import functions as F

from quietroom.operators.curves import macro_curves, ranking_curves
from quietroom.operators.decide import flips, flips_wide, predict_labels
from quietroom.operators.losses import batch_mean_loss
from quietroom.operators.metrics import classification_report, confusion, macro, with_prf
from quietroom.operators.profile import balanced_weights, pos_weights
from quietroom.operators.ranking import batch_numbers
from quietroom.operators.reshape import scored_long
from quietroom.operators.robustness import bucket_macro
from quietroom.operators.thresholds import optimize_thresholds, threshold_sweep
from quietroom.plans.train import best_candidate
from quietroom.settings import threshold_grid

LABELS = ["toxic", "insult"]


def brute_auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    total = sum(y for y, _ in pairs)
    out, seen = 0.0, 0
    for t in sorted({s for _, s in pairs}, reverse=True):
        tp = sum(y for y, s in pairs if s >= t)
        out += (tp - seen) / total * tp / sum(1 for _, s in pairs if s >= t)
        seen = tp
    return out


def brute_f1(pairs, t):
    tp = sum(1 for y, s in pairs if y and s >= t)
    fp = sum(1 for y, s in pairs if not y and s >= t)
    fn = sum(1 for y, s in pairs if y and s < t)
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(7)
    draw = {}
    for name in LABELS:
        # A third of all scores are equal.
        score = lambda: 0.5 if rng.random() < 0.34 else round(rng.random() ** 3, 4)
        draw[name] = [(int(rng.random() < 0.2), score()) for _ in range(3000)]
    return draw


@pytest.fixture(scope="module")
def long(spark, pairs):
    rows = [(i, name, y, s) for name in LABELS for i, (y, s) in enumerate(pairs[name])]
    return spark.createDataFrame(rows, "id int, label string, y int, prob double").cache()


def test_curves_match_brute_force(long, pairs):
    got = {r["label"]: r for r in ranking_curves(long).collect()}
    for name in LABELS:
        assert got[name]["roc_auc"] == pytest.approx(brute_auc(pairs[name]), abs=1e-12)
        assert got[name]["average_precision"] == pytest.approx(brute_ap(pairs[name]), abs=1e-12)


def test_single_class_curves(spark):
    rows = [("a", 0, 0.1), ("a", 0, 0.2), ("b", 0, 0.3), ("b", 1, 0.3)]
    per_label = ranking_curves(spark.createDataFrame(rows, "label string, y int, prob double"))
    got = {r["label"]: (r["roc_auc"], r["average_precision"]) for r in per_label.collect()}
    assert got == {"a": (None, None), "b": (0.5, 0.5)}
    assert tuple(macro_curves(per_label).first()) == (0.0, 0.0)


def test_sweep_and_best_match_brute_force(long, pairs):
    sweep = {(r["label"], r["threshold"]): r["f1"] for r in threshold_sweep(long).collect()}
    assert len(sweep) == 2 * len(threshold_grid())
    best = {r["label"]: r for r in optimize_thresholds(long).collect()}
    for name in LABELS:
        scores = [(t, brute_f1(pairs[name], t)) for t in threshold_grid()]
        for t, f1 in scores:
            assert sweep[(name, t)] == pytest.approx(f1, abs=1e-12)
        want = max(scores, key=lambda e: (round(e[1], 12), -e[0]))
        assert best[name]["threshold"] == want[0]


def test_best_threshold_rules(spark):
    rows = [("none", 0, 0.9), ("none", 0, 0.2), ("tie", 1, 0.95), ("tie", 0, 0.05), ("edge", 1, 0.1)]
    df = spark.createDataFrame(rows, "label string, y int, prob double")
    got = {r["label"]: (r["threshold"], r["f1"]) for r in optimize_thresholds(df).collect()}
    assert got == {"none": (0.5, 0.0), "tie": (0.1, 1.0), "edge": (0.1, 1.0)}


def test_confusion_and_zero_division(spark):
    rows = [("a", 1, 0), ("a", 0, 0), ("b", 1, 1), ("b", 0, 1), ("b", 1, 0)]
    per_label = with_prf(confusion(spark.createDataFrame(rows, "label string, y int, pred int"), ["label"]))
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in per_label.collect()}
    assert got == {"a": (0.0, 0.0, 0.0), "b": (0.5, 0.5, 0.5)}
    assert macro(per_label).first()["f1"] == 0.25


def test_report(spark):
    rows = [(0, [1, 0], [1, 1]), (1, [1, 1], [0, 1]), (2, [0, 0], [0, 0]), (3, [0, 1], [0, 0])]
    df = spark.createDataFrame(rows, "id int, y array<int>, pred array<int>")
    got = {r["row"]: tuple(r)[1:] for r in classification_report(df, LABELS).collect()}
    assert got["toxic"] == pytest.approx((1.0, 0.5, 2 / 3, 2))
    assert got["insult"] == pytest.approx((0.5, 0.5, 0.5, 2))
    assert got["micro avg"] == pytest.approx((2 / 3, 0.5, 4 / 7, 4))
    assert got["macro avg"] == pytest.approx((0.75, 0.5, (2 / 3 + 0.5) / 2, 4))
    assert got["weighted avg"] == pytest.approx((0.75, 0.5, (2 / 3 + 0.5) / 2, 4))
    assert got["samples avg"] == pytest.approx((1.5 / 4, 1.5 / 4, (2 / 3 + 2 / 3) / 4, 4))


def test_empty_slice_is_null(spark):
    rows = [("short", "a", 1, 1)]
    per_label = with_prf(
        confusion(spark.createDataFrame(rows, "bucket string, label string, y int, pred int"), ["bucket", "label"])
    )
    got = {r["bucket"]: r["f1"] for r in bucket_macro(per_label).collect()}
    assert got == {"short": 1.0, "long": None}


def test_weights(spark):
    rows = [(int(i < 2), 0) for i in range(10)]
    df = spark.createDataFrame(rows, "toxic int, insult int")
    pos = {r["label"]: r["pos_weight"] for r in pos_weights(df, LABELS).collect()}
    assert pos["toxic"] == 8 / 2.000001 and pos["insult"] == 10 / 1e-6
    balanced = {(r["label"], r["y"]): r["weight"] for r in balanced_weights(df, LABELS).collect()}
    assert balanced == {("toxic", 1): 2.5, ("toxic", 0): 0.625, ("insult", 0): 0.5}


@pytest.mark.parametrize("n", [1, 31, 32, 33, 200, 224])
def test_batch_mean_equals_numbered_batches(spark, n):
    df = spark.createDataFrame([(i, (i * 37 % 101) / 10) for i in range(n)], "id long, loss double")
    fast = batch_mean_loss(df).first()
    means = batch_numbers(df).groupBy("batch").agg(F.avg("loss").alias("m"), F.count("*").alias("n"))
    slow = means.agg(F.avg("m").alias("m"), F.count("*").alias("b")).first()
    assert fast["batch_mean_loss"] == pytest.approx(slow["m"], abs=1e-12)
    assert fast["n_batches"] == slow["b"]
    assert sorted(r["n"] for r in means.collect())[1:] == [32] * (slow["b"] - 1)


def test_best_candidate(spark):
    schema = "candidate string, seq int, val_loss double"
    rows = [("e1", 0, 0.5), ("e2", 1, 0.4), ("e3", 2, 0.4), ("e4", 3, float("nan"))]
    assert tuple(best_candidate(spark.createDataFrame(rows, schema)).first()) == ("e2", 0.4)
    empty = best_candidate(spark.createDataFrame(rows[3:], schema)).first()
    assert empty["candidate"] is None


def test_flips_wide_equals_join(spark):
    rows = [(i, [i % 2, i % 3 == 0], [i % 2, i % 5 == 0]) for i in range(30)]
    rows = [(i, list(map(int, a)), list(map(int, b))) for i, a, b in rows]
    df = spark.createDataFrame(rows, "id int, pred array<int>, pred_noisy array<int>")
    as_prob = lambda c: df.select("id", F.col(c).alias("pred"))
    long = [scored_long(as_prob(c), LABELS, ["id"]) for c in ("pred", "pred_noisy")]
    joined = sorted(map(tuple, flips(*long, ["id", "label"]).collect()))
    assert joined == sorted(map(tuple, flips_wide(df, LABELS).collect()))


def test_predictions_default_threshold(spark):
    df = spark.createDataFrame([(0, [0.5, 0.49])], "id int, prob array<double>")
    assert predict_labels(df, LABELS).first()["pred"] == [1, 0]

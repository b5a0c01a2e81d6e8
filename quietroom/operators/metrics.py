"""Precision, recall and F1: per label, averaged, and as a report."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietroom.functions.scores import f1_of, ratio


def confusion(long: DataFrame, by: list[str]) -> DataFrame:
    """Counts per group from ``y`` and ``pred``; partially aggregated before the shuffle."""
    y, pred = F.col("y") == 1, F.col("pred") == 1
    return long.groupBy(*by).agg(
        F.count(F.when(y & pred, 1)).alias("tp"),
        F.count(F.when(~y & pred, 1)).alias("fp"),
        F.count(F.when(y & ~pred, 1)).alias("fn"),
        F.count(F.when(~y & ~pred, 1)).alias("tn"),
    )


def with_prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
    )


def macro(per_label: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Plain mean of the label scores."""
    aggs = [F.avg(m).alias(m) for m in ("f1", "precision", "recall")]
    return per_label.groupBy(*(by or [])).agg(*aggs)


def macro_metrics(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    return macro(with_prf(confusion(long, [*(by or []), "label"])), by)


def _total(items: list[Column]) -> Column:
    return reduce(add, items)


def classification_report(predicted: DataFrame, labels: list[str]) -> DataFrame:
    """Rows per label, then micro, macro, weighted and samples averages.

    ``predicted`` is wide (``y`` and ``pred`` arrays). One pass collects all
    counts, and the per-comment scores of the samples average, into a single row;
    the report rows are computed from that row.
    """
    y = [F.col("y")[i] for i in range(len(labels))]
    p = [F.col("pred")[i] for i in range(len(labels))]
    hits = _total([a * b for a, b in zip(y, p)])
    said, true = _total(p), _total(y)
    counts = []
    for i in range(len(labels)):
        counts += [
            F.coalesce(F.sum(y[i] * p[i]), F.lit(0)).alias(f"tp{i}"),
            F.coalesce(F.sum(p[i]), F.lit(0)).alias(f"pp{i}"),
            F.coalesce(F.sum(y[i]), F.lit(0)).alias(f"ap{i}"),
        ]
    total = predicted.agg(
        *counts,
        F.avg(ratio(hits, said)).alias("sp"),
        F.avg(ratio(hits, true)).alias("sr"),
        F.avg(ratio(2 * hits, said + true)).alias("sf"),
    )

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column):
        return F.struct(
            F.lit(name).alias("row"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("bigint").alias("support"),
        )

    n = len(labels)
    tp = [F.col(f"tp{i}") for i in range(n)]
    pp = [F.col(f"pp{i}") for i in range(n)]
    ap = [F.col(f"ap{i}") for i in range(n)]
    prec = [ratio(tp[i], pp[i]) for i in range(n)]
    rec = [ratio(tp[i], ap[i]) for i in range(n)]
    f1s = [ratio(2 * tp[i], pp[i] + ap[i]) for i in range(n)]
    support = _total(ap)

    def weighted(values: list[Column]) -> Column:
        return ratio(_total([v * s for v, s in zip(values, ap)]), support)

    def mean(values: list[Column]) -> Column:
        return _total(values) / F.lit(float(n))

    rows = [line(labels[i], prec[i], rec[i], f1s[i], ap[i]) for i in range(n)]
    rows += [
        line(
            "micro avg",
            ratio(_total(tp), _total(pp)),
            ratio(_total(tp), support),
            ratio(2 * _total(tp), _total(pp) + support),
            support,
        ),
        line("macro avg", mean(prec), mean(rec), mean(f1s), support),
        line("weighted avg", weighted(prec), weighted(rec), weighted(f1s), support),
        line("samples avg", F.col("sp"), F.col("sr"), F.col("sf"), support),
    ]
    return total.select(F.inline(F.array(*rows)))

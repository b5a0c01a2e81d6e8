"""Numeric, array and map expressions on logits and probabilities."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietroom.settings import DEFAULT_THRESHOLD


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(x: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    """Stable cross entropy on a logit, positives weighted."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return weight * y * softplus(-x) + (F.lit(1) - y) * softplus(x)


def ratio(num: Column, den: Column) -> Column:
    """Division where a zero denominator gives 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def steps_passed(prob: Column, edges: list[float]) -> Column:
    """How many of the ascending ``edges`` the probability reaches."""
    return reduce(add, [(prob >= F.lit(e)).cast("int") for e in edges])


def label_array(labels: list[str]) -> Column:
    return F.array(*[F.lit(name) for name in labels])


def scores_map(labels: list[str], probs: Column) -> Column:
    return F.map_from_arrays(label_array(labels), probs)


def map_get(scores: Column, key: Column | str, default: float) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.try_element_at(scores, key), F.lit(default))


def predictions_array(
    labels: list[str], probs: Column, thresholds: dict[str, float] | None = None
) -> Column:
    """0/1 per label in label order; a label without threshold uses 0.5."""
    limits = thresholds or {}
    return F.array(
        *[
            (probs[i] >= F.lit(float(limits.get(name, DEFAULT_THRESHOLD)))).cast("int")
            for i, name in enumerate(labels)
        ]
    )


def flag_list(
    labels: list[str], probs: Column, thresholds: dict[str, float] | None = None
) -> Column:
    """Names of the labels whose probability reaches its threshold, in label order."""
    limits = thresholds or {}
    bound = F.array(
        *[F.lit(float(limits.get(name, DEFAULT_THRESHOLD))) for name in labels]
    )
    zipped = F.arrays_zip(
        label_array(labels).alias("label"), probs.alias("prob"), bound.alias("bound")
    )
    hits = F.filter(zipped, lambda e: e["prob"] >= e["bound"])
    return F.transform(hits, lambda e: e["label"])


def any_over_half(probs: Column) -> Column:
    return F.exists(probs, lambda p: p > F.lit(0.5))


def verdict(flags: Column) -> Column:
    return F.when(F.size(flags) == 0, "safe").otherwise("toxic")

"""How far a fitted linear model is from the optimum of its objective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def objective_gradients(
    entries: DataFrame, totals: DataFrame, coefficients: DataFrame, labels: list[str], penalties: list[float]
) -> DataFrame:
    """``label, idx, gradient``: the derivative of the mean penalised loss by each coefficient.

    ``entries`` has ``idx, value`` and a residual column ``_g<i>`` per label (weight times predicted
    minus true) for every stored entry of every row; sums combine before the one shuffle, by ``idx``.
    ``totals`` is one row with the summed weights ``_w<i>``, ``coefficients`` has ``idx`` and a
    column per label.
    """
    sums = entries.groupBy("idx").agg(
        *[F.sum(F.col("value") * F.col(f"_g{i}")).alias(f"_s{i}") for i in range(len(labels))]
    )

    def gradient(i: int) -> Column:
        total = F.lit(totals.select(f"_w{i}").scalar())
        mean = F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) / total
        return mean + F.lit(penalties[i]) * F.col(labels[i])

    pairs = [
        F.struct(F.lit(name).alias("label"), gradient(i).alias("gradient"))
        for i, name in enumerate(labels)
    ]
    joined = coefficients.join(sums, "idx", "left")
    return joined.select("idx", F.inline(F.array(*pairs))).select("label", "idx", "gradient")


def certificate(gradients: DataFrame, penalties: dict[str, float]) -> DataFrame:
    """``label, n_features, max_gradient, gap``: how well each label's model is fitted.

    The objective is strongly convex in the penalised coefficients, with the penalty as modulus: at
    a given intercept it lies at most ``gap``, the squared norm of the gradient over twice the penalty,
    above its least value.
    """
    half = F.create_map(*[F.lit(x) for name, p in penalties.items() for x in (name, 2.0 * p)])
    return gradients.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.max(F.abs("gradient")).alias("max_gradient"),
        (F.sum(F.col("gradient") ** 2) / F.first(half[F.col("label")])).alias("gap"),
    )

"""Evaluation reports and thresholds as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.session import join_bounded
from quietroom.settings import DEFAULT_THRESHOLD
from quietroom.sources.comments import path_exists

# Fixed layout of a report.
REPORT_SCHEMA = (
    "thresholds map<string,double>, "
    "metrics struct<f1:double,precision:double,recall:double,roc_auc:double,pr_auc:double>, "
    "robustness struct<short_f1:double,long_f1:double,noisy_f1:double,noise_drop:double>"
)


def report_to_json(report: DataFrame) -> DataFrame:
    """One JSON string per report row; empty slices are written as null."""
    return report.select(
        F.to_json(
            F.struct("thresholds", "metrics", "robustness"), {"ignoreNullFields": "false"}
        ).alias("report")
    )


def report_from_json(reports: DataFrame) -> DataFrame:
    return reports.select(F.from_json("report", REPORT_SCHEMA).alias("r")).select("r.*")


def write_report(report: DataFrame, path: str) -> None:
    report_to_json(report).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST")
    return reader.json(path)


def label_table(spark: SparkSession, labels: list[str]) -> DataFrame:
    """The label names with their positions; one row per label column."""
    return spark.createDataFrame(
        [(i, name) for i, name in enumerate(labels)], "position int, label string"
    )


def with_default_thresholds(
    thresholds: DataFrame, labels: list[str], default: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """One row per label; a label without threshold gets the default."""
    base = label_table(thresholds.sparkSession, labels).select("label")
    known = thresholds.where(F.col("label").isin(labels)).select("label", "threshold")
    return join_bounded(base, known, "label", "left", len(labels)).select(
        "label", F.coalesce("threshold", F.lit(default)).alias("threshold")
    )


def load_thresholds(spark: SparkSession, path: str, labels: list[str]) -> dict[str, float]:
    """Thresholds of a written report; 0.5 for absent labels or an absent report.

    A report that is there but cannot be read is an error.
    """
    row = None
    if path_exists(spark, path):
        row = read_report(spark, path).select("thresholds").first()
    known = (row and row["thresholds"]) or {}
    return {name: known.get(name, DEFAULT_THRESHOLD) for name in labels}

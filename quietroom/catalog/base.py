"""Registry, shared inputs and shared SQL pieces of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.functions.hashing import hash_score
from quietroom.operators.reshape import label_values, scored_long
from quietroom.session import dealt
from quietroom.settings import threshold_grid
from quietroom.sources.comments import labelled_comments, split_comments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LABELS = ["toxic", "quality"]


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """``id, comment_text, toxic, quality`` of the labelled documents."""
    docs = dealt(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return labelled_comments(docs, table(spark, sf, "labels"), LABELS)


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents with their split."""
    docs = dealt(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return split_comments(docs, table(spark, sf, "labels"), LABELS)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").withColumnRenamed("doc_id", "id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents for work on their texts."""
    return dealt(documents(spark, sf), "id")


def probabilities(*salt: str, key: str = "id") -> Column:
    return F.array(*[hash_score(*salt, name, F.col(key)) for name in LABELS])


def scored(spark: SparkSession, sf: str, *salt: str) -> DataFrame:
    """Labelled ids with hash scores, wide."""
    return labels(spark, sf).select(
        "id", "toxic", label_values(LABELS).alias("y"), probabilities(*salt).alias("prob")
    )


def long_scores(spark: SparkSession, sf: str, *salt: str) -> DataFrame:
    return scored_long(scored(spark, sf, *salt), LABELS, ["id"])


def r(col: Column | str, digits: int = 9) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


# --- SQL pieces -----------------------------------------------------------------


def sql_digest(*parts: str) -> str:
    return "md5(concat_ws('|', '42', " + ", ".join(parts) + "))"


def sql_number(digest: str) -> str:
    return f"CAST('0x' || substr({digest}, 1, 8) AS BIGINT)"


def sql_score(*parts: str) -> str:
    return f"(({sql_number(sql_digest(*parts))} % 50) / 50.0::DOUBLE)"


def sql_clean(text: str) -> str:
    return rf"coalesce(trim(regexp_replace(lower({text}), '\s+', ' ', 'g')), 'nan')"


def sql_words(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '\S+'))"


def sql_bucket(words: str) -> str:
    return f"CASE WHEN {words} < 20 THEN 'short' WHEN {words} > 100 THEN 'long' ELSE 'mid' END"


def sql_tokens(text: str) -> str:
    return rf"regexp_extract_all({sql_clean(text)}, '[\p{{L}}\p{{N}}_]{{2,}}')"


def sql_swap(text: str, key: str) -> str:
    at = f"({sql_number(sql_digest(key))} % greatest(length({text}) - 1, 1))::INTEGER"
    return (
        f"CASE WHEN length({text}) < 2 THEN {text} ELSE substr({text}, 1, {at}) "
        f"|| substr({text}, {at} + 2, 1) || substr({text}, {at} + 1, 1) "
        f"|| substr({text}, {at} + 3) END"
    )


def sql_long(*salt: str, extra: str = "") -> str:
    """``doc_id, label, y, prob`` from the labels table."""
    parts = [
        f"SELECT doc_id, '{name}' AS label, {name} AS y, "
        f"{sql_score(*[repr(s) for s in salt], repr(name), 'doc_id')} AS prob{extra} FROM labels"
        for name in LABELS
    ]
    return " UNION ALL ".join(parts)


SQL_GRID = (
    "SELECT i, 0.1::DOUBLE + i * ((0.1::DOUBLE + 0.05::DOUBLE) - 0.1::DOUBLE) AS threshold "
    f"FROM range({len(threshold_grid())}) g(i)"
)

SQL_SPLIT = (
    "SELECT doc_id, toxic, quality, CASE WHEN rn * 10 <= 8 * n THEN 'train' "
    "WHEN rn * 10 <= 9 * n THEN 'val' ELSE 'test' END AS split FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY {sql_digest('doc_id')}, doc_id) AS rn, "
    "count(*) OVER (PARTITION BY toxic) AS n FROM labels)"
)

SQL_COMMENTS = (
    "SELECT d.doc_id, d.text, l.toxic, l.quality FROM documents d JOIN labels l USING (doc_id)"
)


def sql_ratio(num: str, den: str) -> str:
    return f"coalesce(({num})::DOUBLE / nullif({den}, 0), 0.0::DOUBLE)"


def sql_confusion(source: str, by: str) -> str:
    """Confusion counts and scores of a relation with ``y`` and ``pred``."""
    counts = (
        f"SELECT {by}, count(*) FILTER (y = 1 AND pred = 1) AS tp, "
        f"count(*) FILTER (y = 0 AND pred = 1) AS fp, "
        f"count(*) FILTER (y = 1 AND pred = 0) AS fn, "
        f"count(*) FILTER (y = 0 AND pred = 0) AS tn FROM {source} GROUP BY {by}"
    )
    return (
        f"SELECT *, {sql_ratio('tp', 'tp + fp')} AS precision, "
        f"{sql_ratio('tp', 'tp + fn')} AS recall, "
        f"{sql_ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM ({counts})"
    )


def sql_curves(source: str, by: str) -> str:
    """ROC-AUC and average precision of a relation with ``y`` and ``prob``."""
    return f"""
      SELECT {by}, CASE WHEN max(pa) > 0 AND max(na) > 0 THEN
               sum(pos * (na - (seen - tp) + (n - pos) / 2.0::DOUBLE)) / (max(pa) * max(na)) END AS roc_auc,
             CASE WHEN max(pa) > 0 AND max(na) > 0 THEN
               sum(pos * (tp::DOUBLE / seen)) / max(pa) END AS average_precision
      FROM (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen,
                   sum(pos) OVER (PARTITION BY {by}) AS pa,
                   sum(n - pos) OVER (PARTITION BY {by}) AS na
            FROM (SELECT {by}, prob, count(*) FILTER (y = 1) AS pos, count(*) AS n
                  FROM {source} GROUP BY {by}, prob)
            WINDOW w AS (PARTITION BY {by} ORDER BY prob DESC
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      GROUP BY {by}"""


def sql_best(sweep: str) -> str:
    """Lowest threshold of best F1 per label from ``label, threshold, f1``."""
    return (
        "SELECT label, CASE WHEN f1 > 0 THEN threshold ELSE 0.5::DOUBLE END AS threshold, f1 "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold) AS r "
        f"FROM ({sweep})) WHERE r = 1"
    )


def sql_sweep(source: str) -> str:
    """Scores of every label at every grid threshold of a relation with ``y`` and ``prob``."""
    at = f"(SELECT label, threshold, y, (prob >= threshold)::INTEGER AS pred FROM {source}, ({SQL_GRID}))"
    return sql_confusion(at, "label, threshold")

"""Readers for labelled and unlabelled comment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietroom.operators.split import stratified_split
from quietroom.session import materialize
from quietroom.sources.records import csv_records


class MissingLabels(ValueError):
    """Raised when a required label column is absent."""


def missing_labels(df: DataFrame, label_cols: list[str]) -> list[str]:
    return [name for name in label_cols if name not in df.columns]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system of ``path`` has it; any other trouble is an error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


DAMAGED = "_damaged"


def csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """All columns as STRING in file order, and one for lines that do not fit them.

    Only the header line is read.
    """
    header = spark.read.option("header", True).csv(path).columns
    return T.StructType([T.StructField(name, T.StringType()) for name in [*header, DAMAGED]])


def label_value(text: Column) -> Column:
    """0 or 1 of ``0``, ``1``, ``0.0`` or ``1.0``, else NULL."""
    body = F.trim(text)
    return F.when(body.isin("0", "0.0"), 0).when(body.isin("1", "1.0"), 1)


def read_csv_rows(
    spark: SparkSession,
    path: str,
    label_cols: list[str] | None = None,
    multi_line: bool = True,
    null_value: str | None = None,
    split_files: bool = False,
) -> DataFrame:
    """The rows of the files with ``reason``: NULL, ``malformed`` or ``label:<name>``.

    Labels become INT. Files whose header has other columns, or another order, are an error.
    ``split_files`` reads files with line breaks in their texts in splits; see ``csv_records`` for
    what it asks of the quotes.
    """
    schema = csv_schema(spark, path)
    options = {"columnNameOfCorruptRecord": DAMAGED, "quote": '"', "escape": '"'}
    if null_value is not None:
        options["nullValue"] = null_value
    if split_files:
        rows = _split_rows(spark, path, schema, options)
    else:
        reader = spark.read.schema(schema).options(**options)
        rows = reader.options(header=True, enforceSchema=False, multiLine=multi_line).csv(path)
    names = [c for c in label_cols or [] if c in rows.columns]
    wrong = [
        F.when(F.col(c).isNotNull() & label_value(F.col(c)).isNull(), f"label:{c}") for c in names
    ]
    reason = F.coalesce(F.when(F.col(DAMAGED).isNotNull(), "malformed"), *wrong)
    checked = rows.withColumn("reason", reason).drop(DAMAGED)
    return checked.withColumns({c: label_value(F.col(c)) for c in names})


def _split_rows(
    spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str]
) -> DataFrame:
    """The rows of ``csv_records``, parsed; a header that is not that of ``schema`` is an error."""
    ddl = ", ".join(f"`{field.name}` string" for field in schema)
    row = F.from_csv("record", F.lit(ddl), {**options, "multiLine": "true"})
    parsed = csv_records(spark, path).select("header", row.alias("row"))
    named = F.array(*[F.col("row").getField(name) for name in schema.names[:-1]])
    wanted = F.array(*[F.lit(name) for name in schema.names[:-1]])
    damaged = F.col("row").getField(DAMAGED).isNotNull()
    wrong = F.col("header") & (damaged | ~named.eqNullSafe(wanted))
    checked = F.when(wrong, F.raise_error(F.lit(f"CSV header does not conform: {path}")).cast("boolean"))
    return parsed.where(F.coalesce(checked, ~F.col("header"))).select("row.*")


def read_comments_csv(
    spark: SparkSession,
    path: str,
    label_cols: list[str] | None = None,
    text_col: str = "comment_text",
    id_col: str = "id",
    multi_line: bool = True,
    null_value: str | None = None,
    split_files: bool = False,
) -> DataFrame:
    """Comments as ``id, comment_text, <labels>``; without labels when none are asked for.

    ``multi_line`` is needed for texts with line breaks and makes each file one
    task; ``split_files`` reads such files in splits. Rows of a file
    without an id column are numbered and stored once in the shared folder: copies
    of a text stay different rows, and the numbers stay the same for every later job.
    Rows that ``read_csv_rows`` gives a reason are left out.
    """
    rows = read_csv_rows(spark, path, label_cols, multi_line, null_value, split_files)
    rows = rows.where(F.col("reason").isNull()).drop("reason")
    if id_col in rows.columns:
        return project_comments(rows, label_cols, text_col, id_col)
    numbered = rows.withColumn(id_col, F.monotonically_increasing_id())
    return materialize(
        project_comments(numbered, label_cols, text_col, id_col), "numbered-comments"
    )


def project_comments(
    df: DataFrame,
    label_cols: list[str] | None = None,
    text_col: str = "comment_text",
    id_col: str = "id",
) -> DataFrame:
    """Keep the key, the text and the label columns."""
    absent = missing_labels(df, label_cols or [])
    if absent:
        raise MissingLabels(f"label columns not found: {', '.join(absent)}")
    return df.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("comment_text"), *(label_cols or [])
    )


def labelled_comments(
    documents: DataFrame, labels: DataFrame, label_cols: list[str], key: str = "doc_id"
) -> DataFrame:
    """Texts joined with their labels on the key.

    No broadcast hint: the label side grows with the texts, so the planner
    decides from its measured size.
    """
    joined = documents.select(key, "text").join(labels.select(key, *label_cols), key)
    return joined.select(
        F.col(key).alias("id"), F.col("text").alias("comment_text"), *label_cols
    )


def split_comments(
    documents: DataFrame, labels: DataFrame, label_cols: list[str], key: str = "doc_id"
) -> DataFrame:
    """Labelled comments with their ``split``, decided on the label table alone.

    Splitting before the join keeps texts out of it, and a filter on ``split``
    reaches the label side before the texts are joined.
    """
    parts = stratified_split(labels.select(key, *label_cols), key, label_cols[0])
    return labelled_comments(documents, parts, [*label_cols, "split"], key)


def unlabelled_comments(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id"
) -> DataFrame:
    rest = documents.select(key, "text").join(labels.select(key), key, "left_anti")
    return rest.select(F.col(key).alias("id"), F.col("text").alias("comment_text"))

"""Reading, profiling, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietroom.catalog.base import (
    LABELS,
    ORACLES,
    SQL_COMMENTS,
    SQL_SPLIT,
    comments,
    documents,
    labels,
    parts,
    query,
    r,
    sql_digest,
    sql_number,
    table,
)
from quietroom.operators import profile
from quietroom.operators.ranking import batch_numbers, hash_position
from quietroom.operators.reshape import labels_long
from quietroom.operators.split import hash_split, in_split, stratified_split
from quietroom.session import work_path
from quietroom.sources.comments import (
    missing_labels,
    path_exists,
    read_comments_csv,
    read_csv_rows,
    unlabelled_comments,
)


@query(
    "load_comments",
    "SELECT doc_id AS id, text AS comment_text, toxic, quality FROM documents JOIN labels USING (doc_id)",
)
def load_comments(spark, sf):
    return comments(spark, sf)


@query(
    "load_comments_csv",
    "SELECT CAST(doc_id AS VARCHAR) AS id, text AS comment_text, toxic, quality "
    "FROM documents JOIN labels USING (doc_id)",
)
def load_comments_csv(spark, sf):
    """The labelled table written as quoted CSV and read back with the CSV reader."""
    path = work_path(spark, "comments-csv")
    comments(spark, sf).write.options(header="true", quote='"', escape='"', quoteAll="true").csv(path)
    return read_comments_csv(spark, path, LABELS)


@query("split_comments_csv", ORACLES["load_comments_csv"])
def split_comments_csv(spark, sf):
    """The same CSV, one file for each task of the join, read in splits of files; line breaks and quotes are in the texts."""
    path = work_path(spark, "large-comments-csv")
    rows = comments(spark, sf)
    rows.write.options(header="true", quote='"', escape='"', quoteAll="true").csv(path)
    return read_comments_csv(spark, path, LABELS, split_files=True)


@query(
    "unlabelled_comments",
    "SELECT doc_id AS id, text AS comment_text FROM documents "
    "WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def unlabelled(spark, sf):
    return unlabelled_comments(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query(
    "missing_labels",
    "SELECT count(*) AS n_rows, 'threat' AS missing, true AS found, false AS found_other FROM labels",
)
def missing(spark, sf):
    frame = labels(spark, sf)
    return frame.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(",".join(missing_labels(frame, [*LABELS, "threat"]))).alias("missing"),
        F.lit(path_exists(spark, f"{sf}/labels.parquet")).alias("found"),
        F.lit(path_exists(spark, f"{sf}/no_such_table.parquet")).alias("found_other"),
    )


@query(
    "table_shape",
    "SELECT count(*) AS n_rows, 4 AS n_columns, 'id,comment_text,toxic,quality' AS columns "
    f"FROM ({SQL_COMMENTS})",
)
def table_shape(spark, sf):
    return profile.table_shape(comments(spark, sf))


@query(
    "head5",
    "SELECT doc_id AS id, text AS comment_text, toxic, quality FROM documents "
    "JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 5",
)
def head5(spark, sf):
    return profile.head(comments(spark, sf))


@query(
    "labels_long",
    "SELECT doc_id AS id, 'toxic' AS label, toxic AS y FROM labels "
    "UNION ALL SELECT doc_id, 'quality', quality FROM labels",
)
def long_labels(spark, sf):
    return labels_long(labels(spark, sf), LABELS, ["id"])


_DISTRIBUTION = " UNION ALL ".join(
    f"SELECT '{c}' AS label, count(*) AS n_rows, CAST(sum({c}) AS BIGINT) AS positives FROM labels"
    for c in LABELS
)


@query(
    "label_distribution",
    f"SELECT *, round(positives::DOUBLE / n_rows, 9) AS share FROM ({_DISTRIBUTION})",
)
def label_distribution(spark, sf):
    return profile.label_distribution(labels(spark, sf), LABELS).withColumn("share", r("share"))


@query(
    "label_report",
    f"SELECT n_rows, label, true AS found, positives FROM ({_DISTRIBUTION}) UNION ALL "
    "SELECT count(*), 'threat', false, NULL::BIGINT FROM labels",
)
def label_report(spark, sf):
    """The labels that exist, counted, and those that do not, named."""
    return profile.label_report(labels(spark, sf), [*LABELS, "threat"])


_ODD = "CASE WHEN doc_id % 7 = 0 THEN 'yes' WHEN doc_id % 3 = 0 THEN toxic || '.0' ELSE toxic || '' END"


@query(
    "csv_rejects",
    "SELECT CASE WHEN doc_id % 7 = 0 THEN 'label:toxic' END AS reason, count(*) AS n_rows, "
    "count(*) FILTER (doc_id % 7 <> 0 AND toxic = 1) AS n_toxic, sum(length(text))::BIGINT AS n_chars "
    "FROM documents JOIN labels USING (doc_id) GROUP BY 1",
)
def csv_rejects(spark, sf):
    """Labels written in three ways, one of them wrong: what the CSV reader takes and refuses."""
    path = work_path(spark, "odd-csv")
    odd = F.expr(_ODD.replace("doc_id", "id"))
    # White space inside quotes is kept; line breaks and quotes are part of the texts.
    comments(spark, sf).withColumn("toxic", odd).write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    rows = read_csv_rows(spark, path, LABELS)
    return rows.groupBy("reason").agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(F.col("toxic") == 1, 1)).alias("n_toxic"),
        F.sum(F.char_length("comment_text")).alias("n_chars"),
    )


@query(
    "pos_weight",
    "SELECT label, round((n_rows - positives) / (positives + 0.000001::DOUBLE), 9) AS pos_weight "
    f"FROM ({_DISTRIBUTION})",
)
def pos_weight(spark, sf):
    weights = profile.pos_weights(labels(spark, sf), LABELS)
    return weights.select("label", r("pos_weight").alias("pos_weight"))


@query(
    "balanced_weights",
    "SELECT label, y, round(n_rows / (2.0::DOUBLE * n), 9) AS weight FROM ("
    f"SELECT label, n_rows, 1 AS y, positives AS n FROM ({_DISTRIBUTION}) UNION ALL "
    f"SELECT label, n_rows, 0, n_rows - positives FROM ({_DISTRIBUTION}))",
)
def balanced_weights(spark, sf):
    weights = profile.balanced_weights(labels(spark, sf), LABELS)
    return weights.withColumn("weight", r("weight"))


@query(
    "hash_split",
    f"SELECT doc_id AS id, CASE WHEN {sql_number(sql_digest('doc_id'))} % 100 < 80 "
    "THEN 'train' ELSE 'test' END AS split FROM documents",
)
def split_by_hash(spark, sf):
    return documents(spark, sf).select("id", hash_split(F.col("id")).alias("split"))


@query("stratified_split", f"SELECT doc_id AS id, toxic, split FROM ({SQL_SPLIT})")
def split_stratified(spark, sf):
    return stratified_split(labels(spark, sf).select("id", "toxic"))


@query(
    "split_sizes", f"SELECT split, count(*) AS n_rows FROM ({SQL_SPLIT}) GROUP BY split"
)
def split_sizes(spark, sf):
    rows = stratified_split(labels(spark, sf).select("id", "toxic"))
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"))


@query(
    "split_filter",
    "SELECT s.doc_id AS id, d.text AS comment_text, s.toxic, s.quality "
    f"FROM ({SQL_SPLIT}) s JOIN documents d USING (doc_id) WHERE split = 'test'",
)
def split_filter(spark, sf):
    return in_split(parts(spark, sf), "test").drop("split")


@query(
    "split_disjoint",
    "SELECT count(*) AS n_rows, count(*) AS n_union, 0::BIGINT AS n_shared, 0::BIGINT AS n_lost "
    "FROM labels",
)
def split_disjoint(spark, sf):
    """Parts share no id and together are the table: one count of parts per id."""
    base = labels(spark, sf).select("id", "toxic")
    given = base.select("id", F.lit(1).alias("row"), F.lit(None).cast("string").alias("split"))
    placed = stratified_split(base).select("id", F.lit(0).alias("row"), "split")
    per_id = given.unionByName(placed).groupBy("id").agg(
        F.sum("row").alias("rows"), F.collect_set("split").alias("parts")
    )
    parts = F.size("parts")
    return per_id.agg(
        F.sum("rows").alias("n_rows"),
        F.count(F.when(parts > 0, 1)).alias("n_union"),
        F.count(F.when(parts > 1, 1)).alias("n_shared"),
        F.count(F.when(parts == 0, 1)).alias("n_lost"),
    )


@query(
    "shuffled_rows",
    f"SELECT doc_id AS id, row_number() OVER (ORDER BY {sql_digest('doc_id')}, doc_id) AS position "
    "FROM documents",
)
def shuffled_rows(spark, sf):
    return hash_position(documents(spark, sf).select("id"))


@query(
    "batch_numbers",
    f"SELECT doc_id AS id, (row_number() OVER (ORDER BY {sql_digest('doc_id')}, doc_id) - 1) // 32 AS batch "
    "FROM documents",
)
def numbered_batches(spark, sf):
    return batch_numbers(documents(spark, sf).select("id"))

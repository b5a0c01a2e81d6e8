"""Line dedup over levelled, sorted runs of line hashes. DataFrame functions only.

The index is a set of runs: parquet tables of ``(h1, h2, n_docs, keeper)`` sorted by the
128-bit line hash. A batch of documents merge-anti-joins the runs, so lines whose fate is
settled are not written again, and adds what is left as a run of level 0; ``fanout`` runs of
one level are merged into one run of the next. Batches come by descending id, so the first
run that holds a line also holds its keeper.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.llm.base import query, shared_path, table
from quietroom.session import drop_folder, shuffles_released

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2

HASH = ["h1", "h2"]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the built-in; others replace letter by letter."""
    slow = text
    for code in range(ord("A"), ord("Z") + 1):
        slow = F.replace(slow, F.lit(chr(code)), F.lit(chr(code + 32)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def merge_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*HASH).agg(
        F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")
    )


@dataclass
class LineRuns:
    """The levelled runs below one folder."""

    spark: SparkSession
    root: str
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)
    made: int = 0

    SCHEMA = "h1 bigint, h2 bigint, n_docs bigint, keeper bigint"

    def _write(self, run: DataFrame, level: int) -> str:
        path = f"{self.root}/level{level}-{self.made}"
        self.made += 1
        with shuffles_released(self.spark):
            run.repartition(*HASH).sortWithinPartitions(*HASH).write.parquet(path)
        return path

    def read(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else None

    def settled(self, min_docs: int) -> DataFrame | None:
        runs = self.read()
        return None if runs is None else merge_runs(runs).where(F.col("n_docs") >= min_docs)

    def add(self, keys: DataFrame, min_docs: int) -> None:
        """Add a batch's ``(h1, h2, n_docs, keeper)`` rows that are not settled yet."""
        known = self.settled(min_docs)
        fresh = keys if known is None else keys.join(known.hint("merge"), HASH, "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(fresh, 0))
        self.compact()

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                merged = merge_runs(self.spark.read.schema(self.SCHEMA).parquet(*old))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(merged, level + 1))
                self.levels[level] = []
                for path in old:
                    drop_folder(self.spark, path)
            level += 1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key() -> Column:
    """Tells rows apart that share an id; equal rows are treated alike."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, rk, h1, h2, pos`` of every line whose key has at least ``min_chars`` characters."""
    keyed = F.transform(
        split_lines(ascii_lower(F.col("text"))),
        lambda line, i: F.struct(F.btrim(line, F.lit(SPACE)).alias("key"), i.alias("pos")),
    )
    lines = docs.select("doc_id", row_key().alias("rk"), F.inline(keyed))
    return lines.where(F.char_length("key") >= min_chars).select(
        "doc_id", "rk", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "pos"
    )


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ascending ids that cut the documents into batches of about equal counts."""
    shares = [i / batches for i in range(1, batches)]
    cut = docs.select(F.percentile_approx("doc_id", shares, 1000).alias("c")).first()["c"]
    return sorted(set(cut or []))


def line_dedup(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Drop lines that many documents share, except in the largest ``doc_id`` holding them.

    Takes ``doc_id, text`` and any further columns, which pass through unless they are named like
    the results; returns them with ``kept`` (the text without its dropped lines), ``n_lines`` and
    ``n_dropped``. A line's key is the line without surrounding white space and with A-Z
    lower-cased; keys shorter than ``min_chars`` characters never go. A null text counts as one
    empty line and gives an empty ``kept``. Rows with one id are one document: it counts once, and
    if it is the keeper, all its rows keep the line. A null id counts as one document that is
    smaller than all others. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept", "n_lines", "n_dropped")
    root = shared_path(spark, "line-runs")
    slim = docs.select("doc_id", "text")
    bounds = batch_bounds(slim, batches)
    number = F.lit(0)
    for bound in bounds:
        number = number + F.when(F.col("doc_id") > bound, 1).otherwise(0)
    lines_path = f"{root}/lines"
    line_table(slim, min_chars).withColumn("batch", F.coalesce(number, F.lit(0))).write.partitionBy(
        "batch"
    ).parquet(lines_path)
    lines = spark.read.schema(
        "doc_id bigint, rk bigint, h1 bigint, h2 bigint, pos int, batch int"
    ).parquet(lines_path)

    runs = LineRuns(spark, root, fanout)
    for batch in reversed(range(len(bounds) + 1)):
        once = lines.where(F.col("batch") == batch).select(*HASH, "doc_id").distinct()
        keys = once.groupBy(*HASH).agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")
        )
        runs.add(keys, min_docs)

    # A keeper can be missing only where every holder has a null id; then nothing is shared.
    doomed = runs.settled(min_docs).select(*HASH, "keeper")
    drops = (
        lines.join(doomed, HASH)
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .select("doc_id", "rk", "pos")
        .groupBy("doc_id", "rk")
        .agg(F.collect_set("pos").alias("__drop"))
        .select(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk"), "__drop")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (row_key() == F.col("__rk"))
    lines_of = split_lines(F.col("text"))
    joined = docs.join(drops.hint("shuffle_hash"), same, "left")
    stays = F.array_except(
        F.sequence(F.lit(0), F.size("__lines") - 1),
        F.coalesce("__drop", F.array().cast("array<int>")),
    )
    return (
        joined.withColumn("__lines", lines_of)
        .withColumn(
            "kept",
            F.when(F.col("__drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(
                F.array_join(F.transform(stays, lambda i: F.get("__lines", i)), "\n")
            ),
        )
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("long"))
        .drop("__lines", "__drop", "__id", "__rk")
    )


# White space and lower case as the contract names them, not as Unicode does.
_KEY = (
    "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),"
    " 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

_LINES = f"""
    lines AS (
        SELECT doc_id, line, pos, {_KEY} AS key FROM (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM {{docs}})),
    shared AS (
        SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= {MIN_CHARS}
        GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
    marked AS (
        SELECT doc_id, line, pos, coalesce(keeper <> doc_id, false) AS gone
        FROM lines LEFT JOIN shared USING (key)),
    deduped AS (
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
        FROM marked GROUP BY doc_id)
"""

ORACLE = f"""
    WITH {_LINES.format(docs="documents")}
    SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped
"""


@query("op1_line_dedup", ORACLE)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )

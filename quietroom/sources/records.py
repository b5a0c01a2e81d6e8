"""Quoted CSV with line breaks in its texts, read in splits.

Whether a line begins a record depends on whether the quotes before it in its file are balanced, so
files are read as lines, whose quotes are counted per split; a running sum over the splits of a file
says for each whether it starts inside quotes. With that, every split puts its own records together.
What is cut by the end of a split, at most one piece at either end, is joined with what follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietroom.session import join_bounded, materialize
from quietroom.settings import BROADCAST_ROWS

SPLIT = ["file", "block"]
# How a piece of a record meets the ends of its split.
WHOLE, HEAD, TAIL, THROUGH = range(4)
_PIECES = "file string, block bigint, at bigint, kind int, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, block, quotes``: lines in file order within each split."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    bare = F.replace("value", F.lit('"'), F.lit(""))
    return lines.withColumn("quotes", F.octet_length("value") - F.octet_length(bare))


def split_states(lines: DataFrame) -> DataFrame:
    """``file, block, inside``: whether each split starts inside quotes; a row for each split."""
    counts = lines.groupBy(*SPLIT).agg((F.sum("quotes") % 2).alias("odd"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    return counts.select(*SPLIT, inside.cast("int").alias("inside"))


class _Assembly:
    """Puts the lines of one split together, as they come in."""

    def __init__(self, file: str, block: int, inside: int):
        self.key, self.inside = (file, block), inside
        self.at, self.pending, self.begun_here = 0, [], not inside

    def _piece(self, kind: int, text: str):
        at = self.at
        self.at += 1
        return (*self.key, at, kind, text)

    def lines(self, values: list[str], quotes: np.ndarray) -> Iterator[tuple]:
        after = (self.inside + np.cumsum(quotes)) % 2
        ends = np.flatnonzero(after == 0)
        first = 0
        for end in ends.tolist():
            if self.pending or end > first:
                text = "\n".join([*self.pending, *values[first : end + 1]])
            else:
                text = values[end]
            self.pending = []
            if self.begun_here:
                if text.strip():  # blank lines between records are none
                    yield self._piece(WHOLE, text)
            else:
                yield self._piece(HEAD, text)
                self.begun_here = True
            first = end + 1
        self.pending += values[first:]
        self.inside = int(after[-1])

    def rest(self) -> Iterator[tuple]:
        if self.pending:
            yield self._piece(TAIL if self.begun_here else THROUGH, "\n".join(self.pending))


def _pieces(lines: DataFrame, kinds: list[int]) -> DataFrame:
    """Records of lines with ``inside``, and pieces of such as are cut, of the kinds asked for."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        rows = [row for row in rows if row[3] in kinds]
        names = [c.split()[0] for c in _PIECES.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        now = None
        for batch in batches:
            values = batch.column("value").to_pylist()
            quotes = batch.column("quotes").to_numpy()
            inside = batch.column("inside").to_pylist()
            files = batch.column("file").to_numpy(zero_copy_only=False)
            blocks = batch.column("block").to_numpy()
            new = np.ones(len(values), bool)
            new[1:] = (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])
            starts = [*np.flatnonzero(new).tolist(), len(values)]
            rows = []
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                key = (files[low], int(blocks[low]))
                if now is None or now.key != key:
                    if now is not None:
                        rows += now.rest()
                    now = _Assembly(*key, inside[low])
                rows += now.lines(values[low:high], quotes[low:high])
            yield block(rows)
        if now is not None:
            yield block(list(now.rest()))

    return lines.select("value", *SPLIT, "quotes", "inside").mapInArrow(run, _PIECES)


def _stitched(cut: DataFrame) -> DataFrame:
    """Records from the pieces of such as reach over splits; a piece that begins one is a TAIL."""
    order = W.partitionBy("file").orderBy("block", "at")
    numbered = cut.withColumn(
        "number", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order)
    )
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "record")))
    return numbered.groupBy("file", "number").agg(parts.alias("parts")).select(
        "file",
        F.col("parts")[0]["block"].alias("block"),
        F.col("parts")[0]["at"].alias("at"),
        F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"),
    )


def csv_records(spark: SparkSession, path: str, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """``record, header`` of quoted CSV files: one row for each record, in as many tasks as splits.

    Records end with a line feed outside quotes, which may follow a carriage return; blank lines
    between them are left out; line breaks within quotes stay as they are. ``header`` marks the first record of a file. Quotes may stand only
    around whole fields and, doubled, within them, as the format demands: a stray one makes all that
    follows in its file unreadable. A quote that is never closed makes the rest of the file one
    record. ``max_broadcast`` bounds the number of splits whose states are broadcast; beyond it, lines
    are shuffled to their split's state.
    """
    lines = _lines(spark, path)
    states = materialize(split_states(lines), "split-states")
    splits = states.count()
    if splits <= max_broadcast:
        known = join_bounded(lines, states, SPLIT, "inner", splits)
    else:
        placed = lines.withColumn("_place", F.monotonically_increasing_id())
        known = placed.join(states, SPLIT).repartition(*SPLIT).sortWithinPartitions(*SPLIT, "_place")
    columns = ["block", "at", "record"]
    whole = _pieces(known, [WHOLE]).select(*columns)
    cut = _stitched(_pieces(known, [HEAD, TAIL, THROUGH])).select(*columns)
    records = whole.unionByName(cut)
    bare = F.when(
        F.endswith("record", F.lit("\r")), F.expr("left(record, char_length(record) - 1)")
    ).otherwise(F.col("record"))
    first = (F.col("block") == 0) & (F.col("at") == 0)
    return records.select(bare.alias("record"), first.alias("header"))

"""Registry and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietroom.session import materialize, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Rows whose crc32(doc_id as text) leaves this remainder modulo 3 are held out from every fit.
HELD_OUT = 1


def query(name: str, oracle: str | None = None):
    """Register a query and, where SQL can express it, the SQL that checks it."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, there until ``session.release_work``."""
    return work_path(spark, f"llm-{name}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives executors."""
    return materialize(df, f"llm-{name}")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, writes send at most so many rows to a Python worker at once, or as many as were set."""
    before = spark.conf.get(BATCH_ROWS)
    # Zero or less is no limit.
    spark.conf.set(BATCH_ROWS, min(int(before), rows) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def held_out(doc_id: str = "doc_id"):
    """True for rows that no fit may read; a null id is not held out."""
    digest = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(digest % 3 == HELD_OUT, F.lit(False))


def slices(batch: pa.RecordBatch, rows: int = 512):
    """A batch in parts of a few rows, so that what is derived from texts stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def slices_by_bytes(batch: pa.RecordBatch, column: str, most: int):
    """A batch in parts whose texts in ``column`` take at most ``most`` bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def with_arrow_columns(df: DataFrame, compute, fields: list[str]) -> DataFrame:
    """``df`` with columns that ``compute(batch)`` gives as Arrow arrays, one for each field.

    ``fields`` are DDL such as ``"score double"``; columns of ``df`` with these names are replaced.
    """
    new = T.StructType.fromDDL(", ".join(fields))
    rest = df.drop(*new.names)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                arrays = [*part.columns, *compute(part)]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, *new.names])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *new.fields]))

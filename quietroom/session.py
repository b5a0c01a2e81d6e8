"""Session helpers: a local session for tests, and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.settings import BROADCAST_ROWS

_local_root: str | None = None
_folders: list[str] = []


def local_session(
    cores: int | str = 8, app: str = "quietroom", checkpoint_dir: str | None = None
) -> SparkSession:
    builder = SparkSession.builder
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    On a cluster the setting is required. A session without it whose executors run inside the
    driver gets one folder of its own, removed when the process ends.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="quietroom-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, there until ``release_work``."""
    _folders.append(f"{shared_root(spark)}/quietroom/{name}-{uuid.uuid4().hex}")
    return _folders[-1]


def release_work(spark: SparkSession) -> None:
    """Remove every folder that ``work_path`` has named in this process.

    To be called when results that were read from them have been written elsewhere.
    """
    while _folders:
        drop_folder(spark, _folders.pop())


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it lies; nothing happens if it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file on whatever file system ``path`` lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(where, True)
    try:
        out.write(data)
    finally:
        out.close()


def folder_bytes(spark: SparkSession, path: str) -> int:
    """What the files below a folder take, as its file system counts them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(where).getLength()


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files of a write go when it ends, not when the driver collects garbage.

    Only for writes: each is planned anew, so none reads the shuffles of another.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where several jobs read one expensive result: the table outlives lost
    executors and cuts the lineage.
    """
    path = work_path(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialize`` what ``make`` returns, then remove the work folders that it has named."""
    return spark.read.parquet(settled_path(spark, make, name))


def settled_path(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> str:
    """As ``settle``, but the path of the table."""
    begun = len(_folders)
    materialize(make(), name)
    kept = _folders.pop()
    while len(_folders) > begun:
        drop_folder(spark, _folders.pop())
    _folders.append(kept)
    return kept


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` in as many partitions as the setting ``quietroom.textPartitions`` names, by ``key``.

    Without the setting, the scan stays as it is. The setting is for small tables in a single
    file, whose scan is one task whatever its splits.
    """
    partitions = df.sparkSession.conf.get("quietroom.textPartitions", None)
    return df.repartition(int(partitions), key) if partitions else df


def join_bounded(
    big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str, max_rows: int | None
) -> DataFrame:
    """Join ``big`` with a side of at most ``max_rows`` rows.

    The side is broadcast when that bound is known and small enough; otherwise
    the planner shuffles both sides on the keys.
    """
    if max_rows is not None and max_rows <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)

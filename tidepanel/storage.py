"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SHARED_FOLDER = "spark.checkpoint.dir"
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@lru_cache(maxsize=None)
def _local_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="tidepanel-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    That is the setting, or the checkpoint folder a caller gave the context.
    Only a local session without either gets a temporary folder, which goes with
    the process; on a cluster a machine-local folder would lose data, so one of
    them is required.
    """
    context = spark.sparkContext
    folder = spark.conf.get(SHARED_FOLDER, None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError(f"set {SHARED_FOLDER} to a folder that every executor can reach")
        folder = _local_folder(context.applicationId)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


# Paths made since the innermost step began.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/tidepanel/{label}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """A piece of work whose results are written elsewhere: its intermediate tables go when it ends."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get() or []
        _made.reset(token)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, in whatever file system the shared folder lies."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside give their shuffle files back as they end, not when the driver's
    memory is next cleaned. For written tables, which nobody computes again."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def shrink_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """From now on the session passes at most ``rows`` rows, of about ``size`` bytes, at a time to Python.

    The JVM and the Python worker of a task each hold such a batch whole, outside the heap. Spark
    looks at these settings when a query starts, not when its table is described.
    """
    size_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    held = int(spark.conf.get(BATCH_ROWS))
    spark.conf.set(BATCH_ROWS, str(min(rows, held) if held > 0 else rows))
    spark.conf.set(BATCH_BYTES, str(min(size, size_of(spark.conf.get(BATCH_BYTES)))))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Queries that start inside have the batches of ``shrink_batches``."""
    before = {name: spark.conf.get(name) for name in (BATCH_ROWS, BATCH_BYTES)}
    shrink_batches(spark, rows)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialise(df: DataFrame, label: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet, to ``path`` or a new one, and read it back.

    For tables that several passes read: the work before it runs once, survives
    lost executors, and later passes prune columns and know the size.
    """
    path = path or new_path(df.sparkSession, label)
    with freeing_shuffles(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

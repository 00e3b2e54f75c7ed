"""Cutting lineage on storage that every executor shares.

An iterative job must not recompute its past, and must survive the loss of an executor. So
intermediate results go to the checkpoint folder of the cluster, never to executor-local blocks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The scopes open around a call, by thread: what another thread pins meanwhile is its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is configured a temporary one serves a local session; a cluster's executors couldn't see it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found


def pin(df: DataFrame) -> DataFrame:
    """`df`, computed once and read back from reliable storage. For narrow rows: it is not compressed.

    Spark removes such files when spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes.get():
        scope.append(path)
    return path


def pin_table(df: DataFrame, name: str) -> DataFrame:
    """As `pin`, but as a Parquet table: for wide rows, and where the planner should know the size."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread pins as a table inside is deleted at its end, however it ends. Results that are still to be read must be written elsewhere by then."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in mine:
            remove_path(spark, path)

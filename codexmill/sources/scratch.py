"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_PATHS: ContextVar[list[str] | None] = ContextVar("paths of the innermost temporary()", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are written to the shared folder inside are deleted at the end, for work whose result is stored elsewhere."""
    made: list[str] = []
    outer = _PATHS.set(made)
    try:
        yield
    finally:
        _PATHS.reset(outer)
        for path in made:
            forget(spark, path)


@contextmanager
def small_splits(spark: SparkSession, size: int) -> Iterator[None]:
    """What is planned inside reads files in splits of about so many bytes at most, and hands Python batches of as many, for steps that take long or much memory for them."""
    wanted = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": size // 4, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    parse = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    try:
        for name, value in wanted.items():
            spark.conf.set(name, str(min(value, most if (most := parse(before[name])) > 0 else value)))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which is made the context's checkpoint folder too; unset, an own folder in local mode only."""
    path, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not path and context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="codexmill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return (path or context.getCheckpointDir()).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when temporary() around it ends, at the latest with the session's JVM."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(jpath)  # only what exists can be marked for deletion
    store.deleteOnExit(jpath)
    made = _PATHS.get()
    if made is not None:
        made.append(f"{folder}/data")
    return f"{folder}/data"


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that scratch_path named, with its folder, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, through the store of its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(text.encode()))
    stream.close()

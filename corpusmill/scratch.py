"""Durable intermediate tables in the folder that all executors share.

A long plan is cut by writing its rows as Parquet below ``spark.checkpoint.dir``
and reading them back. The files outlive any executor, so a lost one costs a
re-read and no recomputation; they are columnar and compressed, hence smaller
than the row files of ``DataFrame.checkpoint``.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder; a local one is made only for a local master without the setting."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    spark.conf.set(SETTING, made)
    return made


def durable(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the driver drop plans that nothing holds any more, so that shuffle files of finished steps leave the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scope() -> Iterator[None]:
    """Delete what is written inside when it is left; for work whose results are stored inside it."""
    before = len(_written)
    try:
        yield
    finally:
        sweep(before)


def sweep(keep: int = 0) -> int:
    """Delete the tables written so far, but for the first ``keep``; only for when no frame over them is still to run."""
    removed = 0
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            removed += 1
        except Exception:  # the session has ended; the folder's owner cleans it
            continue
    return removed


atexit.register(sweep)

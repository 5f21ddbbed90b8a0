"""Shared helpers: the cluster's shared folder, written tables and Arrow batch plumbing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from keyloom.sources.scratch import scratch

_opened: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share, ``spark.checkpoint.dir``."""
    path = scratch(spark, label)
    for own in _opened:
        own.append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def removing(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``new_path`` gave out in between; results have to be written elsewhere by then."""
    _opened.append([])
    try:
        yield
    finally:
        remove(spark, *_opened.pop())


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there,
    so a lost executor costs no upstream work and several readers compute nothing twice."""
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``written`` and the path, for what is removed before the end."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files a core below which a table may be a row group or two.
SMALL = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, a table as it is read, dealt to all cores if it is so small that its files may not reach them; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df

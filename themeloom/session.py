"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def working_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as ``spark.checkpoint.dir`` names it.

    A missing setting is an error: a folder of one machine would be lost with the executor that
    wrote it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Folder of this application below the shared one."""
    return f"{working_dir(spark)}/themeloom/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that read them must be written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Paths of the tables that are written inside the block, to ``remove`` when they've been read."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders[:] = [r for r in _recorders if r is not made]   # others may be equal


def remove(spark: SparkSession, paths: Sequence[str], but: DataFrame | None = None) -> None:
    """Remove tables, except those that ``but`` reads."""
    read = "\n".join(but.inputFiles()) if but is not None else ""
    for name in paths:
        if name.rsplit("/", 1)[-1] not in read:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan can read any more: Spark removes them once the driver has
    collected garbage, which by itself may take half an hour."""
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan over it.

    Used where a plan reads the same expensive result several times or iterates: the written
    table survives lost executors, cuts the lineage, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    for made in _recorders:
        made.append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores if the input has fewer files than there are cores.

    A small file with one row group would otherwise be worked on by one task.  Inputs of many files
    are left as they are, without an exchange.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(width) if len(df.inputFiles()) < width else df

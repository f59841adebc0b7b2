"""Lineage cuts for iterative and multi-pass jobs.

Cuts write into the session's checkpoint folder (``spark.checkpoint.dir``: a
shared folder on a cluster), so a result survives the loss of the executors
that computed it and later stages never recompute its lineage.  The tables stay
until ``remove_cuts`` is called for the session, when its results are consumed.

* ``cut_lineage`` writes a Parquet table and reads it back (explicit
  schema): one computation, and AQE sizes the write like any other job.
* ``range_partitioned`` keeps the partitioning and the order inside
  partitions, which the generated ids rely on, so it uses ``checkpoint()``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_FOLDERS: dict[str, list[str]] = {}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of its own file system (a failure to ask is raised)."""
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def make_marker(spark: SparkSession, path: str) -> None:
    """An empty file at ``path`` (again, if it is there)."""
    p, fs = _fs(spark, path)
    fs.create(p, True).close()


def remove_path(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what ``path`` holds; none if it does not exist."""
    p, fs = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fareflow-{name}-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_cuts(spark: SparkSession) -> int:
    """Delete the tables this application cut so far.  Call it once the
    results that read them are consumed or written; gives their number."""
    paths = _FOLDERS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p, fs = _fs(spark, path)
        fs.delete(p, True)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = scratch_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_partitioned(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``cols``, checkpointed.  AQE may
    merge adjacent ranges into partitions of its advisory size (order and
    contiguity are kept), so the passes that follow get data-sized tasks."""
    ensure_checkpoint_dir(df.sparkSession)
    return cut_lineage(df).repartitionByRange(*cols).sortWithinPartitions(*cols).checkpoint(eager=True)

"""Pieces the operators of this subpackage share.

* ``ship`` sends the package to the Python workers once per application
  (``addPyFile``), so per-process caches of loaded vocabularies survive
  from task to task.
* ``map_batches`` runs a function over Arrow batches of chosen columns.
* ``scratch_table`` cuts lineage through a Parquet table in the session's
  shared checkpoint folder.
* ``text_runs`` splits a batch into runs of bounded size, so numpy work on a
  batch of very long texts stays bounded.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.lineage import cut_lineage as scratch_table
from ..session import ensure_checkpoint_dir

__all__ = ["Recent", "ship", "map_batches", "scratch_table", "shared_folder", "text_runs", "table", "unused_prefix", "whole_text"]

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch sent to Python, unless the session sets its own:
#: whole texts are large, and both sides hold a batch.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Recent(dict):
    """Values worked out by ``make`` on first use.  Holds the latest ``most``
    to ``2 * most`` strings of up to 64 code points, so memory is bounded;
    results don't depend on what it holds."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{os.path.basename(package)}_workers.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str | StructType) -> DataFrame:
    """``mapInArrow`` after shipping the package to the workers.

    Spark takes the batch size from the session when the job runs, so a
    session that still has the default of 10,000 rows gets ``BATCH_ROWS``.
    """
    ship(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH_CONF) == "10000":
        df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_prefix(columns: list[str], *names: str) -> str:
    """A prefix that makes each of ``names`` the name of no column (whatever its case)."""
    taken, prefix = {c.lower() for c in columns}, "__"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return prefix


def whole_text(col: str = "text"):
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_runs(texts: list[str], max_chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, end) index runs of about ``max_chars`` code points (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > max_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)

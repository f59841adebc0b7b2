"""Applying changed rows to a stored table (the update sink of section 2.9).

Parquet has no ``UPDATE``.  A ``KeyedTable`` is stored in buckets of its key's
hash, one folder each.  Changed rows are applied copy-on-write: the buckets that
hold their keys are read, patched and written again (dynamic partition
overwrite), all others stay as they are.  Reading the rows of some keys reads
their buckets only.

Every write belongs to a batch.  A batch that was applied is marked and not
applied again; one that failed half way is applied again from whatever it left,
with the same result, for changed rows carry values, not differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..plans.lineage import cut_lineage, folders_in, make_marker, path_exists, remove_path

BUCKETS = 64


class KeyedTable:
    """A table at ``path`` with one row per ``key`` (a column or several), in
    ``buckets`` buckets of ``by`` (some of the key's columns; all, unless
    given).  The number of buckets is fixed when the table is created; at scale
    so many that a bucket is a few hundred MB."""

    def __init__(self, spark: SparkSession, path: str, key: str | list[str], buckets: int = BUCKETS, by: list[str] | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.key = [key] if isinstance(key, str) else list(key)
        self.by = by or self.key

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _marker(self, batch_id: int | str) -> str:
        return f"{self.path}/_applied/batch_id={batch_id}"

    def exists(self) -> bool:
        return self.was_applied("create")

    def was_applied(self, batch_id: int | str) -> bool:
        return path_exists(self.spark, self._marker(batch_id))

    def _write(self, rows: DataFrame) -> None:
        (rows.repartitionByRange("bucket", *self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(f"{self.path}/rows"))

    def create(self, rows: DataFrame) -> "KeyedTable":
        """Write the table; ``rows`` may be empty."""
        schema = StructType([*rows.schema.fields, StructField("bucket", IntegerType())])
        self._write(rows.withColumn("bucket", self._bucket()))
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/_schema")
        make_marker(self.spark, self._marker("create"))
        return self

    def _stored(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/_schema").schema
        if not path_exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Buckets that hold ``keys`` (at most ``buckets`` numbers)."""
        return sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """All rows, or those of ``keys`` (which has the columns ``by``): only their buckets are read."""
        rows = self._stored()
        if keys is not None:
            rows = rows.where(F.col("bucket").isin(self.buckets_of(keys))).join(keys.select(*self.by).distinct(), self.by, "left_semi")
            rows = rows.select(*self._stored().columns)
        return rows.drop("bucket")

    def upsert(self, changes: DataFrame, batch_id: int | str, insert: bool = False) -> list[int]:
        """Apply ``changes`` (one row per key; the key and any of the table's
        columns) as batch ``batch_id``: rows of known keys take the values
        given and keep the rest; unknown keys are added if ``insert``, else
        ignored.  Gives the buckets that were written again."""
        if self.was_applied(batch_id):
            return []
        changes = cut_lineage(changes)                    # read for its buckets, then for its rows
        touched = self.buckets_of(changes)
        if touched:
            stored = self._stored()
            given = [c for c in changes.columns if c not in self.key]
            unknown = sorted(set(given) - set(stored.columns))
            if unknown:
                raise ValueError(f"the table has no columns {unknown}")
            values = [F.col(c).cast(stored.schema[c].dataType).alias(c) for c in given]
            new = changes.select(*self.key, F.struct(*values, F.lit(True).alias("_hit")).alias("_new"))
            rows = stored.where(F.col("bucket").isin(touched)).join(new, self.key, "full" if insert else "left")
            hit = F.col("_new").isNotNull()
            rows = rows.select(*[(F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c))
                                 for c in stored.columns if c != "bucket"])
            # kept first: a bucket can't be read and overwritten by one job, and a failure may happen between buckets
            self._write(cut_lineage(rows.withColumn("bucket", self._bucket())))
        make_marker(self.spark, self._marker(batch_id))
        return touched


class HighWater:
    """The largest generated id, written with each batch (S6 across batches),
    so no batch looks for it in the whole table.  Batch N continues after what
    the batches before N used, also when it runs again."""

    KEEP = 16                                             # marks of the last batches

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _marks(self) -> dict[int, int]:
        """Batch -> last id used."""
        names = (n.split("=") for n in folders_in(self.spark, self.path) if n.startswith("batch="))
        return {int(n): int(last) for _, n, last in names}

    def before(self, batch_id: int) -> int | None:
        """Last id used before batch ``batch_id``; None if there is no mark."""
        marks = {n: last for n, last in self._marks().items() if n < batch_id}
        return marks[max(marks)] if marks else None

    def write(self, batch_id: int, last: int) -> None:
        for n, old in self._marks().items():
            if n == batch_id and old != last or n < batch_id - self.KEEP:
                remove_path(self.spark, f"{self.path}/batch={n}={old}")
        make_marker(self.spark, f"{self.path}/batch={batch_id}={last}")

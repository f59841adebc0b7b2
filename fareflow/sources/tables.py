"""S1 ``load_tables``: relational scan of named tables.

Each table is a lazy Parquet scan; Catalyst prunes columns and pushes
filters into the reader, so loading every table costs nothing until a
query touches it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")


def load_tables(spark: SparkSession, sf_dir: str,
                names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Lazy Parquet scans of ``<sf_dir>/<name>.parquet``; a table that is not there fails the read."""
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names or BASE_TABLES}

"""Join-strategy policy.

Joins whose both sides grow with the data say so (``large``): the planner's
estimate is a file size, shared out by column width and blind to an ``explode``,
so a table of millions of keys may pass for 10 MB and be sent whole through the
driver.  Joins that make far more rows, or hold far more memory, than they read
are dealt over as many tasks as their input has rows for (``tasks_for``): AQE
merges partitions by the bytes they read and never splits an evenly large one.

Explicit ``broadcast()`` is used only behind a count: for the per-partition
tables of the range-partitioned scans (one row of numbers per partition, which
grows with the partition count) and for the days of trip searches.  Other tables, however
small they usually are, are left to Catalyst like every other join: a static
broadcast happens only when the planner's size estimate is below
``spark.sql.autoBroadcastJoinThreshold``, and with AQE the decision is
re-made on the real shuffle size (``spark.sql.adaptive.
autoBroadcastJoinThreshold``), falling back to sort-merge beyond it, with
skew-split for hot keys.  That is the size check; nothing here guesses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a table that may be broadcast (numbers only: a few MB).
MOST_ROWS = 100_000


def small_table(df: DataFrame) -> DataFrame:
    """A table of a few numbers a row that is small by its nature (a row per
    partition, per calendar day): broadcast if it has at most ``MOST_ROWS``
    rows (counted), else joined like any other table."""
    return F.broadcast(df) if df.limit(MOST_ROWS + 1).count() <= MOST_ROWS else df


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: the join is a sort-merge one,
    whatever the planner takes for its size, so it never passes through the driver."""
    return df.hint("merge")


def tasks_for(df: DataFrame, rows: int) -> int:
    """The number of tasks that gives each about ``rows`` rows of ``df``
    (counted), at least one a core: it grows with the table, whatever
    ``spark.sql.shuffle.partitions`` is."""
    return tasks_of(df.sparkSession, df.count(), rows)


def tasks_of(spark: SparkSession, count: int, rows: int) -> int:
    """``tasks_for`` a table whose ``count`` is known."""
    return max(spark.sparkContext.defaultParallelism, -(-count // rows))

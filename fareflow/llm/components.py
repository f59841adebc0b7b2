"""Connected components of an edge table by alternating large and small stars.

Each round is a few aggregates and equi-joins and is kept as a table, so no
component ever meets in one task or on the driver, and a lost executor costs
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_table


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge and is not its root; the
    root is the smallest node of the component.  Both columns are long."""
    pairs = scratch_table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        pairs = scratch_table(small.where("u <> v").distinct())

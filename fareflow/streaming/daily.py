"""E5 ``stream_daily_commissions``: G4 as a native streaming aggregate.

Commission rows arrive as a stream, in any order.  Sums per day (a window of
one day) are state in the engine; a micro-batch puts out the days it changed
(update mode), which replace those days' rows in a table keyed by the day.  There
is no watermark, so nothing is dropped for being late: a row of an old day
changes that day.  State and table hold one row a day.  Days that have ended by
the newest event seen count as closed; the open day is left out on reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.upsert import KeyedTable

MONEY = "decimal(18,2)"
COLUMNS = f"commission_date date, total_bookings long, total_revenue {MONEY}, total_commission {MONEY}, newest timestamp_ntz"


def _table(spark: SparkSession, out_dir: str) -> KeyedTable:
    return KeyedTable(spark, out_dir, "commission_date", buckets=4)


def run_daily_commission_stream(stream: DataFrame, out_dir: str, checkpoint_dir: str) -> None:
    """Run to completion (``availableNow``): the sums of every day are kept in the table at ``out_dir``."""
    spark = stream.sparkSession
    table = _table(spark, out_dir)
    if not table.exists():
        table.create(spark.createDataFrame([], COLUMNS))
    at = F.col("created_at").cast("timestamp_ntz")
    days = (stream.where(at.isNotNull()).groupBy(F.window(at, "1 day").alias("day"))
            .agg(F.count(F.lit(1)).alias("total_bookings"), F.sum("booking_amount").cast(MONEY).alias("total_revenue"),
                 F.sum("commission_amount").cast(MONEY).alias("total_commission"), F.max(at).alias("newest"))
            .select(F.to_date("day.start").alias("commission_date"), "total_bookings", "total_revenue", "total_commission", "newest"))

    def replace(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id, insert=True)

    (days.writeStream.outputMode("update").foreachBatch(replace).option("checkpointLocation", checkpoint_dir)
     .trigger(availableNow=True).start().awaitTermination())


def closed_days(spark: SparkSession, out_dir: str) -> DataFrame:
    """Bookings, revenue and commission of each closed day."""
    days = _table(spark, out_dir).read()
    newest = days.agg(F.max("newest")).scalar()
    return days.filter(F.date_add("commission_date", 1).cast("timestamp_ntz") <= newest).drop("newest")

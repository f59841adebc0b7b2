"""B1 over micro-batches: booking requests admitted as they arrive.

What earlier batches decided is carried between batches: the seats that are
held (a ``KeyedTable`` in buckets of the trip, begun with the seats of all
booked passengers) and the last booking id (``HighWater``).  A batch reads the
buckets of the trips it names and the mark before it, not the bookings.

A batch that runs again sees what the batches before it left - held seats carry
the batch that took them - and rewrites its own rows, so it gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.admission import admit_bookings, held_seats
from ..plans.lineage import cut_lineage
from ..sources.requests import parse_booking_requests
from ..sources.sinks import write_batch
from ..sources.upsert import BUCKETS, HighWater, KeyedTable

OUTPUTS = ("outcomes", "bookings", "passengers", "seat_updates")


class AdmissionStream:
    """Admission of request batches into ``out_dir``."""

    def __init__(self, spark: SparkSession, trips: DataFrame, policies: DataFrame, seats: DataFrame, bookings: DataFrame,
                 passengers: DataFrame, out_dir: str, buckets: int = BUCKETS):
        self.trips, self.policies, self.seats, self.out = trips, policies, seats, out_dir.rstrip("/")
        self.held = KeyedTable(spark, f"{self.out}/_held", ["trip_id", "seat_id"], buckets, by=["trip_id"])
        self.mark = HighWater(spark, f"{self.out}/_ids")
        if not self.held.exists():
            self.held.create(held_seats(bookings, passengers).withColumn("batch_id", F.lit(None).cast("bigint")))
        if self.mark.before(0) is None:
            self.mark.write(-1, bookings.agg(F.coalesce(F.max("booking_id"), F.lit(0)).cast("bigint")).first()[0])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Admit one batch of raw requests (request_id, received_at, body)."""
        requests = cut_lineage(parse_booking_requests(batch))
        earlier = F.col("batch_id").isNull() | (F.col("batch_id") < batch_id)
        held = self.held.read(requests.select("trip_id")).where(earlier).select("trip_id", "seat_id")
        start = self.mark.before(batch_id)
        out = admit_bookings(requests, self.trips, self.policies, self.seats, None, None, held, F.lit(start).cast("bigint"))
        for name in OUTPUTS:
            write_batch(out[name], f"{self.out}/{name}", batch_id)
        n = out["bookings"].sparkSession.read.parquet(f"{self.out}/bookings/batch_id={batch_id}").count()
        self.held.upsert(out["held"].withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id, insert=True)
        self.mark.write(batch_id, start + n)

    def run(self, stream: DataFrame, checkpoint_dir: str) -> None:
        """Admit a stream of raw requests, to completion (``availableNow``).  Earlier
        batches go first; within a batch requests are admitted in arrival order."""
        (stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start().awaitTermination())

    def read(self, name: str) -> DataFrame:
        """One of ``OUTPUTS``, of all batches."""
        return self.held.spark.read.parquet(f"{self.out}/{name}").drop("batch_id")

"""Registered streams at size: files of a micro-batch grow in number, bookings of a bucket share a state."""

import datetime as dt
import os

from pyspark.sql import functions as F

from fareflow.plans import catalog
from fareflow.streaming import keyed, scratch_dir
from fareflow.streaming import state as E4


def test_ranges_in_order_have_as_many_files_as_they_need(spark, monkeypatch):
    """No task writes a whole range, and the files of a trigger are one range of the order."""
    monkeypatch.setattr(catalog, "FILE_ROWS", 100)
    rows = spark.range(2000).select("id", (F.col("id") * 7919 % 2000).alias("ts"))
    base = catalog._in_order(spark, rows, "many", "ts", "id")
    each = spark.read.parquet(base + "/in").groupBy(F.col("_metadata.file_path").alias("f")).agg(
        F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n")).collect()
    assert len(each) == 20 and catalog._a_trigger(spark, base) == 5 and sum(r.n for r in each) == 2000
    each.sort(key=lambda r: os.stat(r.f.split(":", 1)[1]).st_mtime_ns)
    batches = [each[i:i + 5] for i in range(0, 20, 5)]
    assert all(max(r.high for r in a) < min(r.low for r in b) for a, b in zip(batches, batches[1:]))
    base = catalog._as_files(spark, rows, "dealt", "id")
    assert catalog._a_trigger(spark, base) == 5 and spark.read.parquet(base + "/in").count() == 2000


def test_bookings_of_a_bucket_share_a_state(spark, monkeypatch):
    """Many bookings in two buckets, commands in three batches: as the batch fold, with null times and fields."""
    monkeypatch.setattr(keyed, "STATE_BUCKETS", 2)
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    bookings = spark.createDataFrame(
        [(b, ["Pending", "Confirmed", "Cancelled", None][b % 4], ["Unpaid", "Paid", None][b % 3], "Cash", None, t(0) if b % 2 else None, None) for b in range(1, 13)]
        + [(None, "Pending", "Unpaid", None, None, None, None)],
        "booking_id long, booking_status string, payment_status string, payment_method string, gateway_transaction_id string, "
        "payment_timestamp timestamp_ntz, notes string")
    schema = "booking_id long, ts timestamp_ntz, seq long, kind string, status string, method string, txn string, note string"
    kinds = ["confirm", "pay", "gateway", "proof", "cancel"]
    rows = [(k, (b, None if k == 0 and b % 5 == 0 else t(k + 1), (1 << 58) + 20 * k + b, kinds[(3 * b + 2 * k) % 5], "Paid" if (b + k) % 2 else "Unpaid",
                 "Kareemi" if b % 2 else "", f"x{b}-{k}", "0" if k % 2 else None)) for b in range(1, 15) for k in range(6)]
    base = scratch_dir(spark, "buckets")
    for part in range(3):
        spark.createDataFrame([r for k, r in rows if k // 2 == part], schema).coalesce(1).write.mode("append").parquet(base + "/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    E4.run_booking_state_stream(stream, bookings, base + "/out", base + "/ck")
    cmds = spark.read.schema(schema).parquet(base + "/in")
    assert cmds.where("ts is null").count() > 0
    for got, want in zip((E4.stream_verdicts(spark, base + "/out"), E4.final_states(spark, base + "/out")), E4.booking_state(cmds, bookings)):
        assert got.dtypes == want.dtypes
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 0

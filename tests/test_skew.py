"""Hot keys: one key holding a large share of the rows.  Results must stay
exact when AQE splits skewed partitions (thresholds forced low here)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fareflow.operators import accounts, admission, inventory
from fareflow.streaming import payments

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_hot_seat_in_available_seats(skewed):
    spark = skewed
    trips = spark.createDataFrame([(t, t) for t in range(50)], "trip_id long, bus_id long")
    buses = spark.createDataFrame([(t,) for t in range(50)], "bus_id long")
    seats = spark.createDataFrame([(t * 10 + s, t, f"S{s}") for t in range(50) for s in range(10)],
                                  "seat_id long, bus_id long, seat_number string")
    # booking 0 (trip 0) has 6000 passengers on seat 0; others hold one seat each
    bookings = spark.createDataFrame([(b, b) for b in range(50)], "booking_id long, trip_id long")
    pax = spark.createDataFrame([(0, 0, "Active")] * 6000 + [(b, b * 10 + 1, "Active") for b in range(1, 50)],
                                "booking_id long, seat_id long, passenger_status string")
    free = inventory.available_seats(trips, buses, seats, bookings, pax)
    assert free.count() == 50 * 10 - 50
    assert free.filter((F.col("trip_id") == 0) & (F.col("seat_id") == 0)).count() == 0


def test_shared_phone_in_identifier_resolution(skewed):
    spark = skewed
    users = spark.createDataFrame([(u, f"u{u}@x.org", "" if u % 3 else f"7{u:08d}") for u in range(6000)],
                                  "user_id long, email string, phone_number string")
    lookups = spark.createDataFrame([(1, ""), (2, "u5@x.org"), (3, "700000003"), (4, "nobody")],
                                    "lookup_id long, identifier string")
    got = {r.lookup_id: (r.user_id, r.reject_reason) for r in accounts.resolve_identifiers(lookups, users).collect()}
    assert got == {1: (None, "identifier_required"), 2: (5, None), 3: (3, None), 4: (None, "user_not_found")}


def test_hot_booking_in_gateway_apply(skewed):
    spark = skewed
    t0 = dt.datetime(2024, 1, 1)
    bookings = spark.createDataFrame([(b, "Unpaid") for b in range(100)], "booking_id long, payment_status string")
    events = spark.createDataFrame(
        [(e, t0 + dt.timedelta(seconds=(e * 7919) % 5000), f"cs_{e}", 7) for e in range(5000)]
        + [(10000 + b, t0, f"cs_b{b}", b) for b in range(100) if b != 7],
        "event_id long, received_at timestamp_ntz, session_id string, booking_id long")
    got = {r.booking_id: r.event_id for r in payments.apply_gateway_payments(bookings, events).collect()}
    assert len(got) == 100 and got[7] == 0          # event 0 is the earliest for the hot booking


def test_hot_resource_in_admission_rounds(skewed):
    spark = skewed
    # 3000 requests want resource 0 (plus one private resource each); request 0 wins it
    rows = [(r, r, 0) for r in range(3000)] + [(r, r, 1000 + r) for r in range(3000)] + [(5000, 5000, 999)]
    items = spark.createDataFrame(rows, "rid long, ord long, res long")
    got = {r.rid: r.accepted for r in admission.first_come_admission(items, "rid", "ord", "res").collect()}
    assert got[0] is True and got[5000] is True
    assert sum(got.values()) == 2

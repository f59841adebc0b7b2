"""Edge cases of the reference's rules, on literal rows."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from fareflow.functions import rules as R
from fareflow.operators import accounts, bookings, inventory, money, notifications
from fareflow.sources.requests import parse_booking_requests, parse_identifier
from fareflow.streaming import payments

T = dt.datetime


def one(spark, col, **row):
    return spark.createDataFrame([row]).select(col.alias("v")).first()["v"]


def test_duration_drops_days(spark):
    df = spark.createDataFrame([(T(2025, 1, 1, 8), T(2025, 1, 2, 9)), (T(2025, 1, 1, 8), T(2025, 1, 1, 8)),
                                (T(2025, 1, 1, 9, 30), T(2025, 1, 1, 8))], "d timestamp_ntz, a timestamp_ntz")
    got = [r[0] for r in df.select(R.trip_duration("d", "a")).collect()]
    assert got == ["1 hours, 0 minutes", "0 hours, 0 minutes", "1 hours, 30 minutes"]
    assert df.select(R.duration_minutes("d", "a")).first()[0] == 25 * 60


def test_minor_units_truncates_through_float(spark):
    df = spark.createDataFrame([(Decimal("19.99"),)], "p decimal(12,2)")
    r = df.select(R.minor_units("p"), R.minor_units_exact("p")).first()
    assert (r[0], r[1]) == (1998, 1999)


def test_lenient_casts(spark):
    df = spark.createDataFrame([("12abc",), ("abc",), (" 7.9",), (None,), ("-3",)], "s string")
    assert [r[0] for r in df.select(R.lenient_int("s")).collect()] == [12, 0, 7, 0, -3]
    big = spark.createDataFrame([("1e3",), ("1e3x",), ("12345678901234567890",), ("-99999999999999999999",), ("123456789012345678",)], "s string")
    assert [r[0] for r in big.select(R.lenient_int("s")).collect()] == [1000, 1000, 2**63 - 1, -2**63, 123456789012345678]
    assert [r[0] for r in spark.createDataFrame([("12345678901.5",)], "s string").select(R.lenient_float("s")).collect()] == [None]
    got = [r[0] for r in df.select(R.lenient_float("s")).collect()]
    assert got == [Decimal("12.00"), Decimal("0.00"), Decimal("7.90"), Decimal("0.00"), Decimal("-3.00")]


def test_positive_int_and_required(spark):
    df = spark.createDataFrame([("1.5",), ("0.5",), ("1d",), ("0",), ("",), (None,), (" 3 ",)], "s string")
    assert [r[0] for r in df.select(R.positive_int("s")).collect()] == [True, False, False, False, False, False, True]
    assert [r[0] for r in df.select(R.required("s")).collect()] == [True, True, True, True, False, False, True]


def test_falsy_default_treats_zero_as_empty(spark):
    df = spark.createDataFrame([("0",), ("",), (None,), ("x",)], "s string")
    assert [r[0] for r in df.select(R.falsy_default("s", "d")).collect()] == ["d", "d", "d", "x"]


def test_phone_rules(spark):
    df = spark.createDataFrame([("0712345678",), ("+967 712345678",), ("712345678",), ("812345678",), ("",)], "p string")
    assert [r[0] for r in df.select(R.valid_phone("p")).collect()] == [True, True, True, False, False]
    assert [r[0] for r in df.select(R.normalize_phone("p")).collect()] == [
        "0712345678", "967712345678", "967712345678", "812345678", ""]


def test_whole_numbers_are_exact(spark):
    cases = [("1234567890123456789", 1234567890123456789), ("1000000000000000001x", 1000000000000000001), ("9223372036854775808", 2**63 - 1),
             ("-9223372036854775808", -2**63), ("-9223372036854775809", -2**63), ("0" * 50 + "7", 7), ("1" * 60, 2**63 - 1), ("-" + "1" * 60, -2**63),
             ("+5", 5), ("5.", 5), ("1.e2", 100)]
    df = spark.createDataFrame([c[:1] for c in cases], "s string")
    assert [r[0] for r in df.select(R.lenient_int("s")).collect()] == [w for _, w in cases]


def test_email_rule(spark):
    df = spark.createDataFrame([("a.b@example.org",), ("a@localhost",), ("a..b@x.org",), ("",), ("x@y-.org",), ("a@b.org\n",)], "e string")
    assert [r[0] for r in df.select(R.valid_email("e")).collect()] == [True, False, False, False, False, False]


def test_refund_amount_rounding_and_clamp(spark):
    df = spark.createDataFrame([(Decimal("100.05"), Decimal("50.00"), Decimal("0.00")),
                                (Decimal("10.00"), Decimal("10.00"), Decimal("500.00"))],
                               "p decimal(12,2), pct decimal(5,2), fee decimal(12,2)")
    assert [r[0] for r in df.select(R.refund_amount("p", "pct", "fee")).collect()] == [Decimal("50.03"), Decimal("0.00")]


def test_month_label_unpadded(spark):
    c = spark.createDataFrame([(1, T(2025, 3, 5), Decimal("10"), Decimal("1"), Decimal("9"), "Pending")],
                              "partner_id long, created_at timestamp_ntz, booking_amount decimal(12,2), "
                              "commission_amount decimal(12,2), partner_revenue decimal(12,2), status string")
    r = money.partner_month_stats(c).first()
    assert r["period"] == "2025-3" and r["pending_count"] == 1 and r["paid_count"] == 0


def test_stats_for_unmatched_month(spark):
    c = spark.createDataFrame([(1, T(2025, 3, 5), Decimal("10"), Decimal("1"), Decimal("9"), "Paid")],
                              "partner_id long, created_at timestamp_ntz, booking_amount decimal(12,2), "
                              "commission_amount decimal(12,2), partner_revenue decimal(12,2), status string")
    req = spark.createDataFrame([(1, 2025, 4)], "partner_id long, year int, month int")
    r = money.partner_stats_for(req, c).first()
    assert r["total_bookings"] == 0 and r["total_revenue"] is None and r["period"] == "2025-4"


def test_listing_to_bound_is_inclusive_midnight(spark):
    df = spark.createDataFrame([(1, "Paid", T(2025, 12, 31, 0, 0)), (2, "Paid", T(2025, 12, 31, 9, 0)),
                                (3, "Pending", T(2025, 12, 1))], "id long, status string, created_at timestamp_ntz")
    got = [r["id"] for r in money.filter_listing(df, status="Paid", ts_to="2025-12-31").collect()]
    assert got == [1]
    got = [r["id"] for r in money.filter_listing(df, status="", ts_from="2025-12-01").collect()]
    assert got == [2, 1, 3]


def _seat_tables(spark, held_seat):
    trips = spark.createDataFrame([(1, 10), (2, 20)], "trip_id long, bus_id long")
    buses = spark.createDataFrame([(10,), (20,)], "bus_id long")
    seats = spark.createDataFrame([(100, 10, "S00"), (101, 10, "S01"), (200, 20, "S00"), (201, 20, "S01")],
                                  "seat_id long, bus_id long, seat_number string")
    bookings_ = spark.createDataFrame([(7, 1), (8, 2)], "booking_id long, trip_id long")
    pax = spark.createDataFrame([(7, 100, "Cancelled"), (8, held_seat, "Active")],
                                "booking_id long, seat_id long, passenger_status string")
    return trips, buses, seats, bookings_, pax


def test_not_in_null_empties_only_that_trip(spark):
    tables = _seat_tables(spark, None)
    got = sorted((r.trip_id, r.seat_id) for r in inventory.available_seats(*tables).collect())
    assert got == [(1, 101)]          # cancelled passenger still holds 100; trip 2 emptied by the NULL
    got = sorted((r.trip_id, r.seat_id) for r in inventory.available_seats(*tables, null_aware=False).collect())
    assert got == [(1, 101), (2, 200), (2, 201)]
    got = sorted((r.trip_id, r.seat_id) for r in
                 inventory.available_seats(*tables, null_aware=False, ignore_cancelled=True).collect())
    assert got == [(1, 100), (1, 101), (2, 200), (2, 201)]


def _rules(spark):
    return spark.createDataFrame(
        [(1, 5, 72.0, None, Decimal("100"), Decimal("0"), True),
         (2, 5, 24.0, 72.0, Decimal("75"), Decimal("500"), True),
         (3, 5, 24.0, 48.0, Decimal("60"), Decimal("0"), True),     # overlaps rule 2: same min, higher id loses
         (4, 5, 2.0, 24.0, Decimal("10"), Decimal("0"), False)],    # inactive
        "cancel_policy_rule_id long, cancel_policy_id long, min_hours_before_departure double, "
        "max_hours_before_departure double, refund_percentage decimal(5,2), cancellation_fee decimal(12,2), "
        "is_active boolean")


def test_rule_boundaries_and_overlap(spark):
    trips = spark.createDataFrame([(1, T(2025, 1, 10, 0, 0))], "trip_id long, departure_time timestamp_ntz")
    b = spark.createDataFrame([(1, 1, 5)], "booking_id long, trip_id long, cancel_policy_id long")
    hours = {72: T(2025, 1, 7), 24: T(2025, 1, 9), 48: T(2025, 1, 8), 10: T(2025, 1, 9, 14), -1: T(2025, 1, 10, 1)}
    req = spark.createDataFrame([(1, v) for v in hours.values()], "booking_id long, requested_at timestamp_ntz")
    got = {round(r.hours_before_departure): r.cancel_policy_rule_id
           for r in bookings.cancel_rule_matches(req, b, trips, _rules(spark)).collect()}
    assert got == {72: 1, 48: 2, 24: 2, 10: None, -1: None}


def _cancel_inputs(spark, status):
    trips = spark.createDataFrame([(1, T(2025, 1, 10))], "trip_id long, departure_time timestamp_ntz")
    b = spark.createDataFrame([(1, 1, 5, Decimal("1000.00"), "Pending", status)],
                              "booking_id long, trip_id long, cancel_policy_id long, total_price decimal(12,2), "
                              "booking_status string, payment_status string")
    req = spark.createDataFrame([(1, 1, T(2025, 1, 8), "r"), (2, 1, T(2025, 1, 8, 1), "again")],
                                "command_id long, booking_id long, requested_at timestamp_ntz, reason string")
    return req, b, trips


def test_quote_unpaid_and_null_status(spark):
    for status in ("Unpaid", None):
        req, b, trips = _cancel_inputs(spark, status)
        r = bookings.cancellation_quote(req, b, trips, _rules(spark)).orderBy("requested_at").first()
        assert (r.refund_amount, r.cancellation_fee, r.cancel_policy_rule_id) == (Decimal("0.00"), Decimal("0.00"), 0)


def test_confirm_fee_defaults_to_price_and_second_request_rejected(spark):
    req, b, trips = _cancel_inputs(spark, "Unpaid")
    pax = spark.createDataFrame([(1, 9)], "booking_id long, seat_id long")
    out = bookings.apply_cancellations(req, b, trips, _rules(spark), pax)
    led = out["ledger"].first()
    assert led.cancellation_fee == Decimal("1000.00") and led.refund_amount == Decimal("0.00")
    reasons = [r.reject_reason for r in out["outcomes"].orderBy("requested_at").collect()]
    assert reasons == [None, "invalid_or_already_cancelled"]
    req, b, trips = _cancel_inputs(spark, "Paid")
    out = bookings.apply_cancellations(req, b, trips, _rules(spark), pax)
    r = out["ledger"].first()     # 48 h before: rule 2 (75 %, fee 500) -> 750 - 500
    assert (r.cancel_policy_rule_id, r.refund_amount) == (2, Decimal("250.00"))
    assert out["bookings"].first().payment_status == "Refunded"


def _webhook_rows(spark, secret, rows):
    df = spark.createDataFrame(rows, "event_id long, received_at timestamp_ntz, payload string, t string, extra string")
    sig = payments.hmac_sha256_hex(F.concat("t", F.lit("."), "payload"), secret)
    return df.select("event_id", "received_at", "payload",
                     F.concat(F.lit("t="), "t", F.lit(",v1="), F.coalesce("extra", sig)).alias("sig_header"))


def test_webhook_freshness_and_signatures(spark):
    import hashlib
    import hmac
    secret = "whsec_x"
    now = T(2024, 1, 1, 0, 0, 0)
    t0 = int((now - T(1970, 1, 1)).total_seconds())
    body = '{"type":"checkout.session.completed"}'
    rows = [(1, now, body, str(t0 - 300), None),      # exactly 300 s: accepted
            (2, now, body, str(t0 - 301), None),      # 301 s: late
            (3, now, body, str(t0), "00")]            # wrong signature
    v = {r.event_id: r.reject_reason for r in payments.verify_payment_events(
        _webhook_rows(spark, secret, rows), secret).collect()}
    assert v == {1: None, 2: "rejected_late", 3: "bad_signature"}
    good = hmac.new(secret.encode(), f"{t0}.{body}".encode(), hashlib.sha256).hexdigest()
    hdrs = [(4, f"t={t0},v1=00,v1={good}"), (5, f"t=1,t={t0},v1={good}"), (6, f"t={t0}"), (7, f"v1={good}"),
            (8, f"t={t0}, v1 = {good} ,junk")]
    df = spark.createDataFrame([(i, now, body, h) for i, h in hdrs],
                               "event_id long, received_at timestamp_ntz, payload string, sig_header string")
    v = {r.event_id: r.reject_reason for r in payments.verify_payment_events(df, secret).collect()}
    assert v == {4: None, 5: None, 6: "malformed_signature", 7: "malformed_signature", 8: None}


def test_gateway_first_event_wins_and_null_status_untouched(spark):
    b = spark.createDataFrame([(1, "Unpaid"), (2, None), (3, "Paid")], "booking_id long, payment_status string")
    p = spark.createDataFrame([(10, T(2024, 1, 2), "cs_b", 1), (11, T(2024, 1, 1), "cs_a", 1),
                               (12, T(2024, 1, 1), "cs_c", 2), (13, T(2024, 1, 1), "cs_d", 3)],
                              "event_id long, received_at timestamp_ntz, session_id string, booking_id long")
    got = [(r.booking_id, r.gateway_transaction_id) for r in payments.apply_gateway_payments(b, p).collect()]
    assert got == [(1, "cs_a")]


def test_duplicate_seat_code_and_two_requests_for_one_seat(spark):
    from fareflow.operators import admission
    raw = spark.createDataFrame([
        (1, T(2024, 1, 1, 9), '{"user_id":5,"trip_id":1,"total_price":"10","passengers":[{"full_name":"a","seat_code":"S00"},{"full_name":"b","seat_code":" S00"}]}'),
        (2, T(2024, 1, 1, 10), '{"user_id":5,"trip_id":1,"passengers":[{"full_name":"a","seat_code":"S01"}]}'),
        (3, T(2024, 1, 1, 11), '{"user_id":6,"trip_id":"1","passengers":[{"full_name":"c","seat_code":"S01"},{"full_name":"d","seat_code":"S02"}]}'),
        (4, T(2024, 1, 1, 12), '{"user_id":6,"trip_id":1,"passengers":[{"full_name":"e","seat_code":"S02"}]}'),
        (5, T(2024, 1, 1, 13), '{"user_id":6,"trip_id":1,"passengers":"none"}'),
        (6, T(2024, 1, 1, 14), '{"user_id":6,"trip_id":1,"passengers":[{"full_name":"f","seat_code":"0"}]}'),
    ], "request_id long, received_at timestamp_ntz, body string")
    req = parse_booking_requests(raw)
    trips = spark.createDataFrame([(1, 1, 7)], "trip_id long, bus_id long, partner_id long")
    pol = spark.createDataFrame([(70, 7, True, True)], "cancel_policy_id long, partner_id long, is_default boolean, is_active boolean")
    seats = spark.createDataFrame([(100 + i, 1, f"S0{i}") for i in range(3)], "seat_id long, bus_id long, seat_number string")
    bk = spark.createDataFrame([(50, 1)], "booking_id long, trip_id long")
    pax = spark.createDataFrame([(50, None)], "booking_id long, seat_id long")
    out = admission.admit_bookings(req, trips, pol, seats, bk, pax)
    got = {r.request_id: (r.reject_reason, r.booking_id) for r in out["outcomes"].collect()}
    assert got == {1: ("unknown_seats", None), 2: (None, 51), 3: ("already_booked", None), 4: (None, 52),
                   5: ("missing_fields", None), 6: ("no_seat_codes", None)}
    assert out["seat_updates"].count() == 2


def test_parse_identifier_chain(spark):
    df = spark.createDataFrame([(1, '{"email":"a@b.c","phone":"7"}'), (2, '{"phone_number":"7"}'), (3, "{}")],
                               "id long, body string")
    assert [r.identifier for r in parse_identifier(df).orderBy("id").collect()] == ["a@b.c", "7", ""]


def test_merge_payload_caller_wins(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "x"})], "s map<string,string>, c map<string,string>")
    assert df.select(notifications.merge_payload(F.col("s"), F.col("c"))).first()[0] == {"a": "1", "b": "x"}


def test_device_token_fallback_and_empty_rejected(spark):
    old = spark.createDataFrame([(1, "t0", "android", T(2024, 1, 1))], "user_id long, fcm_token string, device_type string, created_at timestamp_ntz")
    new = spark.createDataFrame([(1, "t1", "blackberry", T(2024, 1, 2)), (1, "  ", "ios", T(2024, 1, 3))],
                                "user_id long, fcm_token string, device_type string, created_at timestamp_ntz")
    got = [(r.fcm_token, r.device_type) for r in accounts.upsert_device_tokens(old, new).collect()]
    assert got == [("t1", "android")]


def test_confirm_notes_zero_falls_back(spark):
    b = spark.createDataFrame([(1, 1, "Pending", None)], "booking_id long, user_id long, booking_status string, payment_status string")
    u = spark.createDataFrame([(1,)], "user_id long")
    c = spark.createDataFrame([(1, 1, 9, "", "0", T(2024, 1, 1)), (2, 1, 9, "Paid", "", T(2024, 1, 2))],
                              "command_id long, booking_id long, employee_id long, payment_status string, notes string, ts timestamp_ntz")
    outcomes, audit = bookings.confirm_bookings(b, u, c)
    assert [r.notes for r in audit.collect()] == ["Payment Status: "]
    assert sorted((r.reject_reason or "") for r in outcomes.collect()) == ["", "not_pending"]


def test_zero_token_is_empty(spark):
    from fareflow.operators import listings
    tokens = spark.createDataFrame([(1, "tA", "ios", T(2024, 1, 1)), (1, "0", "web", T(2024, 1, 2)),
                                    (2, "tB", "ios", T(2024, 1, 1))],
                                   "user_id long, fcm_token string, device_type string, created_at timestamp_ntz")
    assert [r.user_id for r in listings.latest_device_token(tokens).collect()] == [2]
    kept = accounts.upsert_device_tokens(tokens.limit(0), tokens)
    assert sorted(r.fcm_token for r in kept.collect()) == ["tA", "tB"]


def test_child_price_not_clamped_and_stops_in_order(spark):
    req = spark.createDataFrame([(1, "A", "C", dt.date(2025, 1, 1), "VIP"), (2, "C", "A", dt.date(2025, 1, 1), "VIP"),
                                 (3, "A", "C", dt.date(2025, 1, 1), "0")],
                                "request_id long, from_stop string, to_city string, travel_date date, bus_class string")
    trips = spark.createDataFrame([(7, 1, 70, 5, T(2025, 1, 1, 8), T(2025, 1, 2, 9, 5), Decimal("30.00"))],
                                  "trip_id long, route_id int, bus_id long, partner_id long, departure_time timestamp_ntz, "
                                  "arrival_time timestamp_ntz, base_price decimal(12,2)")
    routes = spark.createDataFrame([(1, "A", "D")], "route_id int, origin_city string, destination_city string")
    stops = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (1, 2, "C")], "route_id int, stop_order int, stop_name string")
    buses = spark.createDataFrame([(70, 3, "M")], "bus_id long, bus_class_id int, model string")
    classes = spark.createDataFrame([(3, "VIP")], "bus_class_id int, class_name string")
    partners = spark.createDataFrame([(5, "Co")], "partner_id long, company_name string")
    seats = spark.createDataFrame([(700, 70, "S00", True), (701, 70, "S01", False)],
                                  "seat_id long, bus_id long, seat_number string, is_available boolean")
    rows = inventory.trip_search(req, trips, routes, stops, buses, classes, partners, seats).collect()
    assert [r.request_id for r in rows] == [1]          # C before A is the wrong direction; '0' class is empty
    r = rows[0]
    assert (r.price_child, r.available_seats, r.duration) == (Decimal("-20.00"), 1, "1 hours, 5 minutes")
    unmatched = {u.request_id: u.reject_reason for u in
                 inventory.unmatched_searches(req, trips, routes, stops, buses, classes, partners, seats).collect()}
    assert unmatched == {2: "no_trips", 3: "missing_fields"}


def test_stream_same_session_twice_applied_once(spark):
    import time as _time

    from fareflow.streaming import scratch_dir
    secret = "whsec_s"
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    epoch = int((t0 - T(1970, 1, 1)).total_seconds())
    body = '{"type":"checkout.session.completed","data":{"object":{"id":"cs_1","metadata":{"booking_id":"5"}}}}'
    sig = payments.hmac_sha256_hex(F.concat(F.lit(str(epoch)), F.lit("."), F.col("payload")), secret)
    base = scratch_dir(spark, "dup-session")
    for eid, delay in ((1, 0), (2, 30)):                      # the gateway retries the same session
        (spark.createDataFrame([(eid, t0 + dt.timedelta(seconds=delay), body)],
                               "event_id long, received_at timestamp, payload string")
         .withColumn("sig_header", F.concat(F.lit(f"t={epoch},v1="), sig))
         .write.mode("append").parquet(base + "/in"))
        _time.sleep(1.1)
    bookings = spark.createDataFrame([(5, "Unpaid")], "booking_id long, payment_status string")
    stream = payments.read_payment_events(spark, base + "/in", max_files_per_trigger=1)
    payments.run_gateway_stream(spark, stream, bookings, secret, base + "/out", base + "/ck")
    applied = payments.applied_payments(spark, base + "/out").collect()
    assert [(r.booking_id, r.event_id, r.gateway_transaction_id) for r in applied] == [(5, 1, "cs_1")]


def test_sinks_append_batch_and_json(spark):
    from fareflow.sources import sinks
    from fareflow.streaming import scratch_dir
    base = scratch_dir(spark, "sinks")
    df = spark.createDataFrame([(1, "مرحبا"), (2, "b")], "id long, text string")
    sinks.append_rows(df, base + "/t")
    sinks.append_rows(df, base + "/t")
    assert spark.read.parquet(base + "/t").count() == 4
    sinks.write_batch(df, base + "/b", 7)
    sinks.write_batch(df, base + "/b", 7)                    # a replayed batch rewrites, not appends
    assert spark.read.parquet(base + "/b").count() == 2
    sinks.write_json(df, base + "/j")
    assert spark.read.json(base + "/j/_envelope").first()["count"] == 2
    texts = "".join(open(p, encoding="utf-8").read() for p in
                    __import__("glob").glob(base.replace("file:", "") + "/j/rows/*.json"))
    assert "مرحبا" in texts                                  # unescaped Unicode


# ---------------------------------------------------------------------------
# Retries, late rows and carried state
# ---------------------------------------------------------------------------
WEBHOOK_SECRET = "whsec_s"


def _webhook_files(spark, name, files):
    """One file per list of (event_id, booking_id, session_id, received_at[, signed_at]); files are read in order."""
    import time as _time

    from fareflow.streaming import scratch_dir
    base = scratch_dir(spark, name)
    for events in files:
        rows = []
        for eid, booking, session, at, *signed in events:
            t = int(((signed or [at])[0] - T(1970, 1, 1)).total_seconds())
            body = ('{"type":"checkout.session.completed","data":{"object":{"id":"%s","metadata":{"booking_id":"%s"}}}}' % (session, booking))
            rows.append((eid, at, body, str(t)))
        sig = payments.hmac_sha256_hex(F.concat("t", F.lit("."), "payload"), WEBHOOK_SECRET)
        (spark.createDataFrame(rows, "event_id long, received_at timestamp, payload string, t string")
         .withColumn("sig_header", F.concat(F.lit("t="), "t", F.lit(",v1="), sig)).drop("t")
         .coalesce(1).write.mode("append").parquet(base + "/in"))
        _time.sleep(1.1)
    return base


def _run_gateway(spark, base, n):
    bookings_ = spark.createDataFrame([(b, "Unpaid") for b in range(1, n + 1)], "booking_id long, payment_status string")
    stream = payments.read_payment_events(spark, base + "/in", max_files_per_trigger=1)
    payments.run_gateway_stream(spark, stream, bookings_, WEBHOOK_SECRET, base + "/out", base + "/ck")
    return {r.booking_id: r.event_id for r in payments.applied_payments(spark, base + "/out").collect()}


def test_stream_loses_no_payment(spark):
    """Events without a session, out-of-order files, an event hours older than the newest: all are applied."""
    h = lambda n: T(2024, 1, 1, n)
    base = _webhook_files(spark, "no-loss", [[(1, 1, "", h(5)), (2, 2, "", h(5)), (3, 3, "", h(5))], [(4, 4, "cs_4", h(0))], [(5, 5, "cs_5", h(3)), (6, 4, "cs_4", h(4))]])
    assert _run_gateway(spark, base, 5) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def test_stream_keeps_the_first_event_of_a_batch(spark):
    h = lambda n: T(2024, 1, 1, n)
    base = _webhook_files(spark, "first", [[(9, 1, "cs", h(2)), (7, 1, "cs", h(1)), (8, 1, "cs", h(1))]])
    assert _run_gateway(spark, base, 1) == {1: 7}


def test_stream_rejects_have_rows(spark):
    h = lambda n: T(2024, 1, 1, n)
    base = _webhook_files(spark, "late", [[(1, 1, "cs", h(5), h(4))], [(2, 2, "cs", h(5))]])
    assert _run_gateway(spark, base, 2) == {2: 2}
    rejected = payments.rejected_events(spark, base + "/out").collect()
    assert [(r.event_id, r.reject_reason) for r in rejected] == [(1, "rejected_late")]


def test_late_days_are_counted(spark):
    import time as _time

    from fareflow.streaming import daily, scratch_dir
    base = scratch_dir(spark, "late-days")
    schema = "commission_id long, booking_amount decimal(12,2), commission_amount decimal(12,2), created_at timestamp_ntz"
    for i, day in enumerate((5, 6, 2, 9, 10)):
        spark.createDataFrame([(i, Decimal("10"), Decimal("1"), T(2024, 1, day, 12))], schema).coalesce(1).write.mode("append").parquet(base + "/in")
        _time.sleep(1.1)
    stream = spark.readStream.schema(spark.read.parquet(base + "/in").schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    daily.run_daily_commission_stream(stream, base + "/out", base + "/ck")
    assert sorted(r.commission_date.day for r in daily.closed_days(spark, base + "/out").collect()) == [2, 5, 6, 9]


def test_duplicate_commands_have_one_winner(spark):
    """Commands that are equal but for their arrival id: the first is applied, the retry rejected."""
    b = spark.createDataFrame([(1, 1, "Pending", "Paid", Decimal("100.00"), 5, 1)],
                              "booking_id long, user_id long, booking_status string, payment_status string, total_price decimal(12,2), "
                              "cancel_policy_id long, trip_id long")
    u = spark.createDataFrame([(1,)], "user_id long")
    c = spark.createDataFrame([(i, 1, 9, "", "", T(2024, 1, 1)) for i in (2, 1)],
                              "command_id long, booking_id long, employee_id long, payment_status string, notes string, ts timestamp_ntz")
    outcomes, audit = bookings.confirm_bookings(b, u, c)
    assert audit.count() == 1 and sorted(str(r.reject_reason) for r in outcomes.collect()) == ["None", "not_pending"]
    trips = spark.createDataFrame([(1, T(2025, 1, 10))], "trip_id long, departure_time timestamp_ntz")
    req = spark.createDataFrame([(i, 1, T(2025, 1, 7), "r") for i in (1, 2)], "command_id long, booking_id long, requested_at timestamp_ntz, reason string")
    out = bookings.apply_cancellations(req, b, trips, _rules(spark), spark.createDataFrame([(1, 9)], "booking_id long, seat_id long"))
    assert out["ledger"].count() == 1
    refunds = spark.createDataFrame([(1, "Pending"), (2, "Processing")], "refund_id long, refund_status string")
    cmds = spark.createDataFrame([(i, r, "Cash", 7) for r in (1, 2) for i in (2 * r, 2 * r + 1)], "command_id long, refund_id long, refund_method string, employee_id long")
    assert money.process_refunds(refunds, cmds, "2024-01-01").filter("refund_status = 'Processing'").count() == 1
    assert money.complete_refunds(refunds, cmds, "2024-01-01").filter("refund_status = 'Completed'").count() == 1


def test_commands_without_ids_are_refused(spark):
    import pytest
    c = spark.createDataFrame([(1, 9, "", "", T(2024, 1, 1))], "booking_id long, employee_id long, payment_status string, notes string, ts timestamp_ntz")
    with pytest.raises(ValueError):
        bookings.confirm_bookings(c, c, c)


def test_bus_with_two_seats_of_one_number(spark):
    from fareflow.operators import admission
    raw = spark.createDataFrame([(1, T(2024, 1, 1), '{"user_id":5,"trip_id":1,"passengers":[{"full_name":"a","seat_code":"S1"},{"full_name":"b","seat_code":"S2"}]}'),
                                 (2, T(2024, 1, 1), '{"user_id":5,"trip_id":1,"passengers":[{"full_name":"a","seat_code":"S1"}]}'),
                                 (3, T(2024, 1, 1), '{"user_id":5,"trip_id":1,"passengers":[{"full_name":"a","seat_code":"S2"}]}')],
                                "request_id long, received_at timestamp_ntz, body string")
    trips = spark.createDataFrame([(1, 1, 7)], "trip_id long, bus_id long, partner_id long")
    seats = spark.createDataFrame([(1, 1, "S1"), (2, 1, "S1"), (3, 1, "S2")], "seat_id long, bus_id long, seat_number string")
    per = admission.resolve_seat_codes(parse_booking_requests(raw), trips, seats)[1]
    assert {r.request_id: (r.n_codes, r.n_found, r.reject_reason) for r in per.collect()} == {
        1: (2, 3, "unknown_seats"), 2: (1, 2, "unknown_seats"), 3: (1, 1, None)}


def test_json_booleans_and_prices(spark):
    raw = spark.createDataFrame([(1, T(2024, 1, 1), '{"user_id": true, "trip_id": "true", "total_price": "12345678901.5"}')],
                                "request_id long, received_at timestamp_ntz, body string")
    r = parse_booking_requests(raw).first()
    assert (r.user_id, r.trip_id, r.total_price) == (1, 0, None)


def test_admission_chain_is_not_capped(spark):
    from fareflow.operators import admission
    items = spark.createDataFrame([(i, i, r) for i in range(24) for r in (i, i + 1)], "rid long, ord long, res long")
    got = {r.rid: r.accepted for r in admission.first_come_admission(items, "rid", "ord", "res").collect()}
    assert got == {i: i % 2 == 0 for i in range(24)}


def test_long_chain_is_admitted_in_few_jobs(spark, monkeypatch):
    """A chain of 1,000 in arrival order: ten tables, not five hundred rounds."""
    from pyspark.sql import DataFrameWriter

    from fareflow.operators import admission
    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), write(self, path, *a, **k))[1])
    items = spark.createDataFrame([(i, i, r) for i in range(1000) for r in (i, i + 1)], "rid long, ord long, res long")
    got = {r.rid: r.accepted for r in admission.first_come_admission(items, "rid", "ord", "res").collect()}
    assert got == {i: i % 2 == 0 for i in range(1000)} and len(written) <= 10


def test_components(spark):
    from fareflow.operators import admission
    from fareflow.streaming import scratch_dir
    rnd = __import__("random").Random(8)
    claims = [(i, rnd.randint(0, 220)) for i in range(200) for _ in range(rnd.choice([1, 1, 2, 3]))]
    label = {i: i for i in range(200)}
    for _ in range(200):
        low = {}
        for i, r in claims:
            low[r] = min(low.get(r, i), label[i])
        for i, r in claims:
            label[i] = min(label[i], low[r])
    df = spark.createDataFrame(claims, "rid long, res long")
    got = {r.rid: r.label for r in admission.components(df, "rid", "res", scratch_dir(spark, "components")).collect()}
    assert got == label


def _bucket_times(path):
    import glob
    import os
    found = {}
    for f in glob.glob(path.replace("file:", "") + "/rows/bucket=*/*.parquet"):
        found.setdefault(int(f.split("bucket=")[1].split("/")[0]), set()).add((f, os.stat(f).st_mtime_ns))
    return found


def test_upsert_writes_touched_buckets_only(spark):
    import pytest

    from fareflow.plans.checks import physical_plan
    from fareflow.sources.upsert import KeyedTable
    from fareflow.streaming import scratch_dir
    table = KeyedTable(spark, scratch_dir(spark, "table"), "k", buckets=8).create(spark.range(100).selectExpr("id k", "id * 2 v", "'a' s"))
    before = _bucket_times(table.path)
    changes = spark.createDataFrame([(3, 7), (4, None), (1000, 9)], "k long, v long")
    touched = table.upsert(changes, 1)
    after = _bucket_times(table.path)
    assert {b for b in before if before[b] != after[b]} <= set(touched) and 0 < len(touched) <= 3 and len(before) == 8
    rows = {r.k: (r.v, r.s) for r in table.read().collect()}
    assert len(rows) == 100 and rows[3] == (7, "a") and rows[4] == (None, "a") and rows[5] == (10, "a")      # a null is a value, 1000 is not known
    assert table.upsert(changes.withColumn("v", F.lit(0)), 1) == []                                      # batch 1 was applied
    table.upsert(spark.createDataFrame([(1000, 5, "z"), (3, 8, "y")], "k long, v long, s string"), 2, insert=True)
    rows = {r.k: (r.v, r.s) for r in table.read().collect()}
    assert len(rows) == 101 and rows[1000] == (5, "z") and rows[3] == (8, "y")
    one = spark.createDataFrame([(3,)], "k long")
    assert [tuple(r) for r in table.read(one).collect()] == [(3, 8, "y")]
    assert __import__("re").search(r"PartitionFilters: \[[^\]]*bucket", physical_plan(table.read(one)))
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(3, 1)], "k long, other long"), 3)
    assert table.upsert(changes.limit(0), 4) == [] and table.was_applied(4)
    empty = KeyedTable(spark, scratch_dir(spark, "none"), "k").create(spark.range(0).selectExpr("id k", "1 v"))
    assert empty.read().count() == 0 and empty.read(one).count() == 0
    empty.upsert(spark.createDataFrame([(3, 1)], "k long, v int"), 0, insert=True)
    assert [tuple(r) for r in empty.read().collect()] == [(3, 1)]


def test_upsert_that_failed_half_way_is_applied_again(spark, monkeypatch):
    import pytest

    from fareflow.sources import upsert
    from fareflow.streaming import scratch_dir
    table = upsert.KeyedTable(spark, scratch_dir(spark, "half"), "k", buckets=4).create(spark.range(40).selectExpr("id k", "id v"))
    changes = spark.range(40).selectExpr("id k", "id + 100 v")
    write = upsert.KeyedTable._write

    def some(self, rows):
        write(self, rows.where("bucket < 2"))
        raise RuntimeError("lost")

    monkeypatch.setattr(upsert.KeyedTable, "_write", some)
    with pytest.raises(RuntimeError):
        table.upsert(changes, 7)
    monkeypatch.undo()
    assert not table.was_applied(7)
    table.upsert(changes, 7)
    assert sorted(r.v for r in table.read().collect()) == list(range(100, 140))


def test_unreadable_table_is_an_error(spark):
    import pytest

    from fareflow.sources.upsert import KeyedTable
    from fareflow.streaming import scratch_dir
    table = KeyedTable(spark, scratch_dir(spark, "broken"), "k", buckets=2).create(spark.range(4).selectExpr("id k"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.path + "/rows/bucket=1/part-0.parquet")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(b"not parquet at all")
    out.close()
    with pytest.raises(Exception, match="(?i)parquet"):
        table.read().collect()


def test_high_water_mark(spark):
    from fareflow.plans.lineage import folders_in
    from fareflow.sources.upsert import HighWater
    from fareflow.streaming import scratch_dir
    mark = HighWater(spark, scratch_dir(spark, "ids"))
    assert mark.before(0) is None
    mark.write(-1, 500)
    for n in range(40):
        assert mark.before(n) == 500 + 10 * n
        mark.write(n, 510 + 10 * n)
        mark.write(n, 510 + 10 * n)                      # run again: the same mark
    assert mark.before(40) == 900 and len([x for x in folders_in(spark, mark.path) if x.startswith("batch=")]) == mark.KEEP + 1
    mark.write(39, 905)
    assert mark.before(40) == 905 and mark.before(39) == 890


def test_missing_table_and_missing_checkpoint_folder_fail(spark):
    import pytest

    from fareflow import session
    from fareflow.sources.tables import load_tables
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_tables(spark, "/tmp/no-such-folder", ("nation",))

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_no_key_material_in_the_plan(spark):
    from fareflow.plans.checks import physical_plan
    secret = "whsec_plan_probe"
    df = spark.createDataFrame([(1, T(2024, 1, 1), "p", "t=1,v1=0")], "event_id long, received_at timestamp_ntz, payload string, sig_header string")
    out = payments.verify_payment_events(df, secret)
    out.collect()
    text = physical_plan(out) + out._jdf.queryExecution().toString()
    assert not any(pad in text.lower() or pad[:32] in text.lower() for pad in payments.hmac_pads(secret))


def test_cuts_can_be_removed(spark):
    from fareflow.plans import lineage
    kept = lineage.cut_lineage(spark.range(3))
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert lineage.path_exists(spark, path) and lineage.remove_cuts(spark) >= 1 and not lineage.path_exists(spark, path)

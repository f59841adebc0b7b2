"""

Each entry takes ``(spark, sf_dir)``, builds the fixture views it needs over
the whole base tables of ``sf_dir`` and returns the operator's DataFrame
(lazy, but for admission rounds, generated ids, streams and tables that are
kept for two uses, which run while they are built).  The DuckDB oracle of each entry lives in ``oracles.py`` and is
written independently in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality
from ..functions import rules as R
from ..operators import accounts, admission, inventory, listings, money, notifications, stored
from ..operators import bookings as B
from ..sources import requests as S
from ..sources import layout, sinks
from ..sources.fixtures import WEBHOOK_TEST_SECRET, build_fixtures
from ..sources.upsert import KeyedTable
from ..streaming import daily, payments, scratch_dir
from ..streaming import state as E4
from ..streaming.admission import AdmissionStream
from .lineage import cut_lineage, folders_in

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


_CATALOG = ("trips", "routes", "route_stops", "buses", "bus_classes", "partners", "seats")


@query
def q_trip_search(spark, sf):
    fx = build_fixtures(spark, sf, "search_requests", *_CATALOG)
    return inventory.trip_search(fx["search_requests"], *(fx[n] for n in _CATALOG))


@query
def q_trip_search_by_day(spark, sf):
    """J1 over trips stored by departure day: only the requested days are read."""
    fx = build_fixtures(spark, sf, "search_requests", *_CATALOG)
    path = scratch_dir(spark, "trips")
    layout.write_with_layout(fx["trips"], path, "trips_by_day")
    return inventory.trip_search(fx["search_requests"], layout.read_trips_by_day(spark, path), *(fx[n] for n in _CATALOG[1:]))


@query
def q_unmatched_searches(spark, sf):
    fx = build_fixtures(spark, sf, "search_requests", *_CATALOG)
    return inventory.unmatched_searches(fx["search_requests"], *(fx[n] for n in _CATALOG))


@query
def q_bus_free_seats(spark, sf):
    fx = build_fixtures(spark, sf, "seats")
    return inventory.bus_free_seats(fx["seats"])


@query
def q_available_seats(spark, sf):
    fx = build_fixtures(spark, sf, "trips", "buses", "seats", "bookings", "passengers")
    return inventory.available_seats(fx["trips"], fx["buses"], fx["seats"], fx["bookings"], fx["passengers"])


@query
def q_double_booked_seats(spark, sf):
    fx = build_fixtures(spark, sf, "bookings", "passengers")
    return inventory.double_booked_seats(fx["bookings"], fx["passengers"], inventory.double_booking_tasks(fx["bookings"]))


# ---------------------------------------------------------------------------
# Read side: listings, reports, lookups
# ---------------------------------------------------------------------------

# "Now" of the registered keyed updates (a parameter, never the wall clock).
AS_OF = "1998-08-02 12:00:00"
LISTING_FILTER = {"status": "Paid", "ts_from": "1994-01-01", "ts_to": "1997-06-30"}
_HISTORY = ("users", "bookings", "trips", "routes", "buses", "bus_classes", "partners")


@query
def q_booking_history(spark, sf):
    fx = build_fixtures(spark, sf, *_HISTORY)
    return listings.booking_history(*(fx[n] for n in _HISTORY))


@query
def q_booking_contacts(spark, sf):
    fx = build_fixtures(spark, sf, "bookings", "users")
    return listings.booking_contacts(fx["bookings"], fx["users"])


@query
def q_default_cancel_policy(spark, sf):
    fx = build_fixtures(spark, sf, "trips", "cancel_policies")
    return listings.default_cancel_policy(fx["trips"], fx["cancel_policies"])


@query
def q_latest_device_token(spark, sf):
    fx = build_fixtures(spark, sf, "user_device_tokens")
    return listings.latest_device_token(fx["user_device_tokens"])


@query
def q_faq_list(spark, sf):
    return listings.faq_list(build_fixtures(spark, sf, "faqs")["faqs"])


@query
def q_faq_category_counts(spark, sf):
    return listings.faq_category_counts(build_fixtures(spark, sf, "faqs")["faqs"])


@query
def q_filter_listing(spark, sf):
    fx = build_fixtures(spark, sf, "commissions")
    return money.filter_listing(fx["commissions"], status="Pending", ts_from="1995-03-01", ts_to="1996-12-31")


def _summary(spark, sf):
    fx = build_fixtures(spark, sf, "commissions", "bookings", "partners")
    return fx, money.commission_summary(fx["commissions"], fx["bookings"], fx["partners"])


@query
def q_partner_commissions(spark, sf):
    _, summary = _summary(spark, sf)
    return money.filter_listing(summary, **LISTING_FILTER)


@query
def q_partner_commission_totals(spark, sf):
    fx, summary = _summary(spark, sf)
    return money.partner_commission_totals(summary, fx["partners"], **LISTING_FILTER)


@query
def q_partner_month_stats(spark, sf):
    return money.partner_month_stats(build_fixtures(spark, sf, "commissions")["commissions"])


@query
def q_daily_commission_summary(spark, sf):
    return money.daily_commission_summary(build_fixtures(spark, sf, "commissions")["commissions"])


@query
def q_commission_by_booking(spark, sf):
    fx, summary = _summary(spark, sf)
    return money.commission_by_booking(fx["bookings"], summary)


@query
def q_refund_commission_report(spark, sf):
    fx = build_fixtures(spark, sf, "commissions", "refund_transactions")
    return money.with_count(money.refund_commission_report(fx["commissions"], fx["refund_transactions"]),
                            counted=money.refund_commission_keys(fx["commissions"], fx["refund_transactions"]))


def _details(spark, sf):
    fx = build_fixtures(spark, sf, "refund_transactions", "bookings", "users")
    return fx, money.refund_details(fx["refund_transactions"], fx["bookings"], fx["users"])


@query
def q_refund_listing(spark, sf):
    fx, details = _details(spark, sf)
    chosen = {"status": "Pending", "ts_to": "1996-06-30", "status_col": "refund_status"}
    keys = money.refund_detail_keys(fx["refund_transactions"], fx["bookings"], fx["users"])
    return money.with_count(money.filter_listing(details, **chosen), counted=money.filter_listing(keys, **chosen, sort=False))


@query
def q_refund_by_booking(spark, sf):
    fx, details = _details(spark, sf)
    return money.refund_by_booking(fx["bookings"], details)


@query
def q_mark_commissions_paid(spark, sf):
    fx = build_fixtures(spark, sf, "commissions", "commission_commands")
    return money.mark_commissions_paid(fx["commissions"], fx["commission_commands"], AS_OF)[0]


@query
def q_mark_commissions_paid_rows(spark, sf):
    fx = build_fixtures(spark, sf, "commissions", "commission_commands")
    return money.mark_commissions_paid(fx["commissions"], fx["commission_commands"], AS_OF)[1]


@query
def q_recalculate_commissions(spark, sf):
    fx = build_fixtures(spark, sf, "commissions", "commission_adjustments")
    return money.recalculate_commissions(fx["commissions"], fx["commission_adjustments"])[0]


@query
def q_recalculate_commissions_rows(spark, sf):
    fx = build_fixtures(spark, sf, "commissions", "commission_adjustments")
    return money.recalculate_commissions(fx["commissions"], fx["commission_adjustments"])[1]


@query
def q_process_refunds(spark, sf):
    fx = build_fixtures(spark, sf, "refund_transactions", "refund_commands")
    return money.process_refunds(fx["refund_transactions"], fx["refund_commands"], AS_OF)


@query
def q_complete_refunds(spark, sf):
    fx = build_fixtures(spark, sf, "refund_transactions", "refund_commands")
    return money.complete_refunds(fx["refund_transactions"], fx["refund_commands"], AS_OF)


# ---------------------------------------------------------------------------
# Accounts, contact quality, tokens
# ---------------------------------------------------------------------------


TOKEN_BATCH_START = "2024-01-20 00:00:00"


@query
def q_resolve_identifiers(spark, sf):
    fx = build_fixtures(spark, sf, "identifier_lookups", "users")
    return accounts.resolve_identifiers(fx["identifier_lookups"], fx["users"])


@query
def q_duplicate_accounts(spark, sf):
    return accounts.duplicate_accounts(build_fixtures(spark, sf, "users")["users"])


@query
def q_admit_accounts(spark, sf):
    fx = build_fixtures(spark, sf, "registrations", "users")
    return accounts.admit_accounts(fx["registrations"], fx["users"])


def _phone_updates(fx):
    # stand-in command table: each registration row read as (user_id, new phone)
    return fx["registrations"].select(F.col("registration_id").alias("user_id"), "phone_number", F.col("registration_id").alias("command_id"))


@query
def q_apply_phone_updates(spark, sf):
    fx = build_fixtures(spark, sf, "registrations", "users")
    return accounts.apply_phone_updates(fx["users"], _phone_updates(fx))[0]


@query
def q_apply_phone_updates_state(spark, sf):
    fx = build_fixtures(spark, sf, "registrations", "users")
    return accounts.apply_phone_updates(fx["users"], _phone_updates(fx))[1]


@query
def q_upsert_device_tokens(spark, sf):
    t = build_fixtures(spark, sf, "user_device_tokens")["user_device_tokens"]
    cut = F.to_timestamp_ntz(F.lit(TOKEN_BATCH_START))
    return accounts.upsert_device_tokens(t.filter(F.col("created_at") < cut), t.filter(F.col("created_at") >= cut))


@query
def q_quality_report(spark, sf):
    return quality.quality_report(build_fixtures(spark, sf, "users")["users"], "user_id")


@query
def q_quality_summary(spark, sf):
    return quality.quality_summary(build_fixtures(spark, sf, "users")["users"])


# ---------------------------------------------------------------------------
# Rules, guarded updates, notifications, scalar functions
# ---------------------------------------------------------------------------

_CANCEL = ("cancel_requests", "bookings", "trips", "cancel_policy_rules")


@query
def q_match_cancel_rule(spark, sf):
    fx = build_fixtures(spark, sf, *_CANCEL)
    return B.cancel_rule_matches(*(fx[n] for n in _CANCEL))


@query
def q_cancellation_quote(spark, sf):
    fx = build_fixtures(spark, sf, *_CANCEL)
    return B.cancellation_quote(*(fx[n] for n in _CANCEL))


def _cancellations(spark, sf):
    fx = build_fixtures(spark, sf, *_CANCEL, "passengers")
    return B.apply_cancellations(*(fx[n] for n in _CANCEL), fx["passengers"])


@query
def q_apply_cancellations(spark, sf):
    return _cancellations(spark, sf)["outcomes"]


@query
def q_apply_cancellations_bookings(spark, sf):
    return _cancellations(spark, sf)["bookings"]


@query
def q_apply_cancellations_ledger(spark, sf):
    return _cancellations(spark, sf)["ledger"]


@query
def q_apply_cancellations_freed_seats(spark, sf):
    return _cancellations(spark, sf)["freed_seats"]


@query
def q_refund_fee_quote(spark, sf):
    fx = build_fixtures(spark, sf, "refund_transactions", "bookings", "trips", "cancel_policy_rules")
    targets = fx["refund_transactions"].select("booking_id", F.col("created_at").alias("requested_at"))
    return B.refund_fee_quote(targets, fx["bookings"], fx["trips"], fx["cancel_policy_rules"])


@query
def q_apply_payment_updates(spark, sf):
    fx = build_fixtures(spark, sf, "bookings", "payment_updates")
    return B.apply_payment_updates(fx["bookings"], fx["payment_updates"])[0]


@query
def q_apply_payment_updates_state(spark, sf):
    fx = build_fixtures(spark, sf, "bookings", "payment_updates")
    return B.apply_payment_updates(fx["bookings"], fx["payment_updates"])[1]


@query
def q_confirm_bookings(spark, sf):
    fx = build_fixtures(spark, sf, "bookings", "users", "confirm_commands")
    return B.confirm_bookings(fx["bookings"], fx["users"], fx["confirm_commands"])[0]


@query
def q_confirm_bookings_audit(spark, sf):
    fx = build_fixtures(spark, sf, "bookings", "users", "confirm_commands")
    return B.confirm_bookings(fx["bookings"], fx["users"], fx["confirm_commands"])[1]


@query
def q_submit_payment_proof(spark, sf):
    fx = build_fixtures(spark, sf, "bookings", "payment_proofs")
    return B.submit_payment_proof(fx["bookings"], fx["payment_proofs"])[0]


@query
def q_submit_payment_proof_state(spark, sf):
    fx = build_fixtures(spark, sf, "bookings", "payment_proofs")
    return B.submit_payment_proof(fx["bookings"], fx["payment_proofs"])[1]


@query
def q_notification_outbox(spark, sf):
    """Outbox of the accepted payment updates (B2) and confirmations."""
    fx = build_fixtures(spark, sf, "bookings", "users", "payment_updates", "confirm_commands", "user_device_tokens")
    paid = B.apply_payment_updates(fx["bookings"], fx["payment_updates"])[0].filter(F.col("reject_reason").isNull())
    conf = B.confirm_bookings(fx["bookings"], fx["users"], fx["confirm_commands"])[0].filter(
        F.col("reject_reason").isNull())
    changes = (paid.select("booking_id", "status")
               .unionByName(conf.select("booking_id", F.col("booking_status").alias("status"))))
    contacts = listings.booking_contacts(fx["bookings"], fx["users"])
    return notifications.notification_outbox(changes.join(contacts, "booking_id"), fx["user_device_tokens"])


@query
def q_trip_duration(spark, sf):
    t = build_fixtures(spark, sf, "trips")["trips"]
    return t.select("trip_id", R.trip_duration("departure_time", "arrival_time").alias("duration"),
                    R.duration_minutes("departure_time", "arrival_time").cast("bigint").alias("duration_minutes"))


@query
def q_minor_units(spark, sf):
    b = build_fixtures(spark, sf, "bookings")["bookings"]
    return b.select("booking_id", "total_price", R.minor_units("total_price").alias("amount_minor"),
                    R.minor_units_exact("total_price").alias("amount_minor_exact"))


@query
def q_contact_checks(spark, sf):
    u = build_fixtures(spark, sf, "users")["users"]
    return u.select("user_id", R.valid_email("email").alias("email_ok"), R.valid_phone("phone_number").alias("phone_ok"),
                    R.normalize_phone("phone_number").alias("whatsapp_number"),
                    R.required("full_name").alias("name_ok"))


# ---------------------------------------------------------------------------
# Admission: booking requests, tickets
# ---------------------------------------------------------------------------

_ADMIT = ("booking_requests_raw", "trips", "cancel_policies", "seats", "bookings", "passengers")


def _parsed(spark, sf):
    fx = build_fixtures(spark, sf, *_ADMIT)
    return fx, S.parse_booking_requests(fx["booking_requests_raw"])


@query
def q_parse_booking_requests(spark, sf):
    _, req = _parsed(spark, sf)
    return req.select("request_id", "received_at", "user_id", "trip_id", "total_price", "payment_method",
                      F.size("passengers").alias("n_passengers"))


@query
def q_expand_passengers(spark, sf):
    _, req = _parsed(spark, sf)
    return admission.expand_passengers(req)


@query
def q_resolve_seat_codes(spark, sf):
    fx, req = _parsed(spark, sf)
    return admission.resolve_seat_codes(req, fx["trips"], fx["seats"])[1]


@query
def q_booking_request_checks(spark, sf):
    fx, req = _parsed(spark, sf)
    return admission.booking_request_checks(req, fx["trips"], fx["cancel_policies"], fx["seats"], fx["bookings"],
                                            fx["passengers"])


def _admitted(spark, sf):
    fx, req = _parsed(spark, sf)
    return admission.admit_bookings(req, fx["trips"], fx["cancel_policies"], fx["seats"], fx["bookings"],
                                    fx["passengers"])


@query
def q_admit_bookings(spark, sf):
    return _admitted(spark, sf)["outcomes"]


def _admitted_as_stream(spark, sf):
    """The same requests in order of arrival over several micro-batches."""
    fx = build_fixtures(spark, sf, *_ADMIT)
    base = _in_order(spark, fx["booking_requests_raw"], "requests", "received_at", "request_id")
    raw = spark.read.parquet(base + "/in")
    tables = [cut_lineage(fx[n]) for n in ("trips", "cancel_policies", "seats")]        # read by every batch
    out = AdmissionStream(spark, *tables, fx["bookings"], fx["passengers"], base + "/out")
    out.run(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", _a_trigger(spark, base)).parquet(base + "/in"), base + "/ck")
    return out


@query
def q_admit_bookings_stream(spark, sf):
    """B1 over micro-batches: held seats and the last id are carried from batch to batch; outcomes."""
    return _admitted_as_stream(spark, sf).read("outcomes")


@query
def q_admit_bookings_stream_passengers(spark, sf):
    return _admitted_as_stream(spark, sf).read("passengers")


@query
def q_admit_bookings_passengers(spark, sf):
    return _admitted(spark, sf)["passengers"]


# ---------------------------------------------------------------------------
# Streams: payment webhooks, daily commissions
# ---------------------------------------------------------------------------


def _verified(spark, sf):
    fx = build_fixtures(spark, sf, "webhooks_raw", "bookings")
    return fx, payments.verify_payment_events(fx["webhooks_raw"], WEBHOOK_TEST_SECRET)


@query
def q_verify_payment_events(spark, sf):
    return _verified(spark, sf)[1].select("event_id", "received_at", "t", "verified", "reject_reason")


@query
def q_gateway_payments(spark, sf):
    return payments.gateway_payments(_verified(spark, sf)[1])


@query
def q_apply_gateway_payments(spark, sf):
    fx, v = _verified(spark, sf)
    return payments.apply_gateway_payments(fx["bookings"], payments.gateway_payments(v))


STREAM_FILES = 4                 # micro-batches of a registered stream: as many times _files_a_batch files
FILE_ROWS = 100_000              # rows of such a file, more or less: each is written by one task


def _files_a_batch(df):
    """Files of each micro-batch: they grow in number with the rows, not in size."""
    return max(1, df.count() // (STREAM_FILES * FILE_ROWS))


def _a_trigger(spark, base):
    """Files that make one micro-batch of the folder that ``_as_files`` or ``_in_order`` wrote."""
    return max(1, len([f for f in folders_in(spark, base + "/in") if f.startswith("part-")]) // STREAM_FILES)


def _as_files(spark, df, name, *by):
    """Write rows to a fresh folder as files dealt by the
    hash of ``by``: every file spans the whole time range, so the stream that
    reads them batch by batch sees its events out of order."""
    base = scratch_dir(spark, name)
    df.repartition(STREAM_FILES * _files_a_batch(df), *by).write.parquet(base + "/in")
    return base


def _in_order(spark, df, name, *by):
    """Write rows to a fresh folder as ``STREAM_FILES`` ranges of ``by``, one
    after the other and each in equally many files: a key's events are spread
    over the ranges, and the stream that reads them one by one sees them in order."""
    base = scratch_dir(spark, name)
    rows = cut_lineage(df)                                # read for the bounds of the ranges, then for its rows
    files = _files_a_batch(rows)
    ranged = cut_lineage(rows.repartitionByRange(STREAM_FILES * files, *by)
                         .withColumn("batch_no", F.floor(F.spark_partition_id() / files).cast("int")))
    for n in range(STREAM_FILES):
        batch = ranged.where(F.col("batch_no") == n).drop("batch_no")
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(base + "/in")
    return base


def _gateway(spark, sf, deal, *by):
    """Webhooks dealt to files, run through E1, E6, E2 and E3 as a stream; its output folder."""
    fx = build_fixtures(spark, sf, "webhooks_raw", "bookings")
    rows = (fx["webhooks_raw"].withColumn("received_at", F.col("received_at").cast("timestamp"))
            .select(*[f.name for f in payments.WEBHOOK_SCHEMA.fields]))
    base = deal(spark, rows, "webhooks", *by)
    stream = payments.read_payment_events(spark, base + "/in", max_files_per_trigger=_a_trigger(spark, base))          # S4
    payments.run_gateway_stream(spark, stream, fx["bookings"], WEBHOOK_TEST_SECRET, base + "/out", base + "/ck")
    return base + "/out"


@query
def q_gateway_payment_stream(spark, sf):
    """E1 -> E2 -> E3 as a stream of several micro-batches in order of time: a
    booking's events meet its state of earlier batches, and the same event wins
    as in the batch operator."""
    out = payments.applied_payments(spark, _gateway(spark, sf, _in_order, "received_at", "event_id"))
    return out.withColumn("payment_timestamp", F.col("payment_timestamp").cast("timestamp_ntz"))


@query
def q_gateway_payment_stream_unordered(spark, sf):
    """The same with files out of order.  Which payment of a booking comes first
    depends on the batches, so the result is the paid bookings."""
    out = payments.applied_payments(spark, _gateway(spark, sf, _as_files, "event_id"))
    return out.select("booking_id", "payment_status", "payment_method")


@query
def q_gateway_rejects_stream(spark, sf):
    """E6 in the same stream: every event that verification rejects has its row."""
    return payments.rejected_events(spark, _gateway(spark, sf, _as_files, "event_id")).select("event_id", "reject_reason")


@query
def q_stream_daily_commissions(spark, sf):
    """E5: G4 as a stream of several micro-batches that all reach over the whole time range; closed days only."""
    c = build_fixtures(spark, sf, "commissions")["commissions"]
    base = _as_files(spark, c, "commissions", "commission_id")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", _a_trigger(spark, base)).parquet(base + "/in")
    daily.run_daily_commission_stream(stream, base + "/out", base + "/ck")
    return daily.closed_days(spark, base + "/out")


@query
def q_admit_tickets(spark, sf):
    return accounts.admit_tickets(build_fixtures(spark, sf, "tickets_raw")["tickets_raw"], as_of=AS_OF)


# ---------------------------------------------------------------------------
# Per-booking fold of the five command feeds
# ---------------------------------------------------------------------------


def _commands(spark, sf):
    fx = build_fixtures(spark, sf, "bookings", "confirm_commands", "payment_updates", "webhooks_raw",
                        "payment_proofs", "cancel_requests")
    gateway = payments.gateway_payments(payments.verify_payment_events(fx["webhooks_raw"], WEBHOOK_TEST_SECRET))
    return fx["bookings"], E4.booking_commands(fx["bookings"], fx["confirm_commands"], fx["payment_updates"], gateway,
                                               fx["payment_proofs"], fx["cancel_requests"])


def _booking_state(spark, sf):
    bookings, cmds = _commands(spark, sf)
    return E4.booking_state(cmds, bookings)


@query
def q_booking_state(spark, sf):
    return _booking_state(spark, sf)[1]


@query
def q_booking_state_verdicts(spark, sf):
    return _booking_state(spark, sf)[0].drop("seq")


def _state_stream(spark, sf):
    """All commands in order of time over several micro-batches, so a booking's
    commands meet its state of earlier batches; the stream's output folder."""
    bookings, cmds = _commands(spark, sf)
    base = _in_order(spark, cmds, "commands", "ts", "seq")
    stream = spark.readStream.schema(cmds.schema).option("maxFilesPerTrigger", _a_trigger(spark, base)).parquet(base + "/in")
    E4.run_booking_state_stream(stream, bookings, base + "/out", base + "/ck")
    return base + "/out"


@query
def q_booking_state_stream(spark, sf):
    """E4 with its state in the engine; final states."""
    return E4.final_states(spark, _state_stream(spark, sf))


@query
def q_booking_state_stream_verdicts(spark, sf):
    """E4 with its state in the engine; the verdict on every command."""
    return E4.stream_verdicts(spark, _state_stream(spark, sf)).drop("seq")


@query
def q_login_lookup(spark, sf):
    """S3 + J6: login bodies -> identifier (``identifier ?? email ?? phone
    ?? phone_number``) -> user.  Stand-in bodies: each lookup's identifier
    under one of the four keys, chosen by the lookup id."""
    fx = build_fixtures(spark, sf, "identifier_lookups", "users")
    key = F.element_at(F.array(*[F.lit(k) for k in ("identifier", "email", "phone", "phone_number")]),
                       (F.col("lookup_id") % 4 + 1).cast("int"))
    bodies = fx["identifier_lookups"].select(
        "lookup_id", F.to_json(F.create_map(key, F.col("identifier"))).alias("body"))
    return accounts.resolve_identifiers(S.parse_identifier(bodies), fx["users"])


@query
def q_apply_cancellations_passengers(spark, sf):
    return _cancellations(spark, sf)["passengers"]


@query
def q_admit_bookings_bookings(spark, sf):
    return _admitted(spark, sf)["bookings"]


@query
def q_admit_bookings_seat_updates(spark, sf):
    return _admitted(spark, sf)["seat_updates"]


@query
def q_admit_bookings_outbox(spark, sf):
    """N2 for the bookings B1 creates (status Unpaid)."""
    fx = build_fixtures(spark, sf, "users", "user_device_tokens")
    created = notifications.booking_created_changes(_admitted(spark, sf)["bookings"], fx["users"])
    return notifications.notification_outbox(created, fx["user_device_tokens"])


# ---------------------------------------------------------------------------
# Request forms, sinks, casts, payload merge, seat modes
# ---------------------------------------------------------------------------
@query
def q_partner_listing(spark, sf):
    """M2 by the partner's key and its own filters."""
    fx, summary = _summary(spark, sf)
    return money.partner_listing(build_fixtures(spark, sf, "listing_requests")["listing_requests"], summary)


@query
def q_partner_stats_for(spark, sf):
    """G2 for requested (partner, year, month) triples, matched or not."""
    fx = build_fixtures(spark, sf, "stats_requests", "commissions")
    return money.partner_stats_for(fx["stats_requests"], fx["commissions"])


@query
def q_sink_batches(spark, sf):
    """Three keyed batches, one of them written twice (a replay), read back."""
    refunds = build_fixtures(spark, sf, "refund_transactions")["refund_transactions"]
    path = scratch_dir(spark, "batches")
    for batch in (0, 1, 2, 1):
        sinks.write_batch(refunds.filter(F.col("refund_id") % 3 == batch), path, batch)
    return spark.read.parquet(path).select("refund_id", "booking_id", "refund_status", "created_at", "batch_id")


@query
def q_sink_appends(spark, sf):
    """A table appended to twice, partitioned by status, read back."""
    refunds = build_fixtures(spark, sf, "refund_transactions")["refund_transactions"]
    path = scratch_dir(spark, "appends")
    for part in (0, 1):
        sinks.append_rows(refunds.filter(F.col("refund_id") % 2 == part), path, partition_by=["refund_status"])
    return spark.read.parquet(path).select("refund_id", "booking_id", "refund_status", "created_at")


@query
def q_sink_json(spark, sf):
    """Rows and their count written as JSON, read back."""
    users = build_fixtures(spark, sf, "users")["users"]
    path = scratch_dir(spark, "json")
    sinks.write_json(users, path)
    return money.with_count(spark.read.schema(users.schema).json(path + "/rows")).join(
        spark.read.schema("count long").json(path + "/_envelope"), "count")


# ---------------------------------------------------------------------------
# Joins of tables stored in buckets of their key
# ---------------------------------------------------------------------------
TABLE_BUCKETS = 16


def _bucketed(spark, fx, key, *names):
    return [layout.write_bucketed(fx[n], scratch_dir(spark, n), key, TABLE_BUCKETS) for n in names]


@query
def q_booking_history_bucketed(spark, sf):
    """J2 with users and bookings in buckets of the user."""
    fx = build_fixtures(spark, sf, *_HISTORY)
    return listings.booking_history(*_bucketed(spark, fx, "user_id", "users", "bookings"), *(fx[n] for n in _HISTORY[2:]))


@query
def q_booking_contacts_bucketed(spark, sf):
    """J7 with both tables in buckets of the user."""
    fx = build_fixtures(spark, sf, "bookings", "users")
    return listings.booking_contacts(*_bucketed(spark, fx, "user_id", "bookings", "users"))


@query
def q_double_booked_seats_bucketed(spark, sf):
    """J9 with both tables in buckets of the booking."""
    fx = build_fixtures(spark, sf, "bookings", "passengers")
    return inventory.double_booked_seats(*_bucketed(spark, fx, "booking_id", "bookings", "passengers"))


@query
def q_apply_gateway_payments_bucketed(spark, sf):
    """E3 with the bookings in buckets of their id."""
    fx, v = _verified(spark, sf)
    return payments.apply_gateway_payments(*_bucketed(spark, fx, "booking_id", "bookings"), payments.gateway_payments(v))


# ---------------------------------------------------------------------------
# Keyed updates applied to stored tables, each batch twice (a retry)
# ---------------------------------------------------------------------------
def _stored(spark, name, rows, key, by=None):
    return KeyedTable(spark, scratch_dir(spark, name), key, buckets=16, by=by).create(rows)


@query
def q_store_payment_updates(spark, sf):
    """B2 applied to the bookings table, read back."""
    fx = build_fixtures(spark, sf, "bookings", "payment_updates")
    table = _stored(spark, "bookings", fx["bookings"], "booking_id")
    for _ in range(2):
        stored.store_payment_updates(table, fx["payment_updates"], 0)
    return table.read()


@query
def q_store_confirmations(spark, sf):
    """B3 applied to the bookings table, read back."""
    fx = build_fixtures(spark, sf, "bookings", "users", "confirm_commands")
    table = _stored(spark, "bookings", fx["bookings"], "booking_id")
    for _ in range(2):
        stored.store_confirmations(table, fx["users"], fx["confirm_commands"], 0)
    return table.read()


def _store_cancelled(spark, sf):
    fx = build_fixtures(spark, sf, *_CANCEL, "passengers", "seats")
    table = _stored(spark, "bookings", stored.with_columns(fx["bookings"], stored.CANCEL_COLUMNS), "booking_id")
    passengers = _stored(spark, "passengers", fx["passengers"], ["passenger_id", "booking_id"], by=["booking_id"])
    seats = _stored(spark, "seats", fx["seats"], "seat_id")
    for _ in range(2):
        stored.store_cancellations(table, fx["cancel_requests"], fx["trips"], fx["cancel_policy_rules"], passengers, seats, 0)
    return {"bookings": table, "passengers": passengers, "seats": seats}


@query
def q_store_cancellations(spark, sf):
    """C2 applied to the bookings table, read back."""
    return _store_cancelled(spark, sf)["bookings"].read()


@query
def q_store_cancellations_seats(spark, sf):
    """C2 applied to the seats table, read back."""
    return _store_cancelled(spark, sf)["seats"].read()


@query
def q_store_refunds(spark, sf):
    """R1, then R2, as two batches on the refunds table, read back."""
    fx = build_fixtures(spark, sf, "refund_transactions", "refund_commands")
    table = _stored(spark, "refunds", stored.with_columns(fx["refund_transactions"], stored.REFUND_COLUMNS), "refund_id")
    stored.store_processed_refunds(table, fx["refund_commands"], AS_OF, 0)
    stored.store_completed_refunds(table, fx["refund_commands"], AS_OF, 1)
    stored.store_processed_refunds(table, fx["refund_commands"], AS_OF, 0)
    return table.read().drop("bank_name", "bank_account", "account_holder_name", "kareemi_number")


@query
def q_store_paid_commissions(spark, sf):
    """K1 applied to the commissions table, read back."""
    fx = build_fixtures(spark, sf, "commissions", "commission_commands")
    table = _stored(spark, "commissions", stored.with_columns(fx["commissions"], stored.COMMISSION_COLUMNS), "commission_id")
    for _ in range(2):
        stored.store_paid_commissions(table, fx["commission_commands"], AS_OF, 0)
    return table.read()


@query
def q_store_recalculated_commissions(spark, sf):
    """K2 applied to the commissions table, read back."""
    fx = build_fixtures(spark, sf, "commissions", "commission_adjustments")
    table = _stored(spark, "commissions", fx["commissions"], ["commission_id", "booking_id"], by=["booking_id"])
    for _ in range(2):
        stored.store_recalculated_commissions(table, fx["commission_adjustments"], 0)
    return table.read()


@query
def q_store_phone_updates(spark, sf):
    """A4 applied to the users table, read back."""
    fx = build_fixtures(spark, sf, "registrations", "users")
    table = _stored(spark, "users", fx["users"], "user_id")
    for _ in range(2):
        stored.store_phone_updates(table, _phone_updates(fx), 0)
    return table.read()


@query
def q_lenient_casts(spark, sf):
    """Q1, Q2 and Q8 over strings as clients send them."""
    n = build_fixtures(spark, sf, "awkward_numbers")["awkward_numbers"]
    return n.select("row_id", R.lenient_int("s").alias("as_int"), R.lenient_float("s").alias("as_price"), R.positive_int("s").alias("positive"))


@query
def q_merge_payload(spark, sf):
    """M5: the system's payload of a payment update under the caller's fields; the caller wins."""
    u = build_fixtures(spark, sf, "payment_updates")["payment_updates"]
    system = F.create_map(F.lit("booking_id"), F.col("booking_id").cast("string"), F.lit("status"), F.col("payment_status"),
                          F.lit("channel"), F.lit("push"))
    caller = F.map_filter(F.create_map(F.lit("channel"), F.col("payment_method"), F.lit("tx"), F.col("transaction_id")), lambda k, v: v != "")
    m = u.select("command_id", notifications.merge_payload(system, caller).alias("m"))
    return m.select("command_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("booking_id", "status", "channel", "tx")],
                    F.size("m").alias("n_keys"))


def _seats(spark, sf, **mode):
    fx = build_fixtures(spark, sf, "trips", "buses", "seats", "bookings", "passengers")
    return inventory.available_seats(fx["trips"], fx["buses"], fx["seats"], fx["bookings"], fx["passengers"], **mode)


@query
def q_available_seats_not_exists(spark, sf):
    """J4 where a passenger without a seat does not empty the trip."""
    return _seats(spark, sf, null_aware=False)


@query
def q_available_seats_active(spark, sf):
    """J4 where cancelled passengers hold no seat."""
    return _seats(spark, sf, null_aware=False, ignore_cancelled=True)

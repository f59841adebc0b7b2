"""Booking rules and guarded updates.

Every operator takes a batch of requests/commands plus the current tables
and returns DataFrames: per-command outcomes (``reject_reason`` null when
accepted) and, where the reference writes, the new rows.  "Now" is a column
of the request (``requested_at``/``ts``), never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import (CANCEL_REASON, CONFIRM_NOTE, PAYMENT_METHODS, PAYMENT_STATUSES, PROOF_NOTE, falsy_default,
                               hours_before_departure, refund_amount)
from ..plans.lineage import cut_lineage
from .keyed import arrival, first_per_key, reasons

MONEY = "decimal(12,2)"
PCT = "decimal(5,2)"


def match_cancel_rule(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """J5 + W1: for each request row (``_rk`` key, ``cancel_policy_id``,
    ``hours``) the active rule of its policy with ``min <= hours`` and
    ``(max IS NULL OR hours < max)``; the greatest ``min`` wins, ties to the
    lowest rule id.  Equi-join on the policy with the range as residual,
    then a partial-aggregate ``min`` per request - no window, no nested loop.
    Returns ``(_rk, rule_id, refund_percentage, cancellation_fee)``."""
    r = rules.filter(F.col("is_active")).select(
        "cancel_policy_id", F.col("cancel_policy_rule_id").alias("rule_id"),
        F.col("min_hours_before_departure").alias("min_h"), F.col("max_hours_before_departure").alias("max_h"),
        "refund_percentage", "cancellation_fee")
    q = requests.select("_rk", "cancel_policy_id", "hours")
    m = q.join(r, (q["cancel_policy_id"] == r["cancel_policy_id"]) & (r["min_h"] <= q["hours"])
               & (r["max_h"].isNull() | (q["hours"] < r["max_h"])))
    best = m.groupBy("_rk").agg(F.min(F.struct(
        (-F.col("min_h")).alias("neg_min"), F.col("rule_id"), F.col("refund_percentage"),
        F.col("cancellation_fee"))).alias("b"))
    return best.select("_rk", F.col("b.rule_id").alias("rule_id"),
                       F.col("b.refund_percentage").alias("refund_percentage"),
                       F.col("b.cancellation_fee").alias("cancellation_fee"))


def cancel_rule_matches(requests: DataFrame, bookings: DataFrame, trips: DataFrame, rules: DataFrame) -> DataFrame:
    """J5 as a table: per cancel request (booking_id, requested_at) the hours
    before departure (D2) and the rule J5/W1 picks on the booking's policy
    (null columns when none matches).  Unknown bookings are dropped (inner
    join, as the reference's lookup)."""
    j = (requests.select("booking_id", "requested_at")
         .join(bookings.select("booking_id", "cancel_policy_id", "trip_id"), "booking_id")
         .join(trips.select("trip_id", "departure_time"), "trip_id")
         .withColumn("hours", hours_before_departure("departure_time", "requested_at"))
         .withColumn("_rk", F.struct("booking_id", "requested_at")))
    return (j.join(match_cancel_rule(j, rules), "_rk", "left")
            .select("booking_id", "requested_at", "cancel_policy_id", F.col("hours").alias("hours_before_departure"),
                    F.col("rule_id").alias("cancel_policy_rule_id"), "refund_percentage", "cancellation_fee"))


def _cancel_core(requests: DataFrame, bookings: DataFrame, trips: DataFrame, rules: DataFrame,
                 mode: str) -> DataFrame:
    """Shared core of C1 (``mode='preview'``) and C2 (``mode='confirm'``)."""
    ids = ["command_id"] if "command_id" in requests.columns else []
    req = requests.select("booking_id", "requested_at", *ids,
                          (F.col("reason") if "reason" in requests.columns else F.lit(None).cast("string")).alias("reason"))
    req = req.withColumn("_rk", F.struct("booking_id", "requested_at"))
    b = (bookings.select("booking_id", "total_price", "booking_status", "payment_status", "cancel_policy_id", "trip_id")
         .join(trips.select("trip_id", "departure_time"), "trip_id")
         .withColumn("_found", F.lit(True)))
    j = req.join(b, "booking_id", "left").withColumn(
        "hours", hours_before_departure("departure_time", "requested_at"))
    if mode == "preview":
        looks_up = F.coalesce(F.col("payment_status"), F.lit("Unpaid")) != "Unpaid"
    else:   # confirm: NULL !== 'Unpaid' in PHP, so a NULL status looks a rule up
        looks_up = F.col("payment_status").isNull() | (F.col("payment_status") != "Unpaid")
    j = j.withColumn("_looks_up", looks_up)
    picked = match_cancel_rule(j.filter("_found AND _looks_up"), rules)
    j = j.join(picked, "_rk", "left")
    price = F.col("total_price").cast(MONEY)
    has_rule = F.col("rule_id").isNotNull()
    if mode == "preview":
        fee = F.when(~F.col("_looks_up"), F.lit(0)).when(has_rule, F.col("cancellation_fee")).otherwise(price)
    else:
        fee = F.when(F.col("_looks_up") & has_rule, F.col("cancellation_fee")).otherwise(price)
    pct = F.when(F.col("_looks_up") & has_rule, F.col("refund_percentage")).otherwise(F.lit(0))
    refund = F.when(F.col("_looks_up") & has_rule,
                    refund_amount(price, F.col("refund_percentage"), F.col("cancellation_fee"))).otherwise(F.lit(0))
    return (j.withColumn("cancel_policy_rule_id", F.when(F.col("_looks_up") & has_rule, F.col("rule_id"))
                         .otherwise(F.lit(0)).cast("bigint"))
            .withColumn("refund_percentage", pct.cast(PCT))
            .withColumn("cancellation_fee", fee.cast(MONEY))
            .withColumn("refund_amount", refund.cast(MONEY))
            .withColumn("non_refundable_part",
                        F.greatest(F.lit(0).cast(MONEY), price - F.col("refund_amount")).cast(MONEY)))


def cancellation_quote(requests: DataFrame, bookings: DataFrame, trips: DataFrame, rules: DataFrame) -> DataFrame:
    """C1 (preview): per request (booking_id, requested_at): an invalid id,
    an unknown booking or an already cancelled one is rejected.  Unpaid (or
    NULL, read as Unpaid) -> refund 0, fee 0.  Otherwise the matching rule
    (J5) gives D3's refund; no rule -> refund 0 and the whole price as fee.
    ``hours_before_departure`` is unrounded (the reference shows 2 places)."""
    c = _cancel_core(requests, bookings, trips, rules, "preview")
    reason = reasons((F.col("booking_id") <= 0, "invalid_booking_id"),
                     (F.col("_found").isNull(), "booking_not_found"),
                     (F.col("booking_status") == "Cancelled", "already_cancelled"))
    ok = reason.isNull()
    return c.select("booking_id", "requested_at", reason.alias("reject_reason"),
                    *[F.when(ok, F.col(x)).alias(x) for x in
                      ("total_price", "hours", "cancel_policy_rule_id", "refund_percentage", "cancellation_fee",
                       "refund_amount", "non_refundable_part")]).withColumnRenamed("hours", "hours_before_departure")


def apply_cancellations(requests: DataFrame, bookings: DataFrame, trips: DataFrame, rules: DataFrame,
                        passengers: DataFrame, keep: bool = False) -> dict[str, DataFrame]:
    """C2 (confirm): like C1 but the fee defaults to the full price even
    when Unpaid, and a NULL payment status does look a rule up.  Paid
    becomes Refunded (even for a refund of 0).  Several requests for one
    booking: the earliest (by time, then ``command_id``) wins, later ones - exact
    retries too - find it cancelled.  Returns
    ``outcomes``, ``bookings`` (changed rows), ``passengers`` (set
    Cancelled), ``freed_seats`` and ``ledger`` (booking_cancellations).
    ``keep`` stores the judged requests once, for a caller that uses several of these."""
    c = _cancel_core(requests, bookings, trips, rules, "confirm")
    c = first_per_key(c, "booking_id", [arrival(requests, "requested_at")])
    reason = reasons((F.col("_found").isNull() | (F.col("booking_status") == "Cancelled") | ~F.col("is_first"),
                      "invalid_or_already_cancelled"))
    c = c.withColumn("reject_reason", reason)
    if keep:
        c = cut_lineage(c.select("booking_id", "requested_at", "reason", "payment_status", "hours", "cancel_policy_id", "cancel_policy_rule_id",
                                 "refund_percentage", "cancellation_fee", "refund_amount", "reject_reason"))
    ok = c.filter(F.col("reject_reason").isNull())
    reason_text = F.coalesce(F.col("reason"), F.lit(CANCEL_REASON))
    outcomes = c.select("booking_id", "requested_at", "reject_reason",
                        F.when(F.col("reject_reason").isNull(), F.col("refund_amount")).alias("refund_amount"))
    new_bookings = ok.select(
        "booking_id", F.lit("Cancelled").alias("booking_status"),
        F.when(F.col("payment_status") == "Paid", F.lit("Refunded")).otherwise(F.col("payment_status")).alias("payment_status"),
        reason_text.alias("cancel_reason"), F.col("requested_at").alias("cancel_timestamp"))
    ledger = ok.select("booking_id", "cancel_policy_id", "cancel_policy_rule_id", "refund_percentage",
                       "cancellation_fee", "refund_amount", reason_text.alias("reason"),
                       F.col("hours").alias("hours_before_departure"))
    pax = passengers.join(ok.select("booking_id"), "booking_id", "left_semi")
    new_pax = pax.withColumn("passenger_status", F.lit("Cancelled"))
    freed = pax.filter(F.col("seat_id").isNotNull()).select("seat_id").distinct().withColumn("is_available", F.lit(True))
    return {"outcomes": outcomes, "bookings": new_bookings, "passengers": new_pax,
            "freed_seats": freed, "ledger": ledger}


def refund_fee_quote(targets: DataFrame, bookings: DataFrame, trips: DataFrame, rules: DataFrame) -> DataFrame:
    """``calculate_refund_fee`` has no body in the reference;
    *assumption*: fee = price - C1's refund at the target's
    ``requested_at``; ``net_refund = price - fee``."""
    q = cancellation_quote(targets, bookings, trips, rules)
    price = bookings.select("booking_id", F.col("total_price").alias("price"))
    j = q.join(price, "booking_id", "left")
    fee = F.when(F.col("refund_amount").isNotNull(), (F.col("price") - F.col("refund_amount")).cast(MONEY))
    return j.select("booking_id", "requested_at", "reject_reason", F.col("price").alias("total_price"),
                    fee.alias("refund_fee"), (F.col("price") - fee).cast(MONEY).alias("net_refund"))


# ---------------------------------------------------------------------------
# Payment and status commands
# ---------------------------------------------------------------------------
def apply_payment_updates(bookings: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B2: (booking_id, payment_status, payment_method, transaction_id, ts).
    Rejects: missing id/status, status not Unpaid/Paid/Refunded, non-empty
    method not in the four methods, unknown booking.  No transition guard:
    the status is set; method and transaction are patched by M1; the payment
    time is set (to the command's ``ts``) only when Paid.  Several commands
    on one booking apply in arrival order, so the final row is "last
    non-empty value wins" per field - ``max_by`` aggregates that combine
    map-side.  Returns ``(outcomes, new_bookings)`` (changed rows only)."""
    u = updates.select(arrival(updates), "booking_id", "ts",
                       F.trim(F.coalesce("payment_status", F.lit(""))).alias("status"),
                       F.trim(F.coalesce("payment_method", F.lit(""))).alias("method"),
                       F.trim(F.coalesce("transaction_id", F.lit(""))).alias("txn"))
    j = u.join(bookings.select("booking_id", F.lit(True).alias("_found")), "booking_id", "left")
    reason = reasons(((F.col("booking_id") <= 0) | (F.col("status") == ""), "booking_id_and_status_required"),
                     (~F.col("status").isin(*PAYMENT_STATUSES), "invalid_payment_status"),
                     ((F.col("method") != "") & ~F.col("method").isin(*PAYMENT_METHODS), "invalid_payment_method"),
                     (F.col("_found").isNull(), "booking_not_found"))
    j = j.withColumn("reject_reason", reason)
    outcomes = j.select("booking_id", "ts", "status", "method", "txn", "reject_reason")
    ok = j.filter(F.col("reject_reason").isNull())
    last = ok.groupBy("booking_id").agg(
        F.max_by("status", "_arrival").alias("_status"),
        F.max_by(F.when(F.col("method") != "", F.col("method")),
                 F.when(F.col("method") != "", F.col("_arrival"))).alias("_method"),
        F.max_by(F.when(F.col("txn") != "", F.col("txn")),
                 F.when(F.col("txn") != "", F.col("_arrival"))).alias("_txn"),
        F.max_by(F.when(F.col("status") == "Paid", F.col("ts")),
                 F.when(F.col("status") == "Paid", F.col("_arrival"))).alias("_paid_at"))
    new = (bookings.join(last, "booking_id")
           .select("booking_id", F.col("_status").alias("payment_status"),
                   F.coalesce("_method", "payment_method").alias("payment_method"),
                   F.coalesce("_paid_at", "payment_timestamp").alias("payment_timestamp"),
                   F.coalesce("_txn", "gateway_transaction_id").alias("gateway_transaction_id")))
    return outcomes, new


def confirm_bookings(bookings: DataFrame, users: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(booking_id, employee_id, payment_status, notes, ts).  Rejects:
    invalid id; a non-empty forced payment status outside the three; booking
    (joined to its user) not found; status not Pending - including a second
    confirm of one booking in the batch (the earliest wins).  Accepted:
    status Confirmed, payment status forced when given (the payment time is
    *not* set), and an audit row CONFIRM_BOOKING old -> Confirmed with notes
    falling back (PHP ``?:``) to ``"Payment Status: <new>"`` and the
    command's ``ip_address`` (null if commands have none).
    Returns ``(outcomes, audit)``."""
    c = commands.select(arrival(commands), "booking_id", "employee_id",
                        F.trim(F.coalesce("payment_status", F.lit(""))).alias("force"),
                        F.trim(F.coalesce("notes", F.lit(""))).alias("notes"),
                        (F.col("ip_address") if "ip_address" in commands.columns else F.lit(None).cast("string")).alias("ip_address"))
    b = (bookings.select("booking_id", "user_id", "booking_status", "payment_status")
         .join(users.select("user_id"), "user_id").withColumn("_found", F.lit(True)))
    invalid = reasons((F.col("booking_id") <= 0, "invalid_booking_id"),
                      ((F.col("force") != "") & ~F.col("force").isin(*PAYMENT_STATUSES), "invalid_payment_status"))
    c = c.withColumn("_invalid", invalid)
    c = first_per_key(c, "booking_id", [F.col("_invalid").isNotNull(), F.col("_arrival")])
    j = c.join(b, "booking_id", "left")
    reason = F.coalesce(F.col("_invalid"), reasons(
        (F.col("_found").isNull(), "booking_not_found"),
        ((F.col("booking_status") != "Pending") | F.col("booking_status").isNull() | ~F.col("is_first"), "not_pending")))
    j = j.withColumn("reject_reason", reason)
    new_pay = F.when(F.col("force") != "", F.col("force")).otherwise(F.col("payment_status"))
    ok = F.col("reject_reason").isNull()
    outcomes = j.select("booking_id", "employee_id", "reject_reason",
                        F.when(ok, F.lit("Confirmed")).alias("booking_status"),
                        F.when(ok, new_pay).alias("payment_status"))
    audit = j.filter(ok).select(
        "booking_id", "employee_id", F.lit("CONFIRM_BOOKING").alias("action_type"),
        F.col("booking_status").alias("old_status"), F.lit("Confirmed").alias("new_status"),
        falsy_default("notes", F.concat(F.lit(CONFIRM_NOTE), F.coalesce(new_pay, F.lit("")))).alias("notes"), "ip_address")
    return outcomes, audit


def submit_payment_proof(bookings: DataFrame, proofs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(booking_id, actor_user_id, actor_user_type, transaction_id,
    payment_method, note, ts).  Rejects: missing id or transaction (PHP
    ``empty``), unknown booking, actor neither owner nor Employee/Admin,
    booking already Paid, non-empty method outside the enum.  Accepted:
    transaction set, method when non-empty, note ``?:`` "Submitted by
    customer"; payment status unchanged.  Later proofs of a booking overwrite
    earlier ones (last by arrival, per field).  Returns
    ``(outcomes, new_bookings)``."""
    p = proofs.select(arrival(proofs), "booking_id", "actor_user_id", "actor_user_type",
                      F.trim(F.coalesce("transaction_id", F.lit(""))).alias("txn"),
                      F.trim(F.coalesce("payment_method", F.lit(""))).alias("method"),
                      F.trim(F.coalesce("note", F.lit(""))).alias("note"))
    b = bookings.select("booking_id", F.col("user_id").alias("owner_id"), "payment_status", F.lit(True).alias("_found"))
    j = p.join(b, "booking_id", "left")
    reason = reasons(
        ((F.col("booking_id") <= 0) | (F.col("txn") == "") | (F.col("txn") == "0"), "booking_id_and_transaction_required"),
        (F.col("_found").isNull(), "booking_not_found"),
        (~F.coalesce(F.col("owner_id") == F.col("actor_user_id"), F.lit(False))
         & ~F.coalesce(F.col("actor_user_type").isin("Employee", "Admin"), F.lit(False)), "access_denied"),
        (F.col("payment_status") == "Paid", "already_paid"),
        ((F.col("method") != "") & ~F.col("method").isin(*PAYMENT_METHODS), "invalid_payment_method"))
    j = j.withColumn("reject_reason", reason)
    outcomes = j.select("booking_id", "actor_user_id", "txn", "reject_reason")
    ok = j.filter(F.col("reject_reason").isNull())
    last = ok.groupBy("booking_id").agg(
        F.max_by("txn", "_arrival").alias("_txn"),
        F.max_by(F.when(F.col("method") != "", F.col("method")),
                 F.when(F.col("method") != "", F.col("_arrival"))).alias("_method"),
        F.max_by(falsy_default("note", PROOF_NOTE), "_arrival").alias("_note"))
    new = (bookings.join(last, "booking_id")
           .select("booking_id", "payment_status", F.col("_txn").alias("gateway_transaction_id"),
                   F.coalesce("_method", "payment_method").alias("payment_method"), F.col("_note").alias("notes")))
    return outcomes, new

"""Keyed updates applied to stored tables (section 2.9 with its UPDATE).

Each function runs one operator on the rows that its commands name, read from
their buckets, and writes the changed rows back as batch ``batch_id``
(``sources.upsert.KeyedTable``).  A batch that was applied is left alone, so a
retry changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from ..sources.upsert import KeyedTable
from . import accounts, bookings, money

CANCEL_COLUMNS = {"cancel_reason": "string", "cancel_timestamp": "timestamp_ntz"}
REFUND_COLUMNS = {"refund_method": "string", "bank_name": "string", "bank_account": "string", "account_holder_name": "string",
                  "kareemi_number": "string", "processed_by": "bigint", "processing_started_at": "timestamp_ntz", "internal_notes": "string",
                  "customer_notes": "string", "refund_reference": "string", "completed_by": "bigint", "completed_at": "timestamp_ntz"}
COMMISSION_COLUMNS = {"payment_date": "timestamp_ntz"}


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with empty columns for what an update fills in, as far as it has none."""
    return df.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in columns.items() if c not in df.columns])


def store_payment_updates(table: KeyedTable, updates: DataFrame, batch_id: int | str) -> list[int]:
    """B2 on the bookings table."""
    if table.was_applied(batch_id):
        return []
    return table.upsert(bookings.apply_payment_updates(table.read(updates), updates)[1], batch_id)


def store_confirmations(table: KeyedTable, users: DataFrame, commands: DataFrame, batch_id: int | str) -> list[int]:
    """B3 on the bookings table."""
    if table.was_applied(batch_id):
        return []
    outcomes = bookings.confirm_bookings(table.read(commands), users, commands)[0]
    return table.upsert(outcomes.where(F.col("reject_reason").isNull()).select("booking_id", "booking_status", "payment_status"), batch_id)


def store_cancellations(table: KeyedTable, requests: DataFrame, trips: DataFrame, rules: DataFrame, passengers: KeyedTable,
                        seats: KeyedTable, batch_id: int | str) -> list[int]:
    """C2 on the bookings, passengers (in buckets of the booking) and seats
    tables; the bookings last, for they decide what a retry cancels."""
    if table.was_applied(batch_id):
        return []
    requests = cut_lineage(requests)                      # read for the buckets of two tables, their rows and the verdicts
    out = bookings.apply_cancellations(requests, table.read(requests), trips, rules, passengers.read(requests), keep=True)
    seats.upsert(out["freed_seats"], batch_id)
    passengers.upsert(out["passengers"].select(*passengers.key, *[c for c in passengers.by if c not in passengers.key], "passenger_status"), batch_id)
    return table.upsert(out["bookings"], batch_id)


def store_processed_refunds(table: KeyedTable, commands: DataFrame, as_of, batch_id: int | str) -> list[int]:
    """R1 on the refunds table."""
    return _store_refunds(table, money.process_refunds, commands, as_of, batch_id)


def store_completed_refunds(table: KeyedTable, commands: DataFrame, as_of, batch_id: int | str) -> list[int]:
    """R2 on the refunds table."""
    return _store_refunds(table, money.complete_refunds, commands, as_of, batch_id)


def _store_refunds(table: KeyedTable, operator, commands: DataFrame, as_of, batch_id: int | str) -> list[int]:
    if table.was_applied(batch_id):
        return []
    out = operator(table.read(commands), commands, as_of)
    return table.upsert(out.where(F.col("reject_reason").isNull()).drop("reject_reason"), batch_id)


def store_paid_commissions(table: KeyedTable, commands: DataFrame, as_of, batch_id: int | str) -> list[int]:
    """K1 on the commissions table."""
    if table.was_applied(batch_id):
        return []
    named = commands.select(F.explode("commission_ids").alias("commission_id"))
    return table.upsert(money.mark_commissions_paid(table.read(named), commands, as_of)[1].drop("command_id"), batch_id)


def store_recalculated_commissions(table: KeyedTable, adjustments: DataFrame, batch_id: int | str) -> list[int]:
    """K2 on the commissions table (in buckets of the booking)."""
    if table.was_applied(batch_id):
        return []
    current = table.read(adjustments)
    changed = money.recalculate_commissions(current, adjustments)[1]
    return table.upsert(changed.join(current.select(*table.key), "commission_id"), batch_id)


def store_phone_updates(table: KeyedTable, updates: DataFrame, batch_id: int | str) -> list[int]:
    """A4 on the users table."""
    if table.was_applied(batch_id):
        return []
    changed = accounts.apply_phone_updates(table.read(updates), updates)[1]
    return table.upsert(changed.select("user_id", "phone_number"), batch_id)

"""N2 notification outbox and M5 payload merge.

The reference sends each notification inline (database row, WhatsApp
message, push).  Here a table of status changes becomes an outbox table
with one row per channel; delivery is outside the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import UNKNOWN_CUSTOMER, normalize_phone
from .listings import latest_device_token

# Fixed notification texts of the reference, per status: (title, body with
# %1$s = user name, %2$s = booking id, %3$s = total price).
TEMPLATES = {
    "Unpaid": ("تم إنشاء الحجز بنجاح",
               "مرحبا %1$s، تم حجز رحلتك رقم %2$s. يرجى الدفع لإتمام التأكيد. المبلغ: %3$s"),
    "Paid": ("تم الدفع بنجاح",
             "مرحبا %1$s، تم استلام دفعة الحجز رقم %2$s بنجاح. نتمنى لك رحلة سعيدة!"),
    "Refunded": ("تم استرداد المبلغ",
                 "مرحبا %1$s، تم استرداد مبلغ الحجز رقم %2$s."),
    "Confirmed": ("تم تأكيد الحجز",
                  "مرحبا %1$s، تم تأكيد حجزك رقم %2$s بنجاح! نتمنى لك رحلة سعيدة."),
}


def _by_status(i: int) -> Column:
    out = None
    for status, texts in TEMPLATES.items():
        text = texts[i]
        val = F.lit(text) if i == 0 else F.format_string(
            text, F.coalesce(F.col("full_name"), F.lit("")), F.col("booking_id").cast("string"),
            F.coalesce(F.col("total_price").cast("string"), F.lit("")))
        out = F.when(F.col("status") == status, val) if out is None else out.when(F.col("status") == status, val)
    return out


def notification_outbox(changes: DataFrame, tokens: DataFrame) -> DataFrame:
    """``changes`` (booking_id, user_id, status, total_price,
    phone_number, full_name).  Statuses without a template (anything but
    Unpaid, Paid, Refunded, Confirmed) send nothing.  Channels: ``db``
    always; ``whatsapp`` when the phone is non-empty (recipient normalised by
    Q5); ``push`` when the user's newest device token (W2) is non-empty.
    One row per channel."""
    c = changes.filter(F.col("status").isin(*TEMPLATES)).select(
        "booking_id", "user_id", "status", "phone_number", _by_status(0).alias("title"), _by_status(1).alias("body"))
    tok = latest_device_token(tokens).select("user_id", F.col("fcm_token").alias("_token"))
    c = c.join(tok, "user_id", "left")
    phone_ok = F.col("phone_number").isNotNull() & ~F.col("phone_number").isin("", "0")
    channels = F.array(
        F.struct(F.lit("db").alias("channel"), F.lit(None).cast("string").alias("recipient")),
        F.when(phone_ok, F.struct(F.lit("whatsapp").alias("channel"), normalize_phone("phone_number").alias("recipient"))),
        F.when(F.col("_token").isNotNull(), F.struct(F.lit("push").alias("channel"), F.col("_token").alias("recipient"))))
    return (c.select("booking_id", "user_id", "status", "title", "body",
                     F.explode(F.filter(channels, lambda x: x.isNotNull())).alias("ch"))
            .select("booking_id", "user_id", "status", F.col("ch.channel").alias("channel"),
                    F.col("ch.recipient").alias("recipient"), "title", "body"))


def booking_created_changes(new_bookings: DataFrame, users: DataFrame) -> DataFrame:
    """The ``Unpaid`` change of each booking B1 created, for the outbox (the
    reference's post-creation notification never ran - fixed here).  An
    unknown user is not an error there: the name falls back to
    ``Customer`` and the phone to ''."""
    return (new_bookings.select("booking_id", "user_id", "total_price")
            .join(users.select("user_id", "full_name", "phone_number"), "user_id", "left")
            .select("booking_id", "user_id", F.lit("Unpaid").alias("status"), "total_price",
                    F.coalesce("phone_number", F.lit("")).alias("phone_number"),
                    F.coalesce("full_name", F.lit(UNKNOWN_CUSTOMER)).alias("full_name")))


def merge_payload(system: Column, caller: Column) -> Column:
    """M5: PHP ``array_merge($system, $caller)`` on string maps - caller keys
    win.  Written with ``map_filter`` so it does not depend on the session's
    ``spark.sql.mapKeyDedupPolicy``."""
    caller = F.coalesce(caller, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(system, lambda k, v: ~F.array_contains(F.map_keys(caller), k))
    return F.map_concat(kept, caller)

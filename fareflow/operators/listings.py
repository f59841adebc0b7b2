"""Read-side listings.

Per-key "top 1" picks are written as aggregates (``min``/``max`` of a
struct), which combine map-side, rather than as ``row_number`` windows that
would pull a hot key's whole group into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hints import large
from ..plans.lineage import cut_lineage


def booking_history(users: DataFrame, bookings: DataFrame, trips: DataFrame, routes: DataFrame,
                    buses: DataFrame, bus_classes: DataFrame, partners: DataFrame,
                    sort: bool = True) -> DataFrame:
    """Every user's bookings with trip, route, class and company (the
    reference's 12 columns) plus ``booking_count`` per user, newest booking
    first within a user.  Not lazy: trips meet their four dimensions once, when
    this is called, and are kept as a table that both the count and the listing read; the
    count runs over the two key columns of the bookings of such trips, before
    any display column is attached, and is joined on ``user_id`` (AQE splits a
    hot user), not a window."""
    known = cut_lineage(
        trips.select("trip_id", "route_id", "bus_id", "partner_id", "departure_time", "arrival_time", "base_price")
        .join(routes.select("route_id", "origin_city", "destination_city"), "route_id")
        .join(buses.select("bus_id", "bus_class_id"), "bus_id")
        .join(bus_classes.select("bus_class_id", F.col("class_name").alias("bus_class")), "bus_class_id")
        .join(partners.select("partner_id", "company_name"), "partner_id"))
    counts = (bookings.select("user_id", "trip_id").join(known.select("trip_id"), "trip_id", "left_semi")
              .groupBy("user_id").agg(F.count(F.lit(1)).alias("booking_count")))
    rows = (users.select("user_id", "full_name").join(counts, "user_id")
            .join(bookings.select("booking_id", "user_id", "trip_id", "booking_status"), "user_id")
            .join(known, "trip_id"))
    out = rows.select(
        "user_id", "full_name", "booking_id", "booking_status", "trip_id", "departure_time",
        "arrival_time", "origin_city", "destination_city", "bus_class", "company_name", "base_price",
        "booking_count")
    return out.orderBy("user_id", F.desc("booking_id")) if sort else out


def booking_contacts(bookings: DataFrame, users: DataFrame) -> DataFrame:
    """Booking -> user id, phone, name and price (inner join)."""
    return (bookings.select("booking_id", "user_id", "total_price")
            .join(users.select("user_id", "phone_number", "full_name"), "user_id")
            .select("booking_id", "user_id", "phone_number", "full_name", "total_price"))


def default_cancel_policy(trips: DataFrame, policies: DataFrame) -> DataFrame:
    """Per trip, its partner's policy with ``is_default AND is_active``.
    The reference's ``LIMIT 1`` has no order; the lowest policy id is our
    fixed tie-break.  A trip without one gets ``no_default_policy``."""
    pick = (policies.filter(F.col("is_default") & F.col("is_active"))
            .groupBy("partner_id").agg(F.min("cancel_policy_id").alias("cancel_policy_id")))
    return (trips.select("trip_id", "partner_id")
            .join(large(pick), "partner_id", "left")
            .select("trip_id", "partner_id", "cancel_policy_id",
                    F.when(F.col("cancel_policy_id").isNull(), "no_default_policy").alias("reject_reason")))


def latest_device_token(tokens: DataFrame) -> DataFrame:
    """The newest token per user; an empty newest token (PHP ``empty``:
    '' or '0') means the user has none - the check runs after the pick, as
    in the reference.  Ties on ``created_at`` take the greatest token."""
    newest = (tokens.groupBy("user_id")
              .agg(F.max(F.struct("created_at", "fcm_token", "device_type")).alias("t")))
    return (newest.select("user_id", F.col("t.fcm_token").alias("fcm_token"),
                          F.col("t.device_type").alias("device_type"),
                          F.col("t.created_at").alias("created_at"))
            .filter(~F.col("fcm_token").isNull() & ~F.col("fcm_token").isin("", "0")))


def faq_list(faqs: DataFrame, sort: bool = True) -> DataFrame:
    """Active FAQs as ``id, category, question, answer`` by category, id."""
    out = faqs.filter(F.col("is_active")).select(F.col("faq_id").alias("id"), "category", "question", "answer")
    return out.orderBy("category", "id") if sort else out


def faq_category_counts(faqs: DataFrame, sort: bool = True) -> DataFrame:
    """Number of active FAQs per category."""
    out = faqs.filter(F.col("is_active")).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy("category") if sort else out

"""Commission and refund reporting and updates.

The reference's SQL views and functions have no body in its tree; each
assumption is stated once, in the function that makes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import REFUND_METHODS, coalesce_nullif, lenient_float
from .keyed import arrival, first_per_key, reasons, ts_param

MONEY = "decimal(18,2)"

# Fixed customer-facing notes of the refund workflow (reference values).
REFUND_PROCESSING_NOTE = "جاري معالجة طلب الاسترداد. سيتم التحويل خلال 3-5 أيام عمل."
REFUND_COMPLETED_NOTE = "تم إرجاع المبلغ بنجاح."
REFUND_REFERENCE_LABEL = " رقم المعاملة: "


# ---------------------------------------------------------------------------
# F1 and the views
# ---------------------------------------------------------------------------
def filter_listing(df: DataFrame, status: str | None = None, ts_from=None, ts_to=None,
                   status_col: str = "status", ts_col: str = "created_at", sort: bool = True) -> DataFrame:
    """optional conjuncts, each added only when given and non-empty:
    ``status_col = status``, ``ts_col >= from``, ``ts_col <= to``.  Bounds are
    compared as timestamps, so ``to='2025-12-31'`` stops at that midnight.
    Newest first.  Parquet receives the bounds as pushed filters."""
    out = df
    if status is not None and str(status).strip() != "":
        out = out.filter(F.col(status_col) == str(status).strip())
    if ts_from is not None and str(ts_from).strip() != "":
        out = out.filter(F.col(ts_col) >= ts_param(str(ts_from).strip()))
    if ts_to is not None and str(ts_to).strip() != "":
        out = out.filter(F.col(ts_col) <= ts_param(str(ts_to).strip()))
    return out.orderBy(F.desc(ts_col)) if sort else out


def with_count(listing: DataFrame, name: str = "count", counted: DataFrame | None = None) -> DataFrame:
    """The listing's row count beside its rows (the reference answers
    ``count($rows)`` with the list).  The count is an uncorrelated scalar
    subquery - one global aggregate - not a window over one partition.
    ``counted`` is a cheaper table with as many rows (the join of the keys
    alone, without display columns and sort)."""
    return listing.withColumn(name, (listing if counted is None else counted).agg(F.count(F.lit(1))).scalar())


def refund_commission_keys(commissions: DataFrame, refunds: DataFrame) -> DataFrame:
    """One narrow row per row of K3: the join on the booking alone."""
    return refunds.select("booking_id").join(commissions.select("booking_id"), "booking_id")


def refund_detail_keys(refunds: DataFrame, bookings: DataFrame, users: DataFrame) -> DataFrame:
    """Narrow rows of the view behind R4: its keys and the columns it is filtered by."""
    return (refunds.select("booking_id", "refund_status", "created_at")
            .join(bookings.select("booking_id", "user_id"), "booking_id")
            .join(users.select("user_id"), "user_id", "left_semi"))


def commission_summary(commissions: DataFrame, bookings: DataFrame, partners: DataFrame) -> DataFrame:
    """View ``v_commission_summary`` (*assumption*: its body is absent) =
    commissions joined to their booking and partner."""
    return (commissions.select("commission_id", "booking_id", "partner_id", "booking_amount",
                               "commission_amount", "partner_revenue", "status", "created_at")
            .join(bookings.select("booking_id", "user_id", "booking_status"), "booking_id")
            .join(partners.select("partner_id", "company_name"), "partner_id"))


def partner_listing(requests: DataFrame, summary: DataFrame) -> DataFrame:
    """M2 as the partner asks it: per request (request_id, partner_id[,
    status, ts_from, ts_to]) the partner's rows of the summary, each filter
    only where the request gives one, beside the request's ``count``,
    ``total_commission`` and ``total_partner_revenue`` (0 rows: no row)."""
    q = requests.select("request_id", "partner_id", F.trim("status").alias("_status"), "ts_from", "ts_to")
    hit = (q.join(summary, "partner_id")
           .filter((F.coalesce("_status", F.lit("")) == "") | (F.col("status") == F.col("_status")))
           .filter(F.col("ts_from").isNull() | (F.col("created_at") >= F.col("ts_from")))
           .filter(F.col("ts_to").isNull() | (F.col("created_at") <= F.col("ts_to"))))
    totals = hit.groupBy("request_id").agg(F.count(F.lit(1)).alias("count"), F.sum("commission_amount").cast(MONEY).alias("total_commission"),
                                           F.sum("partner_revenue").cast(MONEY).alias("total_partner_revenue"))
    return (hit.select("request_id", "partner_id", "commission_id", "booking_id", "commission_amount", "partner_revenue", "status", "created_at")
            .join(totals, "request_id"))


def refund_details(refunds: DataFrame, bookings: DataFrame, users: DataFrame) -> DataFrame:
    """View ``v_refund_details`` (*assumption*) = refund transactions joined
    to their booking and the booking's user."""
    return (refunds.select("refund_id", "booking_id", "refund_status", "created_at")
            .join(bookings.select("booking_id", "user_id", "total_price", "payment_status"), "booking_id")
            .join(users.select("user_id", "full_name", "email", "phone_number"), "user_id"))


def refund_commission_report(commissions: DataFrame, refunds: DataFrame, sort: bool = True) -> DataFrame:
    """K3: view ``v_refund_commissions`` (*assumption* = commissions joined to
    refund transactions on booking), newest refund first."""
    out = (refunds.select("refund_id", "booking_id", "refund_status", "created_at")
           .join(commissions.select("commission_id", "booking_id", "partner_id", "commission_amount",
                                    "partner_revenue", F.col("status").alias("commission_status")), "booking_id"))
    return out.orderBy(F.desc("created_at")) if sort else out


# ---------------------------------------------------------------------------
# Aggregates
# ---------------------------------------------------------------------------
def _month_aggs():
    pending = F.col("status") == "Pending"
    paid = F.col("status") == "Paid"
    return [
        F.count(F.lit(1)).alias("total_bookings"),
        F.sum("booking_amount").cast(MONEY).alias("total_revenue"),
        F.sum("commission_amount").cast(MONEY).alias("total_commission"),
        F.sum("partner_revenue").cast(MONEY).alias("total_partner_revenue"),
        F.count_if(pending).alias("pending_count"),
        F.count_if(paid).alias("paid_count"),
        F.sum(F.when(pending, F.col("commission_amount")).otherwise(0)).cast(MONEY).alias("pending_amount"),
        F.sum(F.when(paid, F.col("commission_amount")).otherwise(0)).cast(MONEY).alias("paid_amount"),
    ]


def partner_month_stats(commissions: DataFrame) -> DataFrame:
    """Per partner and calendar month of ``created_at``: counts and sums
    by status; ``period`` is ``"year-month"`` unpadded (``2025-3``)."""
    c = commissions.withColumn("year", F.year("created_at")).withColumn("month", F.month("created_at"))
    return (c.groupBy("partner_id", "year", "month").agg(*_month_aggs())
            .withColumn("period", F.concat_ws("-", F.col("year").cast("string"), F.col("month").cast("string"))))


def partner_stats_for(requests: DataFrame, commissions: DataFrame) -> DataFrame:
    """G2 in the reference's ungrouped form: one row per requested
    (partner_id, year, month) even when nothing matches - counts 0, sums
    NULL, as an aggregate without GROUP BY answers."""
    stats = partner_month_stats(commissions).drop("period")
    out = requests.select("partner_id", "year", "month").join(stats, ["partner_id", "year", "month"], "left")
    for c in ("total_bookings", "pending_count", "paid_count"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0).cast("bigint")))
    return out.withColumn("period", F.concat_ws("-", F.col("year").cast("string"), F.col("month").cast("string")))


def partner_commission_totals(summary: DataFrame, partners: DataFrame, status=None, ts_from=None,
                              ts_to=None) -> DataFrame:
    """Per partner, over the F1-filtered listing: row count, total
    commission, total partner revenue.  The reference sums in PHP, so a
    partner with no rows answers 0, not NULL."""
    rows = filter_listing(summary, status, ts_from, ts_to, sort=False)
    agg = rows.groupBy("partner_id").agg(F.count(F.lit(1)).alias("count"),
                                         F.sum("commission_amount").alias("total_commission"),
                                         F.sum("partner_revenue").alias("total_partner_revenue"))
    return (partners.select("partner_id").join(agg, "partner_id", "left")
            .select("partner_id", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
                    F.coalesce("total_commission", F.lit(0)).cast(MONEY).alias("total_commission"),
                    F.coalesce("total_partner_revenue", F.lit(0)).cast(MONEY).alias("total_partner_revenue")))


def daily_commissions(commissions: DataFrame) -> DataFrame:
    """Table ``daily_commissions`` (*assumption*: how it is filled is absent)
    = per calendar day of ``created_at``: bookings, revenue, commission."""
    return (commissions.groupBy(F.to_date("created_at").alias("commission_date"))
            .agg(F.count(F.lit(1)).alias("total_bookings"),
                 F.sum("booking_amount").cast(MONEY).alias("total_revenue"),
                 F.sum("commission_amount").cast(MONEY).alias("total_commission")))


def date_spine(commissions: DataFrame) -> DataFrame:
    """Every day from the first to the last commission day (one row per day;
    the range is a one-row global aggregate, then exploded)."""
    rng = commissions.agg(F.min(F.to_date("created_at")).alias("lo"), F.max(F.to_date("created_at")).alias("hi"))
    return rng.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("commission_date"))


def daily_commission_summary(commissions: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Per requested date the day's totals; a day without commissions
    answers zeros.  ``dates`` (column ``commission_date``) defaults to the
    spine of every day in the commissions' range."""
    days = dates if dates is not None else date_spine(commissions)
    return (days.select("commission_date").join(daily_commissions(commissions), "commission_date", "left")
            .select("commission_date",
                    F.coalesce("total_bookings", F.lit(0).cast("bigint")).alias("total_bookings"),
                    F.coalesce("total_revenue", F.lit(0).cast(MONEY)).alias("total_revenue"),
                    F.coalesce("total_commission", F.lit(0).cast(MONEY)).alias("total_commission")))


# ---------------------------------------------------------------------------
# Lookups by booking
# ---------------------------------------------------------------------------
def _by_booking(bookings: DataFrame, view: DataFrame, order_col: str, cols: list[str]) -> DataFrame:
    pick = view.groupBy("booking_id").agg(F.min(F.struct(order_col, *cols)).alias("r"))
    return (bookings.select("booking_id").join(pick, "booking_id", "left")
            .select("booking_id", F.col("r").isNotNull().alias("found"),
                    *[F.col(f"r.{c}").alias(c) for c in [order_col, *cols]]))


def commission_by_booking(bookings: DataFrame, summary: DataFrame) -> DataFrame:
    """M6: per booking its commission row (lowest commission id if several;
    the reference fetches one unordered row); ``found`` false = 404."""
    return _by_booking(bookings, summary, "commission_id",
                       ["partner_id", "commission_amount", "partner_revenue", "status"])


def refund_by_booking(bookings: DataFrame, details: DataFrame) -> DataFrame:
    """Per booking its refund row (lowest refund id); ``found`` false = 404."""
    return _by_booking(bookings, details, "refund_id", ["refund_status", "created_at"])


# ---------------------------------------------------------------------------
# Keyed updates
# ---------------------------------------------------------------------------
def mark_commissions_paid(commissions: DataFrame, commands: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """K1: each command (command_id, commission_ids array, notes) sets its
    ``Pending`` commissions to ``Paid`` with ``payment_date = as_of`` and
    notes patched by M1.  Ids repeat-safe (an IN list).  When two commands
    name one commission, the lower command id wins.  Returns
    ``(per_command, updated_rows)``; per command: ``updated_count`` or a
    ``reject_reason`` for an empty id list."""
    cmd = commands.select("command_id", "commission_ids",
                          F.trim(F.coalesce("notes", F.lit(""))).alias("new_notes"))
    empty = F.col("commission_ids").isNull() | (F.size("commission_ids") == 0)
    items = (cmd.filter(~empty)
             .select("command_id", "new_notes", F.explode(F.array_distinct("commission_ids")).alias("commission_id"))
             .filter(F.col("commission_id").isNotNull()))
    hits = (items.join(commissions.select("commission_id", "status", F.col("notes").alias("old_notes")),
                       "commission_id")
            .filter(F.col("status") == "Pending"))
    # the lowest command id per commission wins: one partial-aggregate min
    win = hits.groupBy("commission_id").agg(F.min(F.struct("command_id", "new_notes", "old_notes")).alias("w"))
    updated = win.select("commission_id", F.col("w.command_id").alias("command_id"), F.lit("Paid").alias("status"),
                         ts_param(as_of).alias("payment_date"),
                         coalesce_nullif("w.new_notes", "w.old_notes").alias("notes"))
    counts = updated.groupBy("command_id").agg(F.count(F.lit(1)).alias("n"))
    per_cmd = (cmd.join(counts, "command_id", "left")
               .select("command_id",
                       F.when(empty, F.lit(None).cast("bigint")).otherwise(F.coalesce("n", F.lit(0).cast("bigint")))
                       .alias("updated_count"),
                       F.when(empty, F.lit("commission_ids_required")).alias("reject_reason")))
    return per_cmd, updated


def recalculate_commissions(commissions: DataFrame, adjustments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K2: partial refunds (command_id, booking_id, new_amount).  ``booking_id``
    and ``new_amount`` (PHP casts) must both be > 0.
    The SQL function's body is absent; *assumption*: the commission rate is
    kept - ``commission = round(new * commission / booking_amount, 2)``
    (multiply first, decimal HALF_UP), ``revenue = new - commission`` - so the
    result of an adjustment doesn't depend on those before it, and of several
    of one booking the last by ``command_id`` stays.
    Unknown bookings and zero old amounts are rejected.  Returns
    ``(outcomes, new_commissions)``: every adjustment, the changed rows."""
    amount = F.col("new_amount")
    if dict(adjustments.dtypes)["new_amount"] == "string":
        amount = lenient_float(amount)
    adj = adjustments.select(arrival(adjustments), "command_id", "booking_id", amount.cast("decimal(12,2)").alias("new_amount"))
    cur = commissions.select("commission_id", "booking_id", "booking_amount", "commission_amount")
    j = adj.join(cur, "booking_id", "left")
    rate_num = F.col("new_amount").cast("decimal(12,2)") * F.col("commission_amount")
    new_comm = F.round(F.try_divide(rate_num, F.col("booking_amount")), 2).cast("decimal(12,2)")
    reject = reasons(((F.col("booking_id") <= 0) | (F.col("new_amount") <= 0) | F.col("new_amount").isNull(), "booking_id_and_new_amount_required"),
                     (F.col("commission_id").isNull(), "commission_not_found"),
                     (F.col("booking_amount") == 0, "zero_booking_amount"))
    ok = reject.isNull()
    out = j.select(
        "_arrival", "command_id", "booking_id", "commission_id", reject.alias("reject_reason"),
        F.when(ok, F.col("new_amount")).cast("decimal(12,2)").alias("booking_amount"),
        F.when(ok, new_comm).alias("commission_amount"),
        F.when(ok, (F.col("new_amount") - new_comm).cast("decimal(12,2)")).alias("partner_revenue"))
    last = (out.filter(F.col("reject_reason").isNull()).groupBy("commission_id")
            .agg(F.max_by(F.struct("booking_amount", "commission_amount", "partner_revenue"), "_arrival").alias("n"))
            .select("commission_id", "n.*"))
    return out.drop("_arrival"), last


def process_refunds(refunds: DataFrame, commands: DataFrame, as_of) -> DataFrame:
    """``Pending -> Processing``.  Per command: refund id and method are
    required, the method must be one of the allowed four, then the refund
    must exist and still be Pending (the first valid command per refund
    wins).  Accepted rows carry the new values; bank fields default to ''."""
    def opt(c):
        return F.trim(F.coalesce(F.col(c), F.lit(""))) if c in commands.columns else F.lit("")

    cmd = commands.select(
        arrival(commands), "refund_id", opt("refund_method").alias("refund_method"),
        opt("bank_name").alias("bank_name"), opt("bank_account").alias("bank_account"),
        opt("account_holder_name").alias("account_holder_name"),
        opt("kareemi_number").alias("kareemi_number"), opt("notes").alias("internal_notes"),
        F.col("employee_id").cast("bigint").alias("processed_by"))
    invalid = reasons(((F.col("refund_id") <= 0) | (F.col("refund_method") == ""), "refund_id_and_method_required"),
                      (~F.col("refund_method").isin(*REFUND_METHODS), "invalid_refund_method"))
    cmd = first_per_key(cmd.withColumn("_invalid", invalid), "refund_id",
                        [F.col("_invalid").isNotNull(), F.col("_arrival")])
    j = cmd.join(refunds.select("refund_id", F.col("refund_status").alias("old_status")), "refund_id", "left")
    reject = F.coalesce(F.col("_invalid"), reasons(
        (F.col("old_status").isNull() | (F.col("old_status") != "Pending") | ~F.col("is_first"),
         "not_found_or_already_processed")))
    ok = reject.isNull()
    return j.select(
        "refund_id", "refund_method", reject.alias("reject_reason"),
        F.when(ok, F.lit("Processing")).alias("refund_status"),
        F.when(ok, F.col("bank_name")).alias("bank_name"),
        F.when(ok, F.col("bank_account")).alias("bank_account"),
        F.when(ok, F.col("account_holder_name")).alias("account_holder_name"),
        F.when(ok, F.col("kareemi_number")).alias("kareemi_number"),
        F.when(ok, F.col("processed_by")).alias("processed_by"),
        F.when(ok, ts_param(as_of)).alias("processing_started_at"),
        F.when(ok, F.col("internal_notes")).alias("internal_notes"),
        F.when(ok, F.lit(REFUND_PROCESSING_NOTE)).alias("customer_notes"))


def complete_refunds(refunds: DataFrame, commands: DataFrame, as_of) -> DataFrame:
    """R2: ``Processing -> Completed`` with reference, employee, time and
    internal notes overwritten; the customer note is the fixed text plus
    the transaction reference when one is given."""
    def opt(c):
        return F.trim(F.coalesce(F.col(c), F.lit(""))) if c in commands.columns else F.lit("")

    cmd = commands.select(
        arrival(commands), "refund_id", opt("refund_reference").alias("refund_reference"),
        opt("notes").alias("internal_notes"), F.col("employee_id").cast("bigint").alias("completed_by"))
    invalid = reasons((F.col("refund_id") <= 0, "refund_id_required"))
    cmd = first_per_key(cmd.withColumn("_invalid", invalid), "refund_id",
                        [F.col("_invalid").isNotNull(), F.col("_arrival")])
    j = cmd.join(refunds.select("refund_id", F.col("refund_status").alias("old_status")), "refund_id", "left")
    reject = F.coalesce(F.col("_invalid"), reasons(
        (F.col("old_status").isNull() | (F.col("old_status") != "Processing") | ~F.col("is_first"),
         "not_found_or_not_processing")))
    ok = reject.isNull()
    note = F.concat(F.lit(REFUND_COMPLETED_NOTE),
                    F.when(F.col("refund_reference") != "",
                           F.concat(F.lit(REFUND_REFERENCE_LABEL), F.col("refund_reference"))).otherwise(F.lit("")))
    return j.select(
        "refund_id", reject.alias("reject_reason"),
        F.when(ok, F.lit("Completed")).alias("refund_status"),
        F.when(ok, F.col("refund_reference")).alias("refund_reference"),
        F.when(ok, F.col("completed_by")).alias("completed_by"),
        F.when(ok, ts_param(as_of)).alias("completed_at"),
        F.when(ok, F.col("internal_notes")).alias("internal_notes"),
        F.when(ok, note).alias("customer_notes"))

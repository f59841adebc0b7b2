"""Accounts, contact data and device tokens.

The reference checks one identifier or registration per request against
``email = :x OR phone_number = :x``.  An OR join plans as a nested loop in
Spark, so every such check here is two equi-joins (one per key) combined
with ``unionByName``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import DEVICE_TYPES, php_empty
from .admission import assign_sequence_ids, first_come_admission, max_id
from .keyed import arrival, reasons


def resolve_identifiers(lookups: DataFrame, users: DataFrame) -> DataFrame:
    """Each lookup's ``identifier`` equals a user's email or phone; the
    lowest matching user id is kept (the reference's pick is unordered).
    Empty identifiers are rejected, unknown ones come back unresolved.
    The OR join is a union of the two keys aggregated per value, then one
    equi-join."""
    ids = lookups.select("lookup_id", "identifier")
    # one row per e-mail and per phone value (lowest user id) before joining:
    # a value shared by many users (an empty phone) never fans out or lands
    # whole on one task, and the lowest id per lookup is unchanged
    by_value = (users.select(F.col("email").alias("identifier"), "user_id")
                .unionByName(users.select(F.col("phone_number").alias("identifier"), "user_id"))
                .groupBy("identifier").agg(F.min("user_id").alias("user_id")))
    hit = (ids.filter(~php_empty("identifier")).join(by_value, "identifier")
           .groupBy("lookup_id").agg(F.min("user_id").alias("user_id")))
    return (ids.join(hit, "lookup_id", "left")
            .select("lookup_id", "identifier",
                    F.when(~php_empty("identifier"), F.col("user_id")).alias("user_id"),
                    reasons((php_empty("identifier"), "identifier_required"),
                            (F.col("user_id").isNull(), "user_not_found")).alias("reject_reason")))


def duplicate_accounts(users: DataFrame) -> DataFrame:
    """A2: e-mail and phone values shared by more than one user, as a table
    audit of the registration uniqueness rule.  One row per (key kind,
    value) with the number of users and the lowest and highest user id;
    empty values are not keys.  Counting is a partial aggregate, so one hot
    value costs one row per task."""
    def dup(col, kind):
        return (users.filter(F.col(col).isNotNull() & (F.trim(F.col(col)) != ""))
                .groupBy(F.col(col).alias("key_value"))
                .agg(F.count(F.lit(1)).alias("n_users"), F.min("user_id").alias("first_user_id"),
                     F.max("user_id").alias("last_user_id"))
                .filter(F.col("n_users") > 1)
                .withColumn("key_kind", F.lit(kind)))
    return dup("email", "email").unionByName(dup("phone_number", "phone"))


def admit_accounts(registrations: DataFrame, users: DataFrame) -> DataFrame:
    """A3: registrations (registration_id = arrival order, full_name, email,
    phone_number[, user_type, password]).  Rejects, in order: a missing
    field (PHP ``empty`` after trim; password counts only when the column is
    given) -> ``missing_fields``; e-mail or phone already used by a user or by
    an earlier *accepted* registration -> ``already_in_use``.  Accepted rows
    get ``user_type`` (default Customer), status Unverified and a new
    ``user_id`` = max existing + arrival rank (S6)."""
    cols = registrations.columns
    r = registrations.select(
        "registration_id",
        F.trim(F.coalesce("full_name", F.lit(""))).alias("full_name"),
        F.trim(F.coalesce("email", F.lit(""))).alias("email"),
        F.trim(F.coalesce("phone_number", F.lit(""))).alias("phone_number"),
        (F.coalesce(F.col("user_type"), F.lit("Customer")) if "user_type" in cols else F.lit("Customer")).alias("user_type"),
        (php_empty("password") if "password" in cols else F.lit(False)).alias("_no_password"))
    missing = php_empty("full_name") | php_empty("email") | php_empty("phone_number") | F.col("_no_password")
    r = r.withColumn("_missing", missing)
    complete = r.filter(~F.col("_missing"))
    # distinct key sets: a value shared by many users is one row per task
    used_e = complete.join(users.select("email").distinct(), "email", "left_semi").select("registration_id")
    used_p = complete.join(users.select("phone_number").distinct(), "phone_number", "left_semi").select("registration_id")
    taken = used_e.unionByName(used_p).distinct()
    fresh = complete.join(taken, "registration_id", "left_anti")
    items = fresh.select("registration_id", F.explode(F.array(
        F.concat(F.lit("e:"), F.col("email")), F.concat(F.lit("p:"), F.col("phone_number")))).alias("res"))
    items = items.withColumn("_order", F.col("registration_id"))
    verdict = first_come_admission(items, "registration_id", "_order", "res")
    accepted = r.join(verdict.filter("accepted").select("registration_id"), "registration_id", "left_semi")
    with_ids = assign_sequence_ids(accepted.select("registration_id"), ["registration_id"],
                                   max_id(users, "user_id"), "user_id")
    out = r.join(with_ids, "registration_id", "left")
    reason = reasons((F.col("_missing"), "missing_fields"), (F.col("user_id").isNull(), "already_in_use"))
    ok = reason.isNull()
    return out.select("registration_id", "full_name", "email", "phone_number",
                      F.when(ok, F.col("user_type")).alias("user_type"),
                      F.when(ok, F.lit("Unverified")).alias("account_status"),
                      "user_id", reason.alias("reject_reason"))


def apply_phone_updates(users: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: per update (user_id, phone[, command_id]): invalid id ->
    ``invalid_user_id``, unknown user -> ``user_not_found``, empty phone
    (after trim) -> ``nothing_to_update``; otherwise the phone replaces the
    old one.  Several accepted updates of one user: the last one wins.
    Returns ``(outcomes, new_users)``."""
    u = updates.select(arrival(updates), "user_id", F.trim(F.coalesce("phone_number", F.lit(""))).alias("phone"))
    j = u.join(users.select("user_id", F.lit(True).alias("_known")), "user_id", "left")
    reason = reasons((F.col("user_id") <= 0, "invalid_user_id"), (F.col("_known").isNull(), "user_not_found"),
                     (F.col("phone") == "", "nothing_to_update"))
    outcomes = j.select("user_id", "phone", reason.alias("reject_reason"),
                        F.when(reason.isNull(), F.col("phone")).alias("user_phone"))
    last = (j.filter(reason.isNull()).groupBy("user_id")
            .agg(F.max_by("phone", "_arrival").alias("_new_phone")))
    new_users = (users.join(last, "user_id", "left")
                 .withColumn("phone_number", F.coalesce("_new_phone", "phone_number")).drop("_new_phone"))
    return outcomes, new_users


def upsert_device_tokens(tokens: DataFrame, new: DataFrame) -> DataFrame:
    """Each new (user_id, fcm_token, device_type, created_at) deletes the
    user's token of that device and inserts itself.  The device falls back
    to ``android`` when not one of android/ios/web; an empty token is
    rejected (not applied).  Within the batch the latest ``created_at`` per
    (user, device) wins (ties: greatest token).  Returns the new table."""
    n = (new.select("user_id", F.trim(F.coalesce("fcm_token", F.lit(""))).alias("fcm_token"),
                    F.trim(F.coalesce("device_type", F.lit("android"))).alias("device_type"), "created_at")
         .filter(~F.col("fcm_token").isin("", "0"))           # PHP empty()
         .withColumn("device_type", F.when(F.col("device_type").isin(*DEVICE_TYPES), F.col("device_type"))
                     .otherwise(F.lit("android"))))
    latest = (n.groupBy("user_id", "device_type")
              .agg(F.max(F.struct("created_at", "fcm_token")).alias("t"))
              .select("user_id", "device_type", F.col("t.fcm_token").alias("fcm_token"),
                      F.col("t.created_at").alias("created_at")))
    kept = tokens.join(latest.select("user_id", "device_type"), ["user_id", "device_type"], "left_anti")
    return kept.select("user_id", "fcm_token", "device_type", "created_at").unionByName(latest)


# Defaults the database applies to a new ticket (values absent from the
# reference: *assumption*).
TICKET_DEFAULT_STATUS = "Open"
TICKET_DEFAULT_PRIORITY = "Normal"


def admit_tickets(raw: DataFrame, existing: DataFrame | None = None, as_of=None) -> DataFrame:
    """Support tickets (ticket_key = arrival order, user_id, issue_type,
    title, description).  All four fields are required with PHP truthiness
    (null, '', '0' and 0 fail) -> ``missing_fields``.  Accepted rows get a
    ``ticket_id`` after the largest existing one (S6), status ``Open``,
    priority ``Normal`` and ``created_at`` = ``as_of`` (or the row's
    ``received_at`` when present)."""
    from .keyed import ts_param

    falsy = None
    for c in ("user_id", "issue_type", "title", "description"):
        f = php_empty(c)
        falsy = f if falsy is None else falsy | f
    t = raw.withColumn("_missing", falsy)
    start = max_id(existing, "ticket_id") if existing is not None else F.lit(0).cast("bigint")
    ids = assign_sequence_ids(t.filter(~F.col("_missing")).select("ticket_key"), ["ticket_key"], start, "ticket_id")
    created = (F.col("received_at") if "received_at" in raw.columns
               else (ts_param(as_of) if as_of is not None else F.lit(None).cast("timestamp_ntz")))
    ok = ~F.col("_missing")
    return (t.join(ids, "ticket_key", "left")
            .select("ticket_key", "ticket_id", "user_id", "issue_type", "title", "description",
                    F.when(ok, F.lit(TICKET_DEFAULT_STATUS)).alias("status"),
                    F.when(ok, F.lit(TICKET_DEFAULT_PRIORITY)).alias("priority"),
                    F.when(ok, created).alias("created_at"),
                    F.when(~ok, F.lit("missing_fields")).alias("reject_reason")))

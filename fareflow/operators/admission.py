"""Arrival-order admission and generated keys (S6 and the core of B1, A3).

The reference admits requests one at a time: a request is accepted when
none of its resources (a seat of a trip, an e-mail, a phone number) is held,
and an accepted request then holds them.  Over a batch that is the greedy
fold "in arrival order, accept if no earlier *accepted* request shares a
resource" - the lexicographically first independent set of the conflict
graph.  ``first_come_admission`` computes it exactly:

* Rounds decide almost all requests.  A request that is the earliest undecided
  claimant of every one of its resources is accepted (every earlier neighbour
  is already rejected); one that shares a resource with a request accepted this
  round is rejected.  A round is a partial-aggregate ``min`` per resource, two
  equi-joins and one aggregate per request, so a hot resource (one seat wanted
  by a third of all requests) is combined map-side and never collected.
* What two rounds leave open are chains of requests that each share a
  resource with the next.  Their connected components are labelled (labels are
  propagated and looked up twice an iteration, so a chain of n needs about
  log4 n of them), and every component of at most ``SMALL`` requests is folded in
  arrival order in one row.  Only larger components go on with rounds.

Rounds and iterations are tables in the session's checkpoint folder, which
cuts the lineage and survives executor loss; whether something is open or
changed is the presence of a folder, not a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import PAYMENT_METHODS
from ..plans.hints import large, small_table
from ..plans.lineage import cut_lineage, path_exists, range_partitioned, scratch_folder
from .keyed import reasons
from .listings import default_cancel_policy

#: Requests of the largest component that is folded in one row.
SMALL = 2_000
ROUNDS = 2


def _round(open_: DataFrame, rid: str, order: str, res: str, path: str) -> None:
    """One round: ``open_`` with the state of its requests, written by state."""
    key = F.struct(F.col(order), F.col(rid))
    first = open_.groupBy(res).agg(F.min(key).alias("_first"))
    claims = open_.join(large(first), res).withColumn("_mine", key == F.col("_first"))
    wins = claims.groupBy(rid).agg(F.bool_and("_mine").alias("_wins"))
    lead = wins.select(F.col(rid).alias("_lead"), F.col("_wins").alias("_lead_wins"))
    # a request loses if the first claimant of one of its resources is accepted and is another
    status = (claims.withColumn("_lead", F.col(f"_first.{rid}")).join(large(lead), "_lead")
              .groupBy(rid).agg(F.bool_and("_mine").alias("accepted"), F.bool_or(~F.col("_mine") & F.col("_lead_wins")).alias("_lost")))
    state = F.when(F.col("accepted"), "accepted").when(F.col("_lost"), "rejected").otherwise("open")
    open_.join(large(status.select(rid, state.alias("state"))), rid).write.partitionBy("state").parquet(path)


def components(claims: DataFrame, rid: str, res: str, folder: str) -> DataFrame:
    """(rid, label): requests connected by shared resources have one label,
    the smallest request id of their component.  Iterations end when no label changes."""
    spark = claims.sparkSession
    labels = claims.select(rid, F.col(rid).alias("label")).distinct()
    n = 0
    while True:
        low = claims.join(large(labels), rid).groupBy(res).agg(F.min("label").alias("low"))
        near = claims.join(large(low), res).groupBy(rid).agg(F.min("low").alias("label"))
        for _ in range(2):                                # labels are requests, which have labels of their own
            at = near.select(F.col(rid).alias("label"), F.col("label").alias("_next"))
            near = near.join(large(at), "label").select(rid, F.col("_next").alias("label"))
        path = f"{folder}/labels={n}"
        (near.join(large(labels.withColumnRenamed("label", "_old")), rid).select(rid, "label", (F.col("label") != F.col("_old")).alias("changed"))
         .write.partitionBy("changed").parquet(path))
        schema = T.StructType([*labels.schema.fields, T.StructField("changed", T.BooleanType())])
        labels = spark.read.schema(schema).parquet(path).select(rid, "label")
        n += 1
        if not path_exists(spark, f"{path}/changed=true"):
            return labels


def _fold(open_: DataFrame, rid: str, order: str, res: str) -> DataFrame:
    """(rid, accepted) of components of bounded size (column ``label``): the
    fold in arrival order, one row a component."""
    each = open_.groupBy("label", rid).agg(F.min(order).alias("_order"), F.collect_set(res).alias("_res"))
    rows = each.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("_order", F.col(rid).alias("_rid"), "_res"))).alias("_all"))
    kinds = dict(open_.dtypes)
    start = F.struct(F.array().cast(f"array<{kinds[res]}>").alias("held"), F.array().cast(f"array<{kinds[rid]}>").alias("won"))
    end = F.aggregate("_all", start, lambda s, x: F.when(F.arrays_overlap(s["held"], x["_res"]), s).otherwise(
        F.struct(F.concat(s["held"], x["_res"]).alias("held"), F.concat(s["won"], F.array(x["_rid"])).alias("won"))))
    return (rows.select("_all", end["won"].alias("_won"))
            .select(F.explode(F.transform("_all", lambda x: F.struct(x["_rid"].alias(rid), F.array_contains("_won", x["_rid"]).alias("accepted")))).alias("v"))
            .select(f"v.{rid}", "v.accepted"))


def first_come_admission(items: DataFrame, rid: str, order: str, res: str, small: int = SMALL) -> DataFrame:
    """``items``: one row per (request ``rid``, arrival ``order``, resource
    ``res``); ``order`` must be equal for all rows of a request and, with
    ``rid``, totally ordered.  Returns ``(rid, accepted)`` for every request."""
    spark = items.sparkSession
    folder = scratch_folder(spark, "admission")
    open_ = items.select(rid, order, res).dropDuplicates([rid, res])
    schema = open_.schema
    verdict_schema = T.StructType([schema[rid], T.StructField("accepted", T.BooleanType())])
    n, folded = 0, []
    while True:
        _round(open_, rid, order, res, f"{folder}/rounds/round={n}")
        n += 1
        if not path_exists(spark, f"{folder}/rounds/round={n - 1}/state=open"):
            break
        open_ = spark.read.schema(schema).parquet(f"{folder}/rounds/round={n - 1}/state=open")
        if n % ROUNDS == 0:
            labels = components(open_, rid, res, f"{folder}/labels/after={n}")
            size = labels.groupBy("label").agg((F.count(F.lit(1)) <= small).alias("few"))
            labelled = open_.join(large(labels.join(large(size), "label")), rid)
            path = f"{folder}/folded/after={n}"
            _fold(labelled.where("few"), rid, order, res).write.parquet(path)
            folded.append(path)
            labelled.where("not few").select(rid, order, res, F.lit(True).alias("large")).write.partitionBy("large").parquet(f"{folder}/large/after={n}")
            if not path_exists(spark, f"{folder}/large/after={n}/large=true"):
                break
            open_ = spark.read.schema(schema).parquet(f"{folder}/large/after={n}/large=true")
    out = spark.createDataFrame([], verdict_schema)
    if any(path_exists(spark, f"{folder}/rounds/round={i}/state={x}") for i in range(n) for x in ("accepted", "rejected")):
        every = spark.read.schema(T.StructType([*schema.fields, T.StructField("state", T.StringType()),
                                                 T.StructField("round", T.IntegerType())])).parquet(f"{folder}/rounds")
        out = every.filter(F.col("state") != "open").select(rid, (F.col("state") == "accepted").alias("accepted")).distinct()
    for path in folded:
        out = out.unionByName(spark.read.schema(verdict_schema).parquet(path))
    return out


def assign_sequence_ids(df: DataFrame, order_cols: list[str], start: Column, id_col: str) -> DataFrame:
    """``start + 1, start + 2, ...`` in ``order_cols`` order, like a
    database sequence over arrivals, without a single-partition window:
    range-partition and sort by the order, checkpoint (fixes partition
    contents), take each row's position inside its partition from
    ``monotonically_increasing_id`` and add the row count of all earlier
    partitions (a table of one row per partition, broadcast)."""
    ck = range_partitioned(df, *order_cols)
    x = ck.withColumn("_mid", F.monotonically_increasing_id())
    x = x.withColumn("_pid", F.shiftright("_mid", 33))
    x = x.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    counts = x.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (x.join(small_table(offsets), "_pid")
            .withColumn(id_col, (start + F.col("_off") + F.col("_local") + F.lit(1)).cast("bigint"))
            .drop("_mid", "_pid", "_local", "_off"))


def max_id(df: DataFrame, col: str) -> Column:
    """Largest existing id as a scalar subquery (0 for an empty table)."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)).cast("bigint")).scalar()


# ---------------------------------------------------------------------------
# B1 admit_bookings, B1b expand_passengers, J3 resolve_seat_codes
# ---------------------------------------------------------------------------
def expand_passengers(requests: DataFrame) -> DataFrame:
    """One row per passenger of each parsed request (``passenger_no``
    from 1); optional fields stay null, ``id_number`` defaults to '' and the
    seat code is trimmed (the reference looked codes up trimmed but stored
    them untrimmed - fixed here)."""
    p = requests.select("request_id", F.posexplode("passengers").alias("pos", "p"))
    return p.select("request_id", (F.col("pos") + 1).alias("passenger_no"),
                    F.col("p.full_name").alias("full_name"),
                    F.coalesce(F.col("p.id_number"), F.lit("")).alias("id_number"),
                    F.trim(F.coalesce(F.col("p.seat_code"), F.lit(""))).alias("seat_code"),
                    F.col("p.gender").alias("gender"), F.col("p.birth_date").alias("birth_date"),
                    F.col("p.phone_number").alias("phone_number"), F.col("p.id_image").alias("id_image"))


def seat_lookups(requests: DataFrame, trips: DataFrame, seats: DataFrame) -> DataFrame:
    """Each seat code of each request with the seats it names: (request_id,
    trip_id, seat_code, nth, seat_id), ``nth`` from 0 among the seats of one
    code (0 and a null seat where there is none).  A code meets its trip's bus
    first and the bus's seats of that number then, so nothing is as large as
    trips x seats."""
    codes = expand_passengers(requests).filter(~F.col("seat_code").isin("", "0")).select("request_id", "seat_code")
    codes = codes.join(large(requests.select("request_id", "trip_id")), "request_id").join(large(trips.select("trip_id", "bus_id")), "trip_id", "left")
    named = seats.groupBy("bus_id", F.col("seat_number").alias("seat_code")).agg(F.collect_set("seat_id").alias("_seats"))
    return (codes.join(large(named), ["bus_id", "seat_code"], "left")
            .select("request_id", "trip_id", "seat_code", F.posexplode_outer("_seats").alias("nth", "seat_id"))
            .withColumn("nth", F.coalesce("nth", F.lit(0))))


def _given_and_found(lookups: DataFrame, *more: Column) -> DataFrame:
    """Codes given, seats found (and ``more`` aggregates) per request."""
    return lookups.groupBy("request_id").agg(F.count_if(F.col("nth") == 0).alias("n_codes"),
                                             F.size(F.collect_set("seat_id")).cast("bigint").alias("n_found"), *more)


def _seat_reason() -> Column:
    return F.when(F.col("n_codes") == 0, "no_seat_codes").when(F.col("n_codes") != F.col("n_found"), "unknown_seats")


def resolve_seat_codes(requests: DataFrame, trips: DataFrame, seats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trip, seat code) -> seat id through trips -> buses -> seats.
    Codes are the trimmed seat codes with PHP-falsy ones ('' and '0')
    dropped; they are counted before the join.  A request fails when it has
    no code (``no_seat_codes``) or when the seats found differ in number from
    the codes given (``unknown_seats``), as the reference's ``count($rows) !==
    count($codes)``: a code given twice finds one seat for two codes, a bus
    with two seats of one number finds two for one.  Returns
    ``(codes, per_request)``: codes = (request_id, trip_id, seat_code,
    seat_id); per_request = (request_id, n_codes, n_found, reject_reason)."""
    lookups = seat_lookups(requests, trips, seats)
    zero = F.lit(0).cast("bigint")
    per = (requests.select("request_id").join(large(_given_and_found(lookups)), "request_id", "left")
           .select("request_id", F.coalesce("n_codes", zero).alias("n_codes"), F.coalesce("n_found", zero).alias("n_found"))
           .withColumn("reject_reason", _seat_reason()))
    return lookups.select("request_id", "trip_id", "seat_code", "seat_id"), per


def held_seats(bookings: DataFrame, passengers: DataFrame) -> DataFrame:
    """(trip_id, seat_id) held by any passenger of any booking, cancelled ones included."""
    return (bookings.select("booking_id", "trip_id")
            .join(large(passengers.select("booking_id", "seat_id").filter(F.col("seat_id").isNotNull())), "booking_id")
            .select("trip_id", "seat_id").distinct())        # hot seats collapse map-side


def _checked(requests: DataFrame, trips: DataFrame, policies: DataFrame, lookups: DataFrame, held: DataFrame) -> DataFrame:
    req = requests.select("request_id", "user_id", "trip_id", "payment_method",
                          (F.size("passengers") == 0).alias("_no_pax"),
                          F.col("total_price").isNull().alias("_no_price"))
    pol = default_cancel_policy(trips, policies).select("trip_id", "cancel_policy_id", F.lit(True).alias("_trip"))
    flagged = lookups.join(large(held.select("trip_id", "seat_id", F.lit(True).alias("_held"))), ["trip_id", "seat_id"], "left")
    per = _given_and_found(flagged, F.bool_or(F.coalesce("_held", F.lit(False))).alias("_taken"))
    j = (req.join(large(pol), "trip_id", "left").join(large(per), "request_id", "left")
         .withColumn("n_codes", F.coalesce("n_codes", F.lit(0).cast("bigint"))))
    reason = reasons(
        ((F.col("user_id") <= 0) | (F.col("trip_id") <= 0) | F.col("_no_pax"), "missing_fields"),
        (F.col("_trip").isNull(), "trip_not_found"),
        (F.col("cancel_policy_id").isNull(), "no_default_policy"),
        (_seat_reason() == "no_seat_codes", "no_seat_codes"),
        (_seat_reason() == "unknown_seats", "unknown_seats"),
        (F.col("_taken"), "already_booked"),
        (~F.col("payment_method").isin(*PAYMENT_METHODS), "invalid_payment_method"),
        (F.col("_no_price"), "price_out_of_range"))
    return j.select("request_id", "trip_id", "cancel_policy_id", reason.alias("reject_reason"))


def booking_request_checks(requests: DataFrame, trips: DataFrame, policies: DataFrame, seats: DataFrame,
                           bookings: DataFrame, passengers: DataFrame) -> DataFrame:
    """The reject stages of B1 that do not depend on other requests, in the
    reference's order: ``missing_fields`` (user, trip or passengers),
    ``trip_not_found``, ``no_default_policy``, ``no_seat_codes``,
    ``unknown_seats``, ``already_booked`` (a seat held by an existing
    passenger of the trip, cancelled ones included),
    ``invalid_payment_method``, then ``price_out_of_range`` (a price that the
    database's column can't hold; its insert fails).  Returns one row per request with
    ``cancel_policy_id`` and ``reject_reason`` (null = goes to contention).
    The requests are kept once: their codes are read twice."""
    requests = cut_lineage(requests)
    return _checked(requests, trips, policies, seat_lookups(requests, trips, seats), held_seats(bookings, passengers))


def admit_bookings(requests: DataFrame, trips: DataFrame, policies: DataFrame, seats: DataFrame,
                   bookings: DataFrame | None, passengers: DataFrame | None, held: DataFrame | None = None,
                   last_id: Column | None = None) -> dict[str, DataFrame]:
    """B1: admit parsed booking requests (S2 output plus ``request_id`` and
    ``received_at``) in arrival order (received_at, request_id).

    Stage rejects come first (``booking_request_checks``); the survivors then
    compete for seats: a request is accepted only if none of its seats was
    taken by an earlier accepted request of the same trip (all-or-nothing
    per request, ``first_come_admission`` over (trip, seat)), else
    ``already_booked``.  The price is the client's.  Accepted requests get
    a ``booking_id`` = max existing + arrival rank, status Pending/Unpaid,
    the trip partner's default policy; their passengers are Active; their
    seats are flagged unavailable.  ``held`` (trip_id, seat_id) and ``last_id``
    replace what is otherwise read from all bookings and passengers.
    Returns ``outcomes``, ``bookings``, ``passengers``, ``seat_updates`` and
    ``held`` (the seats that this batch took)."""
    if held is None:
        held = held_seats(bookings, passengers)
    if last_id is None:
        last_id = max_id(bookings, "booking_id")
    requests = cut_lineage(requests)            # parsed once, read by every branch below
    codes = cut_lineage(seat_lookups(requests, trips, seats))
    checks = cut_lineage(_checked(requests, trips, policies, codes, held))
    arrival = requests.select("request_id", F.struct("received_at", "request_id").alias("_order"))
    ok = checks.filter(F.col("reject_reason").isNull()).select("request_id")
    items = (codes.join(large(ok), "request_id", "left_semi").join(large(arrival), "request_id")
             .select("request_id", "_order", F.struct("trip_id", "seat_id").alias("_seat")))
    verdict = first_come_admission(items, "request_id", "_order", "_seat")
    won = verdict.filter("accepted").select("request_id")
    ids = assign_sequence_ids(won.join(large(arrival), "request_id").select("request_id", "_order"), ["_order"],
                              last_id, "booking_id").select("request_id", "booking_id")
    ids = large(ids)
    out = (checks.join(ids, "request_id", "left")
           .withColumn("reject_reason", F.coalesce("reject_reason",
                                                   F.when(F.col("booking_id").isNull(), F.lit("already_booked")))))
    acc = requests.join(ids, "request_id")
    new_bookings = (acc.join(large(checks.select("request_id", "cancel_policy_id")), "request_id")
                    .select("booking_id", "user_id", "trip_id", "total_price",
                            F.lit("Pending").alias("booking_status"), "payment_method",
                            F.lit("Unpaid").alias("payment_status"), F.col("received_at").alias("booking_date"),
                            "cancel_policy_id"))
    seat_of = codes.groupBy("request_id", "seat_code").agg(F.min("seat_id").alias("seat_id"))
    new_pax = (expand_passengers(acc).join(large(acc.select("request_id", "booking_id", "trip_id")), "request_id")
               .join(large(seat_of), ["request_id", "seat_code"], "left")
               .select("booking_id", "passenger_no", "full_name", "id_number", "seat_id", "trip_id", "gender",
                       "birth_date", "phone_number", "id_image", F.lit("Active").alias("passenger_status")))
    taken = codes.join(ids, "request_id", "left_semi")
    return {"outcomes": out.select("request_id", "trip_id", "booking_id", "reject_reason"),
            "bookings": new_bookings, "passengers": new_pax,
            "seat_updates": taken.select("seat_id").distinct().withColumn("is_available", F.lit(False)),
            "held": taken.select("trip_id", "seat_id").distinct()}

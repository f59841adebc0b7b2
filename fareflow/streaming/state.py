"""E4 ``booking_state``: the per-booking fold of status commands, in Spark expressions.

Commands (confirm, pay, gateway, proof, cancel) change a booking under the
guards of section 2.9, so the result depends on their order (``ts``, then
``seq``).  No sequential fold is needed, for the guards read two fields only:

* Booking status: only the first cancel and the first confirm of a booking can
  pass.  Both are ``min`` aggregates.
* Payment status before a command: the value of the last command that set it
  (a payment, or the accepted confirm with a status), then Paid if a gateway
  event came after that, then Refunded if the accepted cancel found it Paid,
  then Paid again if a gateway event followed.  Last settings and last gateway
  events are running maxima.  A NULL status stays NULL until it is set.
* Every other field is the value of the last accepted command that writes it.

Running maxima are taken in two steps, so that a booking with a third of all
commands is no task of its own: commands are cut into ranges of (booking, ts,
seq), each range is scanned by a window of its own, and what came before a range
is a maximum over its booking's earlier ranges (one row per booking and range).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.rules import PAYMENT_METHODS, PAYMENT_STATUSES, PROOF_NOTE, falsy_default
from ..operators.keyed import arrival
from ..plans.hints import large
from ..plans.lineage import cut_lineage
from .keyed import bucket_of, start_to_files, with_state

KIND_ORDER = {"confirm": 0, "pay": 1, "gateway": 2, "proof": 3, "cancel": 4}
STATE_FIELDS = ("booking_status", "payment_status", "payment_method", "gateway_transaction_id",
                "payment_timestamp", "notes")
COMMAND_COLS = ["booking_id", "ts", "seq", "kind", "status", "method", "txn", "note"]
OUT_COLS = ["booking_id", "ts", "seq", "kind", "accepted", "nth", *STATE_FIELDS]


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).isin("", "0")


def _payment_status(initial: Column, last_set: Column, gate: Column, cancel: Column, now: Column | None) -> Column:
    """Payment status after the settings, gateway events and accepted cancel before ``now`` (None: all).

    ``last_set`` is struct(ts, seq, value), ``gate`` and ``cancel`` are struct(ts, seq)."""
    base = F.when(last_set.isNull(), initial).otherwise(last_set["value"])
    set_at = F.when(last_set.isNotNull(), F.struct(last_set["ts"].alias("ts"), last_set["seq"].alias("seq")))
    after_set = lambda at: at.isNotNull() & (set_at.isNull() | (at > set_at))
    gated = after_set(gate)
    cancelled = after_set(cancel) if now is None else after_set(cancel) & (cancel < now)
    return (F.when(base.isNull(), base)
            .when(cancelled & gated & (gate > cancel), F.lit("Paid"))
            .when(cancelled & (gated | (base == "Paid")), F.lit("Refunded"))
            .when(~cancelled & gated, F.lit("Paid"))
            .otherwise(base))


def _judged(commands: DataFrame, bookings: DataFrame) -> DataFrame:
    """Every command with its verdict, its booking's state before the batch
    (``init_*``) and the booking's accepted cancel and confirm."""
    init = bookings.select("booking_id", *[F.col(f).alias("init_" + f) for f in STATE_FIELDS])
    rows = cut_lineage(commands.select(*COMMAND_COLS))    # read for the firsts and for the rows
    at = F.struct("ts", "seq")
    first = rows.filter(F.col("kind").isin("confirm", "cancel")).groupBy("booking_id").agg(
        F.min(F.when(F.col("kind") == "confirm", at)).alias("confirm_at"),
        F.min(F.when(F.col("kind") == "cancel", at)).alias("cancel_at"))
    rows = rows.join(large(init), "booking_id").join(large(first), "booking_id", "left")
    rows = rows.withColumn("cancel_at", F.when(~F.col("init_booking_status").eqNullSafe("Cancelled"), F.col("cancel_at")))
    rows = rows.withColumn("confirm_at", F.when((F.col("init_booking_status") == "Pending")
                                                & (F.col("cancel_at").isNull() | (F.col("confirm_at") < F.col("cancel_at"))),
                                                F.col("confirm_at")))
    sets = (F.col("kind") == "pay") | ((F.col("kind") == "confirm") & F.coalesce(at == F.col("confirm_at"), F.lit(False)) & ~_blank("status"))
    rows = rows.withColumn("set", F.when(sets, F.struct("ts", "seq", F.col("status").alias("value"))))
    rows = rows.withColumn("gate", F.when(F.col("kind") == "gateway", at))
    ranged = cut_lineage(rows.repartitionByRange("booking_id", "ts", "seq").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("booking_id", "range").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("booking_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = (ranged.groupBy("booking_id", "range").agg(F.max("set").alias("set"), F.max("gate").alias("gate"))
              .select("booking_id", "range", F.max("set").over(earlier).alias("set_before"), F.max("gate").over(earlier).alias("gate_before"))
              .filter("set_before is not null or gate_before is not null"))
    rows = (ranged.withColumn("last_set", F.max("set").over(inside)).withColumn("last_gate", F.max("gate").over(inside))
            .join(before, ["booking_id", "range"], "left")
            .withColumn("last_set", F.coalesce("last_set", "set_before")).withColumn("last_gate", F.coalesce("last_gate", "gate_before")))
    status = _payment_status(F.col("init_payment_status"), F.col("last_set"), F.col("last_gate"), F.col("cancel_at"), at)
    accepted = (F.when(F.col("kind") == "confirm", at == F.col("confirm_at"))
                .when(F.col("kind") == "cancel", at == F.col("cancel_at"))
                .when(F.col("kind") == "pay", F.lit(True))
                .when(F.col("kind") == "gateway", status != "Paid")
                .when(F.col("kind") == "proof", ~status.eqNullSafe("Paid")))
    return rows.withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def booking_state(commands: DataFrame, bookings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold ``commands`` (booking_id, ts, seq, kind, status, method,
    txn, note) over each booking's current state in (ts, seq) order.
    ``seq`` breaks ties and must make the order total per booking.  Commands of
    unknown bookings are dropped.  Returns ``(verdicts, final)``: verdicts =
    (booking_id, ts, seq, kind, accepted); final = the state after the last
    command of each commanded booking."""
    rows = _judged(commands, bookings)
    verdicts = rows.select("booking_id", "ts", "seq", "kind", "accepted")
    kind, ok = F.col("kind"), F.col("accepted")

    def last(when: Column, value: Column) -> Column:
        return F.max(F.when(ok & when, F.struct("ts", "seq", value.alias("value"))))

    final = rows.groupBy("booking_id").agg(
        *[F.first("init_" + f).alias("init_" + f) for f in STATE_FIELDS],
        F.first("cancel_at").alias("cancel_at"), F.first("confirm_at").alias("confirm_at"),
        F.max("set").alias("set"), F.max("gate").alias("gate"),
        last(kind.isin("pay", "proof") & (F.coalesce("method", F.lit("")) != "") | (kind == "gateway"),
             F.when(kind == "gateway", F.lit("Electronic")).otherwise(F.col("method"))).alias("method"),
        last((kind == "pay") & (F.coalesce("txn", F.lit("")) != "") | kind.isin("gateway", "proof"), F.col("txn")).alias("txn"),
        last((kind == "pay") & (F.col("status") == "Paid") | (kind == "gateway"), F.col("ts")).alias("paid"),
        last(kind == "proof", falsy_default("note", PROOF_NOTE)).alias("note"))
    booking = (F.when(F.col("cancel_at").isNotNull(), F.lit("Cancelled")).when(F.col("confirm_at").isNotNull(), F.lit("Confirmed"))
               .otherwise(F.col("init_booking_status")))

    def latest(name: str, field: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.col(f"{name}.value")).otherwise(F.col("init_" + field)).alias(field)

    return verdicts, final.select(
        "booking_id", booking.alias("booking_status"),
        _payment_status(F.col("init_payment_status"), F.col("set"), F.col("gate"), F.col("cancel_at"), None).alias("payment_status"),
        latest("method", "payment_method"), latest("txn", "gateway_transaction_id"),
        latest("paid", "payment_timestamp"), latest("note", "notes"))


# ---------------------------------------------------------------------------
# Command table of the five write paths
# ---------------------------------------------------------------------------
def _seq(commands: DataFrame, kind: str, col: str = "command_id") -> Column:
    """Order inside one instant: the kind, then the unique arrival id."""
    arrival(commands, col=col)                            # fails without ids
    return (F.lit(KIND_ORDER[kind]) * F.lit(1 << 56) + F.col(col)).cast("bigint").alias("seq")


def booking_commands(bookings: DataFrame, confirms: DataFrame | None = None, payments: DataFrame | None = None,
                     gateway: DataFrame | None = None, proofs: DataFrame | None = None,
                     cancels: DataFrame | None = None) -> DataFrame:
    """Unify the five command feeds into E4's command table, dropping the
    commands the reference rejects before touching the booking (bad enum
    values, missing fields, a proof by neither the owner nor staff).  Every
    feed carries its arrival id (``command_id``; ``event_id`` of a webhook):
    confirms (booking_id, employee_id, payment_status, notes, ts);
    payments (B2 updates: booking_id, payment_status, payment_method,
    transaction_id, ts); gateway (E2 output: booking_id, session_id,
    received_at); proofs (B4: booking_id, actor_user_id, actor_user_type,
    transaction_id, payment_method, note, ts); cancels (booking_id,
    requested_at)."""
    def trim(c):
        return F.trim(F.coalesce(F.col(c), F.lit("")))

    parts = []
    null = F.lit(None).cast("string")
    if confirms is not None:
        c = confirms.select("booking_id", "ts", _seq(confirms, "confirm"), trim("payment_status").alias("status"), trim("notes").alias("note"))
        c = c.filter((F.col("booking_id") > 0) & ((F.col("status") == "") | F.col("status").isin(*PAYMENT_STATUSES)))
        parts.append(c.select("booking_id", "ts", "seq", F.lit("confirm").alias("kind"), "status", null.alias("method"),
                              null.alias("txn"), "note"))
    if payments is not None:
        p = payments.select("booking_id", "ts", _seq(payments, "pay"), trim("payment_status").alias("status"),
                            trim("payment_method").alias("method"), trim("transaction_id").alias("txn"))
        p = p.filter((F.col("booking_id") > 0) & F.col("status").isin(*PAYMENT_STATUSES)
                     & ((F.col("method") == "") | F.col("method").isin(*PAYMENT_METHODS)))
        parts.append(p.select("booking_id", "ts", "seq", F.lit("pay").alias("kind"), "status", "method", "txn", null.alias("note")))
    if gateway is not None:
        g = gateway.select("booking_id", F.col("received_at").alias("ts"), _seq(gateway, "gateway", "event_id"), F.col("session_id").alias("txn"))
        parts.append(g.select("booking_id", "ts", "seq", F.lit("gateway").alias("kind"), null.alias("status"), null.alias("method"),
                              "txn", null.alias("note")))
    if proofs is not None:
        owners = bookings.select("booking_id", F.col("user_id").alias("_owner"))
        q = (proofs.select("booking_id", "ts", _seq(proofs, "proof"), "actor_user_id", "actor_user_type",
                           trim("transaction_id").alias("txn"), trim("payment_method").alias("method"), trim("note").alias("note"))
             .join(large(owners), "booking_id"))
        q = q.filter((F.col("booking_id") > 0) & ~F.col("txn").isin("", "0")
                     & (F.coalesce(F.col("_owner") == F.col("actor_user_id"), F.lit(False))
                        | F.coalesce(F.col("actor_user_type").isin("Employee", "Admin"), F.lit(False)))
                     & ((F.col("method") == "") | F.col("method").isin(*PAYMENT_METHODS)))
        parts.append(q.select("booking_id", "ts", "seq", F.lit("proof").alias("kind"), null.alias("status"), "method", "txn", "note"))
    if cancels is not None:
        parts.append(cancels.select("booking_id", F.col("requested_at").alias("ts"), _seq(cancels, "cancel"), F.lit("cancel").alias("kind"),
                                    null.alias("status"), null.alias("method"), null.alias("txn"), null.alias("note")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# ---------------------------------------------------------------------------
# Streaming form: the bookings of a bucket are one state in the state store
# ---------------------------------------------------------------------------
#: Times travel as microseconds, and a null as this number (a nullable column of integers is one of floats in pandas).
NO_TIME = -(1 << 63)
STATE_SCHEMA = ("booking_id array<{id}>, n array<long>, booking_status array<string>, payment_status array<string>, payment_method array<string>, "
                "gateway_transaction_id array<string>, payment_timestamp array<long>, notes array<string>")


def _micros(c: str, dtype: str) -> Column:
    """Time column ``c`` as microseconds: of the instant, or of the wall-clock reading of a ``timestamp_ntz``."""
    at = F.unix_micros(c) if dtype == "timestamp" else F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col(c))
    return F.coalesce(at, F.lit(NO_TIME)).alias(c)


def _time(c: str, dtype: str) -> Column:
    """``_micros`` undone."""
    at = F.nullif(F.col(c), F.lit(NO_TIME))
    if dtype == "timestamp":
        return F.timestamp_micros(at).alias(c)
    return F.timestamp_add("MICROSECOND", at, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))).alias(c)


def apply_command(state: dict, kind: str, ts, status: str | None, method: str | None, txn: str | None, note: str | None) -> bool:
    """Apply one command to a booking's fields in place; whether it was accepted."""
    if kind == "confirm":
        if state["booking_status"] != "Pending":
            return False
        state["booking_status"] = "Confirmed"
        if status not in (None, "", "0"):
            state["payment_status"] = status
    elif kind == "cancel":
        if state["booking_status"] == "Cancelled":
            return False
        state["booking_status"] = "Cancelled"
        if state["payment_status"] == "Paid":
            state["payment_status"] = "Refunded"
    elif kind == "pay":
        state["payment_status"] = status
        if method:
            state["payment_method"] = method
        if txn:
            state["gateway_transaction_id"] = txn
        if status == "Paid":
            state["payment_timestamp"] = ts
    elif kind == "gateway":
        if state["payment_status"] in (None, "Paid"):
            return False
        state.update(payment_status="Paid", payment_method="Electronic", gateway_transaction_id=txn, payment_timestamp=ts)
    else:
        if state["payment_status"] == "Paid":
            return False
        state["gateway_transaction_id"] = txn
        if method:
            state["payment_method"] = method
        state["notes"] = PROOF_NOTE if note in (None, "", "0") else note
    return True


class BookingFold(StatefulProcessor):
    """State of a bucket: each booking's commands so far and its fields, an array a field."""

    def __init__(self, id_type: str):
        self.schema = STATE_SCHEMA.format(id=id_type)

    def init(self, handle) -> None:
        self.held = handle.getValueState("bookings", self.schema)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        ids, *fields = [list(initialState[c].iloc[0].tolist()) for c in ("booking_id", *STATE_FIELDS)]
        self.held.update((ids, [0] * len(ids), *fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        if held is None:                                  # no booking of the bucket is known
            return
        ids, counts, *fields = [list(x) for x in held]
        at = {booking: i for i, booking in enumerate(ids)}
        known = [r for piece in rows for r in zip(*[piece[c].tolist() for c in COMMAND_COLS]) if r[0] in at]
        if not known:
            return
        known.sort(key=lambda r: r[:3])                   # booking, ts, seq
        out = []
        for booking, commands in groupby(known, key=lambda r: r[0]):
            i = at[booking]
            n, state = counts[i], {f: values[i] for f, values in zip(STATE_FIELDS, fields)}
            for _, ts, seq, kind, *given in commands:
                n += 1
                ok = apply_command(state, kind, ts, *given)
                out.append((booking, ts, seq, kind, ok, n, *state.values()))
            counts[i] = n
            for f, values in zip(STATE_FIELDS, fields):
                values[i] = state[f]
        self.held.update((ids, counts, *fields))
        yield pd.DataFrame(dict(zip(OUT_COLS, zip(*out))))

    def close(self) -> None:
        pass


def run_booking_state_stream(stream: DataFrame, bookings: DataFrame, out_dir: str, checkpoint_dir: str) -> None:
    """E4 on a stream of commands, to completion (``availableNow``).

    ``out_dir`` gets a row per command of a known booking: its verdict, its
    number ``nth`` among the booking's commands and the booking's fields after
    it.  The fields of every booking are held in the state store, loaded from
    ``bookings`` by the first batch; a batch reads and writes the buckets of the
    bookings it names.
    Commands apply in the order of their batches (as the reference applies
    requests as they come), in (ts, seq) order within one; a history that
    arrives in order gives exactly ``booking_state``.  A task holds one
    bucket's commands of one micro-batch, which the source's rate limit bounds."""
    ts = dict(stream.dtypes)["ts"]
    kinds = dict(bookings.dtypes)
    initial = bookings.where(F.col("booking_id").isNotNull()).select("booking_id", *STATE_FIELDS)
    initial = initial.withColumn("payment_timestamp", _micros("payment_timestamp", kinds["payment_timestamp"]))
    commands = (stream.where(F.col("booking_id").isNotNull()).select(*COMMAND_COLS)
                .withColumn("booking_id", F.col("booking_id").cast(kinds["booking_id"]))
                .withColumn("ts", _micros("ts", ts)).withColumn("seq", F.coalesce("seq", F.lit(NO_TIME))))
    schema = (f"booking_id {kinds['booking_id']}, ts bigint, seq bigint, kind string, accepted boolean, nth bigint, booking_status string, "
              "payment_status string, payment_method string, gateway_transaction_id string, payment_timestamp bigint, notes string")
    each = initial.groupBy(bucket_of(F.col("booking_id"))).agg(F.collect_list(F.struct(*initial.columns)).alias("b"))
    rows = with_state(commands.withColumn("bucket", bucket_of(F.col("booking_id"))), "bucket", BookingFold(kinds["booking_id"]), schema,
                      each.select("bucket", *[F.col(f"b.{c}").alias(c) for c in initial.columns]), pandas=True)
    rows = rows.withColumns({"ts": _time("ts", ts), "seq": F.nullif(F.col("seq"), F.lit(NO_TIME)), "payment_timestamp": _time("payment_timestamp", ts)})
    start_to_files(rows, f"{out_dir}/commands", checkpoint_dir).awaitTermination()


def stream_verdicts(spark: SparkSession, out_dir: str) -> DataFrame:
    """Verdicts written by ``run_booking_state_stream``."""
    return spark.read.parquet(f"{out_dir}/commands").select("booking_id", "ts", "seq", "kind", "accepted")


def final_states(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest state per commanded booking written by ``run_booking_state_stream``."""
    rows = spark.read.parquet(f"{out_dir}/commands")
    last = rows.groupBy("booking_id").agg(F.max_by(F.struct(*STATE_FIELDS), "nth").alias("s"))
    return last.select("booking_id", "s.*")

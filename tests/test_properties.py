"""Properties of the operators over the driver's data and random inputs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fareflow.operators import admission, bookings, inventory, money
from fareflow.plans.catalog import AS_OF
from fareflow.sources.fixtures import build_fixtures
from fareflow.streaming import state as E4

from .conftest import MEDIUM, SMALL


def test_free_and_taken_seats_partition_each_bus(spark):
    fx = build_fixtures(spark, SMALL, "trips", "buses", "seats", "bookings", "passengers")
    free = inventory.available_seats(fx["trips"], fx["buses"], fx["seats"], fx["bookings"], fx["passengers"],
                                     null_aware=False)
    taken = (fx["bookings"].select("booking_id", "trip_id")
             .join(fx["passengers"].filter(F.col("seat_id").isNotNull()).select("booking_id", "seat_id"), "booking_id")
             .select("trip_id", "seat_id"))
    all_seats = fx["trips"].join(fx["seats"], "bus_id").select("trip_id", "seat_id")
    # seats held by passengers always belong to the trip's bus in the fixtures
    assert taken.join(all_seats, ["trip_id", "seat_id"], "left_anti").count() == 0
    union = free.select("trip_id", "seat_id").unionByName(taken).distinct()
    assert union.exceptAll(all_seats).count() == 0 and all_seats.exceptAll(union).count() == 0
    assert free.join(taken, ["trip_id", "seat_id"]).count() == 0


def test_pending_plus_paid_is_total(spark):
    c = build_fixtures(spark, SMALL, "commissions")["commissions"]
    bad = money.partner_month_stats(c).filter(
        (F.col("pending_amount") + F.col("paid_amount")) != F.col("total_commission"))
    assert bad.count() == 0


def test_refund_plus_nonrefundable_is_price(spark):
    fx = build_fixtures(spark, SMALL, "cancel_requests", "bookings", "trips", "cancel_policy_rules")
    q = bookings.cancellation_quote(fx["cancel_requests"], fx["bookings"], fx["trips"], fx["cancel_policy_rules"])
    ok = q.filter(F.col("reject_reason").isNull() & (F.col("refund_amount") <= F.col("total_price")))
    assert ok.count() > 0
    assert ok.filter(F.col("refund_amount") + F.col("non_refundable_part") != F.col("total_price")).count() == 0


def test_mark_paid_rerun_changes_nothing(spark):
    fx = build_fixtures(spark, SMALL, "commissions", "commission_commands")
    per_cmd, updated = money.mark_commissions_paid(fx["commissions"], fx["commission_commands"], AS_OF)
    assert updated.count() > 0
    after = (fx["commissions"].join(updated.select("commission_id", F.col("status").alias("_s")), "commission_id", "left")
             .withColumn("status", F.coalesce("_s", "status")).drop("_s"))
    _, again = money.mark_commissions_paid(after, fx["commission_commands"], AS_OF)
    assert again.count() == 0


def test_gateway_rerun_changes_nothing(spark):
    from fareflow.sources.fixtures import WEBHOOK_TEST_SECRET
    from fareflow.streaming import payments
    fx = build_fixtures(spark, SMALL, "webhooks_raw", "bookings")
    pays = payments.gateway_payments(payments.verify_payment_events(fx["webhooks_raw"], WEBHOOK_TEST_SECRET))
    changed = payments.apply_gateway_payments(fx["bookings"], pays)
    assert changed.count() > 0
    after = (fx["bookings"].join(changed.select("booking_id", F.col("payment_status").alias("_p")), "booking_id", "left")
             .withColumn("payment_status", F.coalesce("_p", "payment_status")).drop("_p"))
    assert payments.apply_gateway_payments(after, pays).count() == 0


# ---------------------------------------------------------------------------
# First-come admission rounds == sequential greedy fold
# ---------------------------------------------------------------------------
def _greedy(reqs):
    held, out = set(), {}
    for rid, res in sorted(reqs.items()):
        if held.isdisjoint(res):
            out[rid] = True
            held |= res
        else:
            out[rid] = False
    return out


def test_admission_rounds_equal_sequential_fold(spark):
    rnd = random.Random(7)
    reqs = {}
    for rid in range(300):                      # dense conflicts: long chains of shared resources
        reqs[rid] = {rnd.randrange(60) for _ in range(rnd.randint(1, 3))}
    rows = [(rid, rid, r) for rid, res in reqs.items() for r in res]
    items = spark.createDataFrame(rows, "rid long, ord long, res long")
    got = {r.rid: r.accepted for r in admission.first_come_admission(items, "rid", "ord", "res").collect()}
    assert got == _greedy(reqs)


def test_sequence_ids_dense_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k")).repartition(13)
    out = admission.assign_sequence_ids(df, ["k"], F.lit(100).cast("bigint"), "new_id")
    got = sorted((r.k, r.new_id) for r in out.collect())
    assert [i for _, i in got] == list(range(101, 5101))


# ---------------------------------------------------------------------------
# A hot booking spread over many range partitions == plain fold
# ---------------------------------------------------------------------------
def _step(state, kind, ts, status, method, txn, note):
    """One command, as the reference's write paths apply it; whether its guard passes."""
    bs, ps = state["booking_status"], state["payment_status"]
    if kind == "confirm":
        if bs != "Pending":
            return False
        state["booking_status"] = "Confirmed"
        if status not in (None, "", "0"):
            state["payment_status"] = status
    elif kind == "pay":
        state["payment_status"] = status
        if method:
            state["payment_method"] = method
        if status == "Paid":
            state["payment_timestamp"] = ts
        if txn:
            state["gateway_transaction_id"] = txn
    elif kind == "gateway":
        if ps is None or ps == "Paid":
            return False
        state.update(payment_status="Paid", payment_method="Electronic", gateway_transaction_id=txn, payment_timestamp=ts)
    elif kind == "proof":
        if ps == "Paid":
            return False
        state["gateway_transaction_id"] = txn
        if method:
            state["payment_method"] = method
        state["notes"] = "Submitted by customer" if note in (None, "", "0") else note
    else:
        if bs == "Cancelled":
            return False
        state["booking_status"] = "Cancelled"
        if ps == "Paid":
            state["payment_status"] = "Refunded"
    return True


def _brute(init, cmds):
    states = {b: dict(s) for b, s in init.items()}
    verdicts = {}
    for c in sorted(cmds, key=lambda c: (c["booking_id"], c["ts"], c["seq"])):
        if c["booking_id"] not in states:
            continue
        ok = _step(states[c["booking_id"]], c["kind"], c["ts"], c["status"], c["method"], c["txn"], c["note"])
        verdicts[(c["booking_id"], c["seq"])] = ok
    return states, verdicts


def test_booking_state_hot_key_matches_sequential_fold(spark):
    rnd = random.Random(3)
    kinds = ["confirm", "pay", "gateway", "proof", "cancel"]
    statuses = ["Unpaid", "Paid", "Refunded"]
    init = {}
    for b in range(1, 6):
        init[b] = {"booking_status": rnd.choice(["Pending", "Confirmed", None]),
                   "payment_status": rnd.choice(["Unpaid", "Paid", None]), "payment_method": "Cash",
                   "gateway_transaction_id": None, "payment_timestamp": None, "notes": None}
    cmds, seq = [], 0
    t0 = dt.datetime(2024, 1, 1)
    for i in range(4000):
        b = 3 if rnd.random() < 0.6 else rnd.randint(1, 6)     # booking 3 is hot; 6 does not exist
        k = rnd.choices(kinds, weights=[1, 6, 4, 3, 0.05])[0]
        seq += 1
        cmds.append({"booking_id": b, "ts": t0 + dt.timedelta(minutes=rnd.randrange(100000)), "seq": seq, "kind": k,
                     "status": rnd.choice(statuses + [""]) if k in ("pay", "confirm") else None,
                     "method": rnd.choice(["", "Cash", "Kareemi"]) if k in ("pay", "proof") else None,
                     "txn": f"x{i}" if k in ("pay", "gateway", "proof") and rnd.random() < 0.8 else
                            ("" if k in ("pay", "proof") else None),
                     "note": rnd.choice(["", "0", "n"]) if k == "proof" else None})
    for c in cmds:                                               # pay needs a real status
        if c["kind"] == "pay" and not c["status"]:
            c["status"] = "Unpaid"
    bdf = spark.createDataFrame(
        [(b, s["booking_status"], s["payment_status"], s["payment_method"], None, None, None) for b, s in init.items()],
        "booking_id long, booking_status string, payment_status string, payment_method string, "
        "gateway_transaction_id string, payment_timestamp timestamp_ntz, notes string")
    cdf = spark.createDataFrame([tuple(c[k] for k in E4.COMMAND_COLS) for c in cmds],
                                "booking_id long, ts timestamp_ntz, seq long, kind string, status string, "
                                "method string, txn string, note string")
    conf = {"spark.sql.shuffle.partitions": "17",                    # the hot booking spans many partitions
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    prev = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        spread = (cdf.repartitionByRange("booking_id", "ts", "seq").filter(F.col("booking_id") == 3)
                  .select(F.spark_partition_id().alias("p")).distinct().count())
        assert spread >= 5
        verdicts, final = E4.booking_state(cdf, bdf)
        got_final = {r.booking_id: r.asDict() for r in final.collect()}
        got_verdicts = {(r.booking_id, r.seq): r.accepted for r in verdicts.collect()}
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)
    want_states, want_verdicts = _brute(init, cmds)
    assert got_verdicts == want_verdicts
    for b, s in want_states.items():
        if b not in got_final:
            continue
        g = got_final[b]
        for f in E4.STATE_FIELDS:
            assert g[f] == s[f], (b, f, g[f], s[f])
    assert set(got_final) == {c["booking_id"] for c in cmds if c["booking_id"] in init}


def test_booking_state_equals_sequential_fold(spark):
    """Many small bookings with every mix of commands, several at one instant."""
    for seed in range(3):
        rnd = random.Random(seed)
        init = {b: {"booking_status": rnd.choice(["Pending", "Confirmed", "Cancelled", None]), "payment_status": rnd.choice(["Unpaid", "Paid", "Refunded", None]),
                    "payment_method": "Cash", "gateway_transaction_id": None, "payment_timestamp": None, "notes": None} for b in range(1, 400)}
        cmds = []
        for i in range(4000):
            k = rnd.choices(["confirm", "pay", "gateway", "proof", "cancel"], weights=[2, 2, 3, 2, 1])[0]
            cmds.append({"booking_id": rnd.randint(1, 410), "ts": dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(6)), "seq": i, "kind": k,
                         "status": rnd.choice(["Unpaid", "Paid", "Refunded"] + [""] * (k == "confirm")) if k in ("pay", "confirm") else None,
                         "method": rnd.choice(["", "Kareemi"]) if k in ("pay", "proof") else None,
                         "txn": rnd.choice(["", f"x{i}"]) if k == "pay" else f"x{i}" if k in ("gateway", "proof") else None,
                         "note": rnd.choice(["", "0", f"n{i}"]) if k == "proof" else None})
        bdf = spark.createDataFrame([(b, *[s[f] for f in E4.STATE_FIELDS]) for b, s in init.items()],
                                    "booking_id long, booking_status string, payment_status string, payment_method string, "
                                    "gateway_transaction_id string, payment_timestamp timestamp_ntz, notes string")
        cdf = spark.createDataFrame([tuple(c[k] for k in E4.COMMAND_COLS) for c in cmds],
                                    "booking_id long, ts timestamp_ntz, seq long, kind string, status string, method string, txn string, note string")
        verdicts, final = E4.booking_state(cdf, bdf)
        states, want = _brute(init, cmds)
        assert {(r.booking_id, r.seq): r.accepted for r in verdicts.collect()} == want
        named = {c["booking_id"] for c in cmds} & set(init)
        assert {r.booking_id: tuple(r[f] for f in E4.STATE_FIELDS) for r in final.collect()} == {b: tuple(states[b][f] for f in E4.STATE_FIELDS) for b in named}


def test_eight_bookings_two_payments_at_one_instant(spark):
    """E4 and B2 agree on ties: the later arrival wins."""
    b = spark.createDataFrame([(i, 1, "Pending", "Unpaid", "Cash", None, None, None) for i in range(1, 9)],
                              "booking_id long, user_id long, booking_status string, payment_status string, payment_method string, "
                              "gateway_transaction_id string, payment_timestamp timestamp_ntz, notes string")
    p = spark.createDataFrame([(10 * i + k, i, s, "", "", dt.datetime(2024, 1, 1)) for i in range(1, 9) for k, s in ((1, "Paid"), (2, "Unpaid"))],
                              "command_id long, booking_id long, payment_status string, payment_method string, transaction_id string, ts timestamp_ntz")
    b2 = {r.booking_id: r.payment_status for r in bookings.apply_payment_updates(b, p)[1].collect()}
    e4 = {r.booking_id: r.payment_status for r in E4.booking_state(E4.booking_commands(b, payments=p), b)[1].collect()}
    assert b2 == e4 == {i: "Unpaid" for i in range(1, 9)}


def test_booking_state_sf001_runs(spark):
    import __spark_entry__ as entry
    df = entry.queries()["booking_state"](spark, MEDIUM)
    assert df.count() > 0


def _forget_last_commit(spark, checkpoint):
    """As after a failure of the driver: the last batch has run, but is not known to be done."""
    import os
    folder = checkpoint.replace("file:", "") + "/commits"
    last = max(int(n) for n in os.listdir(folder) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{folder}/{name}")
    return last


def test_booking_state_stream_over_batches_equals_batch(spark):
    """E4 stream = batch fold when commands arrive in time order over several
    micro-batches (state carried between batches), also when the stream is
    started again and when its last batch runs twice."""
    from fareflow.plans.catalog import _commands, _in_order
    bookings_, cmds = _commands(spark, SMALL)
    cmds = cmds.cache()
    base = _in_order(spark, cmds, "e4-batches", "ts", "seq")
    read = lambda: spark.readStream.schema(cmds.schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")

    def same():
        for got, want in zip((E4.stream_verdicts(spark, base + "/out"), E4.final_states(spark, base + "/out")), E4.booking_state(cmds, bookings_)):
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

    spread = spark.read.parquet(base + "/in").select("booking_id", F.col("_metadata.file_name").alias("f")).groupBy("booking_id")
    assert spread.agg(F.count_distinct("f").alias("n")).where("n > 2").count() > 100
    E4.run_booking_state_stream(read(), bookings_, base + "/out", base + "/ck")
    same()
    assert _forget_last_commit(spark, base + "/ck") == 3
    E4.run_booking_state_stream(read(), bookings_, base + "/out", base + "/ck")
    same()


def test_commands_of_one_booking_one_by_one(spark):
    """Each command in a micro-batch of its own: the state is all that connects them."""
    import time as _time

    from fareflow.streaming import scratch_dir
    b = spark.createDataFrame([(1, "Pending", "Unpaid", "Cash", None, None, None), (2, None, None, None, None, None, None)],
                              "booking_id long, booking_status string, payment_status string, payment_method string, gateway_transaction_id string, "
                              "payment_timestamp timestamp_ntz, notes string")
    schema = "booking_id long, ts timestamp_ntz, seq long, kind string, status string, method string, txn string, note string"
    t = lambda n: dt.datetime(2024, 1, 1, n)
    rows = [(1, t(1), 1, "proof", None, "", "x1", "0"), (1, t(2), 2, "confirm", "", None, None, ""), (1, t(3), 3, "gateway", None, None, "cs", None),
            (1, t(4), 4, "gateway", None, None, "cs2", None), (1, t(5), 5, "cancel", None, None, None, None), (2, t(6), 6, "gateway", None, None, "n", None),
            (1, t(7), 7, "cancel", None, None, None, None), (1, t(8), 8, "gateway", None, None, "cs3", None), (9, t(9), 9, "pay", "Paid", "", "", None)]
    base = scratch_dir(spark, "one-by-one")
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(base + "/in")
        _time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    E4.run_booking_state_stream(stream, b, base + "/out", base + "/ck")
    verdicts = {r.seq: r.accepted for r in E4.stream_verdicts(spark, base + "/out").collect()}
    assert verdicts == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False, 7: False, 8: True}
    got = {r.booking_id: r for r in E4.final_states(spark, base + "/out").collect()}
    assert tuple(got[1])[1:] == ("Cancelled", "Paid", "Electronic", "cs3", t(8), "Submitted by customer") and tuple(got[2])[1:] == (None,) * 6


def test_admission_stream_equals_one_batch(spark):
    """B1 over micro-batches: held seats and ids carried, the last batch run twice, a batch applied again by hand."""
    import os

    import __spark_entry__ as entry
    from fareflow.plans.catalog import _admitted_as_stream, _in_order
    from fareflow.sources.fixtures import build_fixtures
    want = {n: entry.queries()[q](spark, SMALL) for n, q in (("outcomes", "admit_bookings"), ("passengers", "admit_bookings_passengers"))}
    out = _admitted_as_stream(spark, SMALL)

    def same():
        for n, df in want.items():
            assert out.read(n).exceptAll(df).count() == 0 and df.exceptAll(out.read(n)).count() == 0
        ids = sorted(r[0] for r in out.read("bookings").select("booking_id").collect())
        start = out.mark.before(0)
        assert ids == list(range(start + 1, start + 1 + len(ids))) and out.mark.before(99) == ids[-1]

    same()
    base = out.out.removesuffix("/out")
    raw = spark.read.parquet(base + "/in")
    assert _forget_last_commit(spark, base + "/ck") == 3
    out.run(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(base + "/in"), base + "/ck")
    same()
    first = min(raw.select("_metadata.file_path").distinct().collect(), key=lambda r: os.stat(r[0].split(":", 1)[1]).st_mtime_ns)[0]
    out.apply(spark.read.schema(raw.schema).parquet(first), 0)     # an old batch again: it sees no later one
    same()


def test_hmac_matches_python_hmac(spark):
    """E1's HMAC from two nested sha2 calls equals Python's hmac for random
    secrets (short, and longer than the 64-byte block) and Unicode text."""
    import hashlib
    import hmac

    from fareflow.streaming import payments
    rnd = random.Random(11)
    alphabet = "abcXYZ019 .,{}\":=é漢字🙂"
    for secret in ["k", "whsec_" + "x" * 10, "s" * 64, "long-" * 30]:
        msgs = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300))) for _ in range(20)]
        df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "i int, m string")
        got = {r.i: r.h for r in df.select("i", payments.hmac_sha256_hex(F.col("m"), secret).alias("h")).collect()}
        want = {i: hmac.new(secret.encode(), m.encode(), hashlib.sha256).hexdigest() for i, m in enumerate(msgs)}
        assert got == want, secret

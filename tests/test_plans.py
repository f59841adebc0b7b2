"""Plan shape: no cartesian products or nested-loop joins in the join
operators, no Python in the JVM-only operators, filters and column pruning
reaching the Parquet scan."""

import pytest

from fareflow.plans.catalog import QUERIES
from fareflow.plans.checks import physical_plan

from .conftest import SMALL

JOIN_QUERIES = ["trip_search", "unmatched_searches", "booking_history", "available_seats", "match_cancel_rule",
                "resolve_identifiers", "booking_contacts", "default_cancel_policy", "double_booked_seats",
                "resolve_seat_codes", "booking_request_checks", "apply_payment_updates", "confirm_bookings",
                "cancellation_quote", "notification_outbox", "refund_listing", "partner_commission_totals"]

# Run while they are built (rounds, streams): their result is a table scan.
EAGER_QUERIES = {"admit_accounts", "admit_tickets", *(n for n in QUERIES if "stream" in n or n.startswith("store_"))}


@pytest.mark.parametrize("name", JOIN_QUERIES)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = physical_plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - EAGER_QUERIES if not n.startswith("admit_bookings")))
def test_no_python_in_jvm_operators(spark, name):
    plan = physical_plan(QUERIES[name](spark, SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF"):
        assert node not in plan, (name, node)


def test_listing_filter_reaches_parquet(spark):
    plan = physical_plan(QUERIES["filter_listing"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "LessThanOrEqual(o_orderdate" in plan


def test_projection_pruned_at_scan(spark):
    plan = physical_plan(QUERIES["bus_free_seats"](spark, SMALL))
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("p_name" not in s and "p_brand" not in s for s in scans)


def test_month_layout_prunes_partitions(spark):
    from pyspark.sql import functions as F

    from fareflow.operators import money
    from fareflow.sources.fixtures import build_fixtures
    from fareflow.sources.layout import write_with_layout
    from fareflow.streaming import scratch_dir
    c = build_fixtures(spark, SMALL, "commissions")["commissions"]
    path = scratch_dir(spark, "layout") + "/commissions"
    write_with_layout(c, path, "by_month")
    stored = spark.read.parquet(path)
    stats = money.partner_month_stats(stored.filter((F.col("created_year") == 1996) & (F.col("created_month") == 3)))
    plan = physical_plan(stats)
    import re
    pf = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert pf and re.search(r"created_year#\d+ = 1996", pf.group(1)) and re.search(r"created_month#\d+ = 3", pf.group(1))
    want = money.partner_month_stats(c).filter((F.col("year") == 1996) & (F.col("month") == 3))
    assert stats.exceptAll(want).count() == 0 and want.exceptAll(stats).count() == 0


@pytest.mark.parametrize("name,exchanges", [("booking_history", 10), ("refund_commission_report", 12), ("refund_listing", 10)])
def test_listings_count_on_keys(spark, name, exchanges):
    """With broadcasts off: the count beside a listing joins keys only, and
    J2's trips meet their dimensions once (30 exchanges before)."""
    import re
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    print(name, len(re.findall(r"[-+] Exchange ", plan)), plan.count("SortMergeJoin"))
    assert len(re.findall(r"[-+] Exchange ", plan)) <= exchanges


def test_requested_days_prune_the_trips(spark):
    """the requested days reach the scan of trips stored by day while it runs, and other days are not read."""
    import re

    df = QUERIES["trip_search_by_day"](spark, SMALL)
    plan = physical_plan(df)
    assert re.search(r"PartitionFilters: \[[^\]]*departure_date[^\]]*dynamicpruning", plan)
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SubqueryBroadcast dynamicpruning#\d+, \[0\], \[departure_date", ran)


def _join_inputs(plan):
    """The lines below each sort-merge join, split into its two inputs."""
    lines = plan.splitlines()
    depth = lambda s: __import__("re").match(r"(?:[ :]  )*(?:[:+]- )?", s).end()
    for i, line in enumerate(lines):
        if "SortMergeJoin" in line:
            below = []
            for x in lines[i + 1:]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            first = min(depth(x) for x in below)
            cut = [k for k, x in enumerate(below) if depth(x) == first]
            yield ["\n".join(below[a:b]) for a, b in zip(cut, [*cut[1:], len(below)])]


@pytest.mark.parametrize("name,moved", [("booking_contacts_bucketed", 0), ("double_booked_seats_bucketed", 0), ("apply_gateway_payments_bucketed", 1)])
def test_bucketed_sides_are_not_shuffled(spark, name, moved):
    """With broadcasts off: the bucketed sides of the join have no exchange (E3's payments, the small side, have one)."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    inputs = next(iter(_join_inputs(plan)))
    assert len(inputs) == 2 and sum("Exchange" in x for x in inputs) == moved
    assert sum("Bucketed: true" in x or "bucketed_" in x for x in inputs) == 2 - moved


def test_json_sink_computes_its_input_once(spark):
    """Rows are counted while they are written."""
    from pyspark.sql import functions as F

    from fareflow.sources import sinks
    from fareflow.streaming import scratch_dir
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(50).select(F.udf(lambda x: (seen.add(1), x)[1], "long")("id").alias("id"))
    assert sinks.write_json(rows, scratch_dir(spark, "once")) == 50 and seen.value == 50


@pytest.mark.parametrize("name", ["available_seats", "available_seats_not_exists", "available_seats_active", "resolve_seat_codes",
                                  "booking_request_checks", "double_booked_seats"])
def test_tables_that_grow_are_not_broadcast(spark, name):
    """Seats pass for a table of 10 MB at any size: the planner doesn't see that they are exploded."""
    assert "Broadcast" not in physical_plan(QUERIES[name](spark, SMALL))


def test_chains_of_requests_are_not_broadcast(spark, monkeypatch):
    """Labels of open requests are as many as the requests: no table of a round, a labelling or a fold is broadcast."""
    from pyspark.sql import functions as F

    from fareflow.operators import admission
    plans, write = [], type(spark.range(1)).write.fget
    monkeypatch.setattr(type(spark.range(1)), "write", property(lambda df: (plans.append(physical_plan(df)), write(df))[1]))
    wants = F.explode(F.array("id", F.when(F.col("id") % 10 < 9, F.col("id") + 1)))         # two chains of ten
    items = spark.range(20).select(F.col("id").alias("rid"), F.col("id").alias("at"), wants.alias("seat")).where("seat is not null")
    out = admission.first_come_admission(items, "rid", "at", "seat")
    assert {r.rid: r.accepted for r in out.collect()} == {i: i % 2 == 0 for i in range(20)}
    assert len(plans) > 4 and "_all" in plans[-2] + plans[-1] and not any("Broadcast" in p for p in plans)


def test_unmatched_searches_make_no_row_per_trip(spark):
    """Requests meet the distinct (route, day, class) on offer, not each of their trips."""
    import datetime as dt
    import re

    from fareflow.operators import inventory
    day = dt.date(1997, 1, 5)
    requests = spark.createDataFrame([(1, "A", "C", day, "Gold"), (2, "C", "A", day, "Gold"), (3, "A", "C", day, "Iron"), (4, "", "C", day, "Gold"),
                                      (5, "A", "C", None, "Gold"), (6, "A", "C", day, "Gold"), (6, "C", "A", day, "Gold"), (None, "A", "C", day, "Gold")],
                                     "request_id long, from_stop string, to_city string, travel_date date, bus_class string")
    at = dt.datetime(1997, 1, 5, 8)
    trips = spark.createDataFrame([(t, 1, 1, 1, at, at, None) for t in range(50)],
                                  "trip_id long, route_id int, bus_id long, partner_id long, departure_time timestamp_ntz, arrival_time timestamp_ntz, base_price decimal(12,2)")
    rest = [spark.createDataFrame([(1, "A", "C")], "route_id int, origin_city string, destination_city string"),
            spark.createDataFrame([(1, 0, "A"), (1, 1, "C")], "route_id int, stop_order int, stop_name string"),
            spark.createDataFrame([(1, 1, "m")], "bus_id long, bus_class_id int, model string"),
            spark.createDataFrame([(1, "Gold"), (2, "Iron")], "bus_class_id int, class_name string"),
            spark.createDataFrame([(1, "p")], "partner_id long, company_name string"),
            spark.createDataFrame([(1, 1, "S1", True)], "seat_id long, bus_id long, seat_number string, is_available boolean")]
    out = inventory.unmatched_searches(requests, trips, *rest)
    assert sorted((r.request_id or 0, r.reject_reason) for r in out.collect()) == [
        (0, "no_trips"), (2, "no_trips"), (3, "no_trips"), (4, "missing_fields"), (5, "missing_fields")]
    assert re.search(r"Keys \[3\]: \[route_id|keys=\[route_id", physical_plan(out))


def test_kept_cancellations_are_judged_once(spark):
    """Stored cancellations use three outputs: none of them joins requests, trips and rules again."""
    from fareflow.operators.bookings import apply_cancellations
    from fareflow.sources.fixtures import build_fixtures
    names = ("cancel_requests", "bookings", "trips", "cancel_policy_rules", "passengers")
    fx = build_fixtures(spark, SMALL, *names)
    plain, kept = (apply_cancellations(*(fx[n] for n in names), keep=keep) for keep in (False, True))
    assert plain.keys() == kept.keys()
    for name in plain:
        assert plain[name].columns == kept[name].columns
        assert plain[name].exceptAll(kept[name]).isEmpty() and kept[name].exceptAll(plain[name]).isEmpty()
    assert "Join" in physical_plan(plain["bookings"]) and "Join" not in physical_plan(kept["bookings"])


@pytest.mark.parametrize("name", ["trip_search", "trip_search_by_day"])
def test_searches_are_dealt_over_tasks_that_follow_the_requests(spark, monkeypatch, name):
    """The join that makes a row for each request and trip runs in as many tasks as the requests ask for, not in
    as many as AQE leaves of its (small) input; what depends on the trip alone is below the join."""
    from fareflow.operators import inventory
    requests = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    monkeypatch.setattr(inventory, "REQUESTS_A_TASK", 100)
    df = QUERIES[name](spark, SMALL)
    plan = physical_plan(df, "simple")
    tasks = -(-requests // 100)
    assert plan.count(f", {tasks}), REPARTITION_BY_NUM") >= 2       # by day, the pruning of days names one once more
    assert "duration" in plan.split("SortMergeJoin")[1] and "timestampdiff" not in plan.split("SortMergeJoin")[0].lower()


def test_a_hot_search_is_dealt_to_shares(spark):
    """All requests ask for one route, day and class (some twice, one without an id): each meets every trip once."""
    import datetime as dt

    from pyspark.sql import functions as F

    from fareflow.operators import inventory
    day, at = dt.date(1997, 1, 5), dt.datetime(1997, 1, 5, 8)
    ids = [*range(60), 7, 7, None]
    requests = spark.createDataFrame([(i, "A", "C", day, "Gold") for i in ids],
                                     "request_id long, from_stop string, to_city string, travel_date date, bus_class string")
    trips = spark.createDataFrame([(t, 1, 1, 1, at, at + dt.timedelta(minutes=61), None if t else 40) for t in range(5)],
                                  "trip_id long, route_id int, bus_id long, partner_id long, departure_time timestamp_ntz, arrival_time timestamp_ntz, base_price decimal(12,2)"
                                  .replace("decimal(12,2)", "int")).withColumn("base_price", F.col("base_price").cast("decimal(12,2)"))
    rest = [spark.createDataFrame([(1, "A", "C")], "route_id int, origin_city string, destination_city string"),
            spark.createDataFrame([(1, 0, "A"), (1, 1, "C")], "route_id long, stop_order int, stop_name string"),
            spark.createDataFrame([(1, 1, "m")], "bus_id long, bus_class_id int, model string"),
            spark.createDataFrame([(1, "Gold")], "bus_class_id int, class_name string"),
            spark.createDataFrame([(1, "p")], "partner_id long, company_name string"),
            spark.createDataFrame([(1, 1, "S1", True)], "seat_id long, bus_id long, seat_number string, is_available boolean")]
    out = inventory.trip_search(requests, trips, *rest)
    rows = out.collect()
    assert sorted((-1 if r.request_id is None else r.request_id, r.trip_id) for r in rows) == sorted(
        (-1 if i is None else i, t) for i in ids for t in range(5))
    assert {(r.trip_id, r.price_adult, r.price_child, r.duration_minutes) for r in rows if r.trip_id < 2} == {(0, 40, -10, 61), (1, None, None, 61)}
    assert "_share" in physical_plan(out)


def test_double_bookings_are_dealt_over_tasks_that_follow_the_bookings(spark, monkeypatch):
    """The hash tables of the audit hold a task's triples: the number of tasks follows the bookings, whatever the session's is."""
    from fareflow.operators import inventory
    bookings = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    want = QUERIES["double_booked_seats"](spark, SMALL)
    rows = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(inventory, "BOOKINGS_A_TASK", 100)
    dealt = QUERIES["double_booked_seats"](spark, SMALL)
    assert physical_plan(dealt, "simple").count(f", {-(-bookings // 100)}), REPARTITION_BY_NUM") == 2
    assert rows and sorted(map(tuple, dealt.collect())) == rows


def test_a_day_search_keeps_the_days_of_its_requests(spark):
    """the requests' days and number are kept in a small table, which prunes the trips; before, the requests were read
    for the number, for the days and for the pruning.  No date is formatted to see whether it is there, and the
    route's stop names are not shuffled beside the equal ones asked for."""
    df = QUERIES["trip_search_by_day"](spark, SMALL)
    assert any("/fareflow-cut-" in f for f in df.inputFiles())
    plan = physical_plan(df, "simple")
    assert "as date) as string" not in plan
    dealt = [line for line in plan.splitlines() if "Project" in line and "xxhash64" in line]
    assert dealt and not any("route_from_stop" in line for line in dealt)


def test_folders_of_a_small_table_are_written_by_many_tasks(spark):
    """a day's folder costs the same however few trips it gets; the tasks are not merged by the bytes they read
    (all 40 folders were written by one)."""
    import datetime as dt

    from fareflow.sources.layout import read_trips_by_day, write_with_layout
    from fareflow.streaming import scratch_dir
    at = dt.datetime(1997, 1, 1, 8)
    trips = spark.createDataFrame([(t, at + dt.timedelta(days=t % 40)) for t in range(200)] + [(200, None)],
                                  "trip_id long, departure_time timestamp_ntz")
    path = scratch_dir(spark, "layout") + "/trips"
    write_with_layout(trips, path, "trips_by_day")
    stored = read_trips_by_day(spark, path)
    files = [f.rsplit("/", 1)[1] for f in stored.inputFiles()]
    assert len(files) == 41 and len({f[:10] for f in files}) >= 4
    assert sorted(r.trip_id for r in stored.collect()) == list(range(201))


def test_trips_by_day_give_what_plain_trips_give(spark):
    """over trips stored by day, with requests that lack a field, come twice or have no id, trips that come
    twice or have no departure, and no request at all."""
    import datetime as dt

    from pyspark.sql import functions as F

    from fareflow.operators import inventory
    from fareflow.sources.layout import read_trips_by_day, write_with_layout
    from fareflow.streaming import scratch_dir
    day, at = dt.date(1997, 1, 5), dt.datetime(1997, 1, 5, 8)
    asked = "request_id long, from_stop string, to_city string, travel_date date, bus_class string"
    requests = spark.createDataFrame([(1, "A", "C", day, "Gold"), (1, "A", "C", day, "Gold"), (None, "B", "C", day, "Gold"),
                                      (2, "A", "C", None, "Gold"), (3, "", "C", day, "Gold"), (4, "A", "0", day, "Gold"),
                                      (5, "A", "C", day, None), (6, "C", "A", day, "Gold"), (7, "A", "C", dt.date(1997, 2, 1), "Gold"),
                                      (8, "A", "C", dt.date(1997, 1, 6), "Gold")], asked)
    trips = spark.createDataFrame([(t, 1, 1, 1, None if t == 4 else at + dt.timedelta(days=t % 3), at + dt.timedelta(days=3)) for t in (*range(6), 0)],
                                  "trip_id long, route_id int, bus_id long, partner_id long, departure_time timestamp_ntz, arrival_time timestamp_ntz"
                                  ).withColumn("base_price", F.lit(40).cast("decimal(12,2)"))
    rest = [spark.createDataFrame([(1, "A", "C")], "route_id int, origin_city string, destination_city string"),
            spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (1, 2, "C")], "route_id long, stop_order int, stop_name string"),
            spark.createDataFrame([(1, 1, "m")], "bus_id long, bus_class_id int, model string"),
            spark.createDataFrame([(1, "Gold")], "bus_class_id int, class_name string"),
            spark.createDataFrame([(1, "p")], "partner_id long, company_name string"),
            spark.createDataFrame([(1, 1, "S1", True)], "seat_id long, bus_id long, seat_number string, is_available boolean")]
    path = scratch_dir(spark, "layout") + "/trips"
    write_with_layout(trips, path, "trips_by_day")
    stored = read_trips_by_day(spark, path)
    plain, by_day = (inventory.trip_search(requests, t, *rest) for t in (trips, stored))
    assert by_day.dtypes == plain.dtypes
    rows = sorted(map(repr, by_day.collect()))
    assert rows == sorted(map(repr, plain.collect()))
    # trips 0 (twice) and 3 leave on the 5th, trip 1 on the 6th (4 never)
    assert sorted((r.request_id or 0, r.trip_id, r.route_from_stop, r.route_to_stop) for r in by_day.collect()) == sorted(
        [(i, t, s, "C") for i, s in ((1, "A"), (1, "A"), (0, "B")) for t in (0, 0, 3)] + [(8, 1, "A", "C")])
    assert inventory.trip_search(requests.limit(0), stored, *rest).collect() == []
    lacking = inventory.unmatched_searches(requests, trips, *rest).filter("reject_reason = 'missing_fields'")
    assert sorted(r.request_id for r in lacking.collect()) == [2, 3, 4, 5]

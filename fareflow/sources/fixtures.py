"""Domain tables derived from the driver's Parquet tables (FIXTURES.md).

The reference ships no data, so every domain table (trips, seats, bookings,
...) and every request/command/event table is a deterministic view over the
base tables.  One portable SQL text per view is rendered for two dialects:

* ``spark``  - run with ``spark.sql`` over temp views of the base tables;
* ``duckdb`` - emitted as a ``WITH`` prefix for the oracle queries.

These builders only shape stand-in input rows; none of them does an
operator's work.  On the Spark side the views that multiply a table by a
handful of nation keys (``cross join nation k where k < N``) explode the array
of those keys, read from ``nation``, so that no Spark plan contains a cartesian
product; the DuckDB text keeps the literal cross join, which makes the oracle
an independent check of that rewrite.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..streaming.payments import hmac_pads
from .tables import BASE_TABLES, load_tables

# Test webhook secret fixed by FIXTURES.md.
WEBHOOK_TEST_SECRET = "whsec_test"


def _tokens(dialect: str) -> dict[str, str]:
    ipad, opad = hmac_pads(WEBHOOK_TEST_SECRET)
    if dialect == "spark":
        return {
            "{T0}": "timestamp_ntz '1997-01-01'",
            "{EPOCH}": "timestamp_ntz '1970-01-01'",
            "{DIFF}": "timestampdiff(second,",
            "{ARR}": "array",
            "{CAT}": "concat",
            "{LIST}": "collect_list",
            "{TS}": "timestamp_ntz",
            "{SIG}": f"sha2(concat(X'{opad}', unhex(sha2(concat(X'{ipad}', encode(",
            "{/SIG}": ", 'UTF-8')), 256))), 256)",
        }
    if dialect == "duckdb":
        return {
            "{T0}": "timestamp '1997-01-01'",
            "{EPOCH}": "timestamp '1970-01-01'",
            "{DIFF}": "date_sub('second',",
            "{ARR}": "list_value",
            "{CAT}": "list_concat",
            "{LIST}": "list",
            "{TS}": "timestamp",
            "{SIG}": f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode(",
            "{/SIG}": "))))",
        }
    raise ValueError(dialect)


# ---------------------------------------------------------------------------
# Fixed fixture texts (FIXTURES.md).  Name -> (portable SQL, dependencies).
# ---------------------------------------------------------------------------
FIXTURE_SQL: dict[str, str] = {
    "partners": "select s_suppkey as partner_id, s_name as company_name from supplier",
    "users": (
        "select c_custkey as user_id, c_name as full_name, "
        "concat('u', cast(c_custkey - case when c_custkey % 97 = 96 then 1 else 0 end as string), '@example.org') as email, "
        "case c_custkey % 4 when 0 then concat('7', lpad(cast(c_custkey as string), cast(greatest(8, length(cast(c_custkey as string))) as int), '0')) "
        "when 1 then concat('+967 7', lpad(cast(c_custkey as string), cast(greatest(8, length(cast(c_custkey as string))) as int), '0')) "
        "when 2 then concat('967-7', lpad(cast(c_custkey as string), cast(greatest(8, length(cast(c_custkey as string))) as int), '0')) else '' end as phone_number, "
        "case when c_custkey % 50 = 0 then 'Admin' when c_custkey % 10 = 0 then 'Employee' else 'Customer' end as user_type "
        "from customer"),
    "bus_classes": "select r_regionkey as bus_class_id, r_name as class_name from region",
    "buses": "select p_partkey as bus_id, cast(p_partkey % 5 as int) as bus_class_id, p_name as model from part",
    "seats": (
        "select p_partkey*25+n_nationkey as seat_id, p_partkey as bus_id, "
        "concat('S', lpad(cast(n_nationkey as string),2,'0')) as seat_number, "
        "(p_partkey*25+n_nationkey) % 7 <> 0 as is_available from part cross join nation"),
    "routes": (
        "select a.n_nationkey as route_id, a.n_name as origin_city, b.n_name as destination_city "
        "from nation a join nation b on b.n_nationkey = (a.n_nationkey + 9) % 25"),
    "route_stops": (
        "select r.n_nationkey as route_id, k.n_nationkey as stop_order, s.n_name as stop_name "
        "from nation r cross join nation k join nation s on s.n_nationkey = (r.n_nationkey + 3*k.n_nationkey) % 25 "
        "where k.n_nationkey < 4"),
    "trips": (
        "select p_partkey as trip_id, cast(p_partkey % 25 as int) as route_id, p_partkey as bus_id, "
        "p_partkey % (select count(*) from supplier) as partner_id, "
        "{T0} + interval '1' hour * ((p_partkey*37) % 8760) as departure_time, "
        "{T0} + interval '1' hour * ((p_partkey*37) % 8760) + interval '1' minute * (p_size*60 + p_partkey % 60) as arrival_time, "
        "cast(p_retailprice as decimal(12,2)) as base_price from part"),
    "cancel_policies": (
        "select s_suppkey*2+k.n_nationkey as cancel_policy_id, s_suppkey as partner_id, "
        "k.n_nationkey = 0 as is_default, not (k.n_nationkey = 0 and s_suppkey % 10 = 9) as is_active "
        "from supplier cross join nation k where k.n_nationkey < 2"),
    "cancel_policy_rules": (
        "select s_suppkey*8+k.n_nationkey as cancel_policy_rule_id, "
        "s_suppkey*2+cast(floor(k.n_nationkey/4) as int) as cancel_policy_id, "
        "cast(case k.n_nationkey % 4 when 0 then 72 when 1 then 24 when 2 then 6 else 2 end as double) as min_hours_before_departure, "
        "cast(case k.n_nationkey % 4 when 0 then null when 1 then 72 when 2 then 24 else 8 end as double) as max_hours_before_departure, "
        "cast(case k.n_nationkey % 4 when 0 then 100 when 1 then 75 when 2 then 50 else 10 end as decimal(5,2)) as refund_percentage, "
        "cast((k.n_nationkey % 4)*500 as decimal(12,2)) as cancellation_fee, s_suppkey % 7 <> 6 as is_active "
        "from supplier cross join nation k where k.n_nationkey < 8"),
    "bookings": (
        "select o_orderkey as booking_id, o_custkey as user_id, o_orderkey % (select count(*) from part) as trip_id, "
        "cast(o_totalprice as decimal(12,2)) as total_price, "
        "case o_orderstatus when 'F' then 'Confirmed' when 'O' then 'Pending' else 'Cancelled' end as booking_status, "
        "case when o_orderkey % 50 = 49 then null when o_orderkey % 3 = 0 then 'Unpaid' when o_orderkey % 3 = 1 then 'Paid' else 'Refunded' end as payment_status, "
        "case o_orderkey % 4 when 0 then 'Electronic' when 1 then 'Cash' when 2 then 'Kareemi' else 'Transfer' end as payment_method, "
        "o_orderdate as booking_date, cast(null as {TS}) as payment_timestamp, cast(null as string) as gateway_transaction_id, "
        "cast(null as string) as notes, "
        "(o_orderkey % (select count(*) from part)) % (select count(*) from supplier) * 2 as cancel_policy_id from orders"),
    "passengers": (
        "select l_orderkey*8+l_linenumber as passenger_id, l_orderkey as booking_id, "
        "l_orderkey % (select count(*) from part) as trip_id, "
        "case when min(l_partkey) % 400 = 3 then null else (l_orderkey % (select count(*) from part))*25 + min(l_partkey) % 25 end as seat_id, "
        "case when (l_orderkey*8+l_linenumber) % 9 = 4 then 'Cancelled' else 'Active' end as passenger_status "
        "from lineitem group by l_orderkey, l_linenumber"),
    "commissions": (
        "select b.booking_id as commission_id, b.booking_id, t.partner_id, b.total_price as booking_amount, "
        "cast(round(b.total_price*0.10,2) as decimal(12,2)) as commission_amount, "
        "cast(b.total_price - cast(round(b.total_price*0.10,2) as decimal(12,2)) as decimal(12,2)) as partner_revenue, "
        "case b.booking_id % 2 when 0 then 'Pending' else 'Paid' end as status, 'n0' as notes, b.booking_date as created_at "
        "from bookings b join trips t on t.trip_id=b.trip_id where b.payment_status <> 'Unpaid'"),
    "refund_transactions": (
        "select booking_id as refund_id, booking_id, "
        "case booking_id % 7 when 1 then 'Processing' when 2 then 'Completed' else 'Pending' end as refund_status, "
        "booking_date as created_at from bookings where payment_status='Refunded'"),
    "user_device_tokens": (
        "select user_id, case when event_id % 11 = 0 then '' else concat('tok', cast(event_id as string)) end as fcm_token, "
        "case event_type when 'click' then 'ios' when 'view' then 'web' when 'error' then 'blackberry' else 'android' end as device_type, "
        "ts as created_at from events"),
    "faqs": (
        "select doc_id as faq_id, concat(lang, '/', source) as category, "
        "concat('What does document ', cast(doc_id as string), ' say?') as question, "
        "text as answer, n_chars > 500 as is_active from documents"),
    # request, command and event tables
    "search_requests": (
        "select o_orderkey as request_id, a.n_name as from_stop, b.n_name as to_city, "
        "cast({T0} + interval '1' day * (o_orderkey % 365) as date) as travel_date, r_name as bus_class "
        "from orders join nation a on a.n_nationkey = o_orderkey % 25 "
        "join nation b on b.n_nationkey = (o_orderkey + 3 + 3*(o_custkey % 3)) % 25 "
        "join region on r_regionkey = o_custkey % 5"),
    "cancel_requests": (
        # every booking once, every seventh once more at the same instant and every eleventh three hours later
        "select b.booking_id*4+k.n_nationkey as command_id, b.booking_id, "
        "t.departure_time - interval '1' hour * ((b.booking_id*7) % 121 - 12 - case when k.n_nationkey = 2 then 3 else 0 end) as requested_at, "
        "'Customer request' as reason from bookings b join trips t on t.trip_id=b.trip_id cross join nation k "
        "where k.n_nationkey = 0 or (k.n_nationkey = 1 and b.booking_id % 7 = 0) or (k.n_nationkey = 2 and b.booking_id % 11 = 0)"),
    "booking_requests_raw": (
        "select o_orderkey as request_id, o_orderdate as received_at, concat('{\"user_id\":', cast(o_custkey as string), "
        "',\"trip_id\":\"', cast(o_orderkey % ((select count(*) from part) + 5) as string), "
        "'\",\"total_price\":', cast(o_totalprice as string), ',\"passengers\":', "
        "case when o_orderkey % 40 = 2 then '[]' else concat('[{\"full_name\":\"P1\",\"seat_code\":\" S', "
        "lpad(cast((o_orderkey*3) % 27 as string),2,'0'), '\"},{\"full_name\":\"P2\",\"gender\":\"F\",\"seat_code\":\"S', "
        "lpad(cast((o_orderkey*11) % 27 as string),2,'0'), '\"}]') end, '}') as body from orders"),
    "confirm_commands": (
        # every booking once; every fourth again at the same instant with another status
        "select o_orderkey*2+k.n_nationkey as command_id, o_orderkey as booking_id, o_custkey as employee_id, "
        "case when (o_orderkey + k.n_nationkey) % 2 = 0 then 'Paid' else '' end as payment_status, "
        "case when o_orderkey % 5 = 0 then '0' else '' end as notes, "
        "case when o_orderkey % 6 <> 1 then concat('10.0.0.', cast(o_custkey % 250 as string)) end as ip_address, o_orderdate as ts from orders cross join nation k "
        "where k.n_nationkey = 0 or (k.n_nationkey = 1 and o_orderkey % 4 = 0)"),
    "payment_updates": (
        # every event once; every third again at the same instant with another status
        "select event_id*2+k.n_nationkey as command_id, event_id % (select count(*) from orders) + 3 as booking_id, "
        "case when k.n_nationkey = 1 then 'Unpaid' else case event_type when 'purchase' then 'Paid' when 'error' then 'Refunded' "
        "when 'view' then 'Lost' else 'Unpaid' end end as payment_status, "
        "case when (event_id + k.n_nationkey) % 3 = 0 then '' else 'Kareemi' end as payment_method, "
        "case when event_id % 2 = 0 then '' else concat('tx', cast(event_id*2+k.n_nationkey as string)) end as transaction_id, ts "
        "from events cross join nation k where k.n_nationkey = 0 or (k.n_nationkey = 1 and event_id % 3 = 0)"),
    "payment_proofs": (
        "select event_id as command_id, event_id % (select count(*) from orders) as booking_id, "
        "case when event_id % 3 = 0 then b.user_id else e.user_id end as actor_user_id, "
        "case when event_id % 7 = 0 then 'Employee' else 'Customer' end as actor_user_type, "
        "concat('px', cast(event_id as string)) as transaction_id, "
        "case when event_id % 2 = 0 then '' else 'Transfer' end as payment_method, '' as note, ts "
        "from events e left join bookings b on b.booking_id = event_id % (select count(*) from orders)"),
    "refund_commands": (
        # every booking once; every third again, equal but for the command id
        "select booking_id*2+k.n_nationkey as command_id, booking_id as refund_id, "
        "case booking_id % 5 when 0 then 'Cheque' when 1 then 'Cash' else 'Kareemi' end as refund_method, "
        "case when booking_id % 2 = 0 then '' else concat('R', cast(booking_id as string)) end as refund_reference, "
        "7 as employee_id from bookings cross join nation k where k.n_nationkey = 0 or (k.n_nationkey = 1 and booking_id % 3 = 0)"),
    "commission_commands": (
        "select o_custkey as command_id, {CAT}({LIST}(o_orderkey), {ARR}(min(o_orderkey))) as commission_ids, "
        "case when o_custkey % 2 = 0 then '' else 'batch' end as notes from orders group by o_custkey"),
    # every commission once (some with nothing left); every fourth again, with another amount
    "commission_adjustments": (
        "select commission_id*2+k.n_nationkey as command_id, commission_id, booking_id, "
        "cast(case when k.n_nationkey = 1 then round(booking_amount*0.25,2) when commission_id % 11 = 5 then 0 else round(booking_amount*0.5,2) end as decimal(12,2)) "
        "as new_amount from commissions cross join nation k where k.n_nationkey = 0 or (k.n_nationkey = 1 and commission_id % 4 = 1)"),
    # strings as clients send them: numbers, numbers with something around them, none
    "awkward_numbers": (
        "select o_orderkey as row_id, case o_orderkey % 21 when 0 then cast(o_orderkey as string) when 1 then concat('  ', cast(o_orderkey as string), 'abc') "
        "when 2 then concat(cast(o_orderkey % 9 as string), 'e3') when 3 then '12345678901234567890' when 4 then '-99999999999999999999.5' "
        "when 5 then concat('-', cast(o_totalprice as string)) when 6 then 'abc' when 7 then '' when 8 then null when 9 then '.5' "
        "when 10 then concat('+', cast(o_custkey as string), '.') when 11 then '12345678901.5' when 12 then concat(cast(o_custkey as string), ' ') "
        "when 13 then '1.5e-1' when 14 then '0' when 15 then '1234567890123456789' when 16 then '-1000000000000000001x' when 17 then '9223372036854775807' "
        "when 18 then ' +009223372036854775808' when 19 then '1234567890123456789.5' else concat(cast(o_totalprice as string), ' USD') end as s from orders"),
    "listing_requests": (
        "select s_suppkey*2 as request_id, s_suppkey as partner_id, case s_suppkey % 3 when 0 then '' when 1 then ' Paid ' else 'Pending' end as status, "
        "case when s_suppkey % 2 = 0 then {TS} '1994-01-01 00:00:00' end as ts_from, "
        "case when s_suppkey % 5 < 3 then {TS} '1997-06-30 00:00:00' end as ts_to from supplier"),
    "stats_requests": (
        "select s_suppkey as partner_id, cast(1992 + s_suppkey % 8 as int) as year, cast(s_suppkey % 12 + 1 as int) as month from supplier "
        "union all select s_suppkey, cast(2030 as int), cast(1 as int) from supplier"),
    "identifier_lookups": (
        "select c_custkey as lookup_id, case when c_custkey % 3 = 0 then concat('u', cast(c_custkey as string), '@example.org') "
        "when c_custkey % 3 = 1 then concat('7', lpad(cast(c_custkey as string), cast(greatest(8, length(cast(c_custkey as string))) as int), '0')) else 'nobody' end as identifier from customer"),
    "registrations": (
        "select c_custkey as registration_id, c_name as full_name, "
        "case when c_custkey % 2 = 0 then concat('u', cast(c_custkey as string), '@example.org') "
        "else concat('new', cast(c_custkey - c_custkey % 9 as string), '@example.org') end as email, "
        "case when c_custkey % 12 = 3 then '' else concat('79', lpad(cast(c_custkey as string), cast(greatest(7, length(cast(c_custkey as string))) as int), '0')) end as phone_number, "
        "case when c_custkey % 17 = 5 then '' else 'secret' end as password from customer"),
    "tickets_raw": (
        "select conv_id*1000000+turn as ticket_key, conv_id % 100 as user_id, "
        "case when conv_id % 9 = 0 then null else 'general' end as issue_type, "
        "case when conv_id % 13 = 4 then '' else concat(role, ' ', cast(conv_id as string)) end as title, "
        "text as description from conversations"),
    "payment_events": (
        "select event_id, case when event_id % 13 = 5 then '' else concat('cs_', cast(event_id - event_id % 3 as string)) end as session_id, "
        "case when event_type='purchase' then 'checkout.session.completed' else event_type end as type, "
        "(event_id - event_id % 3) % (select count(*) from orders) as booking_id, ts from events"),
    "webhooks_raw": (
        "select event_id, received_at, payload, concat('t=', cast(t as string), ',v1=', "
        "case when event_id % 10 = 0 then '00' else {SIG} concat(cast(t as string), '.', payload) {/SIG} end) as sig_header "
        "from (select event_id, ts + interval '1' second * (event_id % 400) as received_at, {DIFF} {EPOCH}, ts) as t, "
        "concat('{\"type\":\"', type, '\",\"data\":{\"object\":{\"id\":\"', session_id, '\",\"metadata\":{\"booking_id\":\"', "
        "cast(booking_id as string), '\"}}}}') as payload from payment_events) x"),
}

# Spark texts of the views that multiply a table by nation keys: the keys are
# one array, read from ``nation`` by a scalar subquery and exploded per row.
def _with_keys(table: str, where: str = "", cols: str = "*") -> str:
    """``table`` with a column ``k``: each nation key (that meets ``where``) per row."""
    keys = f"select sort_array(collect_list(n_nationkey)) from nation{' where ' + where if where else ''}"
    return f"(select z.*, explode(z.ks) as k from (select {cols}, ({keys}) as ks from {table}) z)"


def _exploded(name: str, table: str, where: str) -> str:
    """The portable text with ``table cross join nation k`` as a derived table with column k."""
    out = FIXTURE_SQL[name].replace(f"{table} cross join nation k", f"{_with_keys(table, where)} x")
    return re.sub(r"\bk\.n_nationkey\b", "k", out)


SPARK_OVERRIDES: dict[str, str] = {
    "seats": re.sub(r"\bn_nationkey\b(?=\s*(as|%|,|\)))", "k", FIXTURE_SQL["seats"]).replace(
        "from part cross join nation", f"from {_with_keys('part', cols='p_partkey')}"),
    "route_stops": (
        "select x.route_id, x.k as stop_order, s.n_name as stop_name "
        f"from {_with_keys('nation', 'n_nationkey < 4', 'n_nationkey as route_id')} x "
        "join nation s on s.n_nationkey = (x.route_id + 3*x.k) % 25"),
    "cancel_policies": _exploded("cancel_policies", "supplier", "n_nationkey < 2"),
    "cancel_policy_rules": _exploded("cancel_policy_rules", "supplier", "n_nationkey < 8"),
    "payment_updates": _exploded("payment_updates", "events", "n_nationkey < 2"),
    "confirm_commands": _exploded("confirm_commands", "orders", "n_nationkey < 2"),
    "refund_commands": _exploded("refund_commands", "bookings", "n_nationkey < 2"),
    "commission_adjustments": _exploded("commission_adjustments", "commissions", "n_nationkey < 2"),
    "cancel_requests": (
        FIXTURE_SQL["cancel_requests"].replace("from bookings b join trips t on t.trip_id=b.trip_id cross join nation k",
                                               f"from {_with_keys('bookings', 'n_nationkey < 3')} b "
                                               "join trips t on t.trip_id=b.trip_id").replace("k.n_nationkey", "b.k")),
}


def _deps(name: str) -> list[str]:
    """Fixture views referenced by ``name``'s text (word match on the name)."""
    text = FIXTURE_SQL[name]
    return [d for d in FIXTURE_SQL
            if d != name and re.search(rf"\b(from|join)\s+{d}\b", text)]


def _closure(names) -> list[str]:
    """Names plus dependencies, dependencies first, in a stable order."""
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in _deps(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def _base_tables(views) -> tuple[str, ...]:
    """Base tables the given views read (only those are opened)."""
    text = " ".join(render(v, "spark") for v in views)
    return tuple(t for t in BASE_TABLES if re.search(rf"\b(from|join)\s+{t}\b", text))


def render(name: str, dialect: str) -> str:
    text = FIXTURE_SQL[name]
    if dialect == "spark":
        text = SPARK_OVERRIDES.get(name, text)
    for k, v in _tokens(dialect).items():
        text = text.replace(k, v)
    return text


def duckdb_prefix(*names: str) -> str:
    """``WITH`` clause defining the named fixture views for a DuckDB oracle."""
    parts = [f"{n} AS ({render(n, 'duckdb')})" for n in _closure(names)]
    return "WITH " + ",\n".join(parts) + "\n"


def build_fixtures(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Build the named fixture views over the base tables of ``sf_dir`` and
    return them as DataFrames (lazy; nothing runs).  Views are registered
    under names unique to this call, so the caller's own temp views are
    never replaced and concurrent calls (other scales) cannot mix."""
    needed = _closure(names)
    prefix = f"ff_{uuid.uuid4().hex[:10]}_"
    known = set(FIXTURE_SQL) | set(BASE_TABLES)

    def qualify(text: str) -> str:
        return re.sub(r"\b(from|join)(\s+)(\w+)\b",
                      lambda m: m.group(1) + m.group(2) + (prefix + m.group(3) if m.group(3) in known else m.group(3)),
                      text)

    base = load_tables(spark, sf_dir, _base_tables(needed))
    for n, df in base.items():
        df.createOrReplaceTempView(prefix + n)
    out: dict[str, DataFrame] = {}
    for n in needed:
        df = spark.sql(qualify(render(n, "spark")))
        df.createOrReplaceTempView(prefix + n)
        out[n] = df
    return out

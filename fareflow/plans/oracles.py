"""DuckDB oracles: for each registered query, SQL over the base tables.

Each text is the fixture ``WITH`` prefix (FIXTURES.md, DuckDB dialect) plus
generated from the Spark code.
"""

from __future__ import annotations

from ..functions.rules import EMAIL_PATTERN, PHONE_PATTERN
from ..sources.fixtures import WEBHOOK_TEST_SECRET, duckdb_prefix
from ..streaming.payments import hmac_pads

ORACLES: dict[str, str] = {}


def _join(prefix: str, body: str) -> str:
    """Append ``body`` to a ``WITH`` prefix; a body with its own ``with``
    clause continues the prefix's CTE list."""
    b = body.lstrip()
    if b[:15].lower() == "with recursive ":
        assert prefix.startswith("WITH ")
        return "WITH RECURSIVE " + prefix[5:].rstrip() + ",\n" + b[15:]
    if b[:5].lower() == "with ":
        return prefix.rstrip() + ",\n" + b[5:]
    return prefix + body


def oracle(name: str, *fixtures: str):
    def deco(body: str):
        ORACLES[name] = _join(duckdb_prefix(*fixtures), body)
        return body
    return deco


# Whole-day-dropping duration of the reference, in DuckDB.
_SECS = "abs(date_sub('second', t.departure_time, t.arrival_time))"
_DURATION = (f"cast(({_SECS} // 3600) % 24 as varchar) || ' hours, ' || "
             f"cast(({_SECS} // 60) % 60 as varchar) || ' minutes'")
_EMPTY = "({c} is null or cast({c} as varchar) in ('', '0'))"


def _nonempty(*cols):
    return " and ".join("not " + _EMPTY.format(c=c) for c in cols)


# A route's legs: pairs of its stops in travel order; a trip's offer: everything
# about a trip that does not depend on the request.
_LEGS = """
legs as (
  select a.route_id, a.stop_name as board_at, z.stop_name as leave_at
  from route_stops a, route_stops z where a.route_id = z.route_id and a.stop_order < z.stop_order),
free as (select bus_id, count(*) filter (where is_available) as n from seats group by bus_id),
offers as (
  select t.*, cast(t.departure_time as date) as day, c.class_name, v.model, o.company_name, x.origin_city, x.destination_city
  from trips t, buses v, bus_classes c, partners o, routes x
  where v.bus_id = t.bus_id and c.bus_class_id = v.bus_class_id and o.partner_id = t.partner_id and x.route_id = t.route_id)
"""

ORACLES["trip_search"] = _join(duckdb_prefix("search_requests", "trips", "routes", "route_stops", "buses", "bus_classes", "partners",
                                             "seats").rstrip("\n") + ",\n" + _LEGS.strip() + "\n", f"""
select q.request_id, q.from_stop, q.to_city as to_stop, l.board_at as route_from_stop, l.leave_at as route_to_stop,
       t.trip_id, t.origin_city, t.destination_city, t.departure_time, t.arrival_time, {_DURATION} as duration,
       cast({_SECS} // 60 as bigint) as duration_minutes, t.class_name as bus_class, t.model, t.company_name,
       t.base_price as price_adult, cast(t.base_price - 50 as decimal(12,2)) as price_child,
       cast(coalesce(f.n, 0) as bigint) as available_seats
from (select * from search_requests q where {_nonempty('q.from_stop', 'q.to_city', 'q.travel_date', 'q.bus_class')}) q
join legs l on (l.board_at, l.leave_at) = (q.from_stop, q.to_city)
join offers t on (t.route_id, t.day, t.class_name) = (l.route_id, q.travel_date, q.bus_class)
left join free f using (bus_id)
""")

ORACLES["unmatched_searches"] = _join(duckdb_prefix("search_requests", "trips", "routes", "route_stops", "buses", "bus_classes", "partners",
                                                    "seats").rstrip("\n") + ",\n" + _LEGS.strip() + "\n", f"""
with full_ as (select request_id, {_nonempty('from_stop', 'to_city', 'travel_date', 'bus_class')} as complete from search_requests),
served as (
  select request_id from search_requests
  where (from_stop, to_city, travel_date, bus_class) in (
    select (l.board_at, l.leave_at, o.day, o.class_name) from legs l, offers o where o.route_id = l.route_id))
select request_id, q.from_stop, q.to_city, q.travel_date, q.bus_class, if(complete, 'no_trips', 'missing_fields') as reject_reason
from search_requests q join full_ using (request_id)
where not complete or request_id in (select request_id from full_ except select request_id from served)
""")

oracle("bus_free_seats", "seats")("""
select bus_id, cast(count(*) filter (where is_available) as bigint) as available_seats
from seats group by bus_id
""")

# Seats a trip's bus has, less those its passengers have; a trip with a passenger
# whose seat is not known has no free seat.
oracle("available_seats", "trips", "buses", "seats", "bookings", "passengers")("""
with taken as (
  select k.trip_id, list(distinct p.seat_id) as ids, count(*) > count(p.seat_id) as unknown
  from passengers p, bookings k where k.booking_id = p.booking_id group by k.trip_id),
owned as (select bus_id, unnest(list({'id': seat_id, 'no': seat_number})) as seat from seats semi join buses using (bus_id) group by bus_id)
select trip_id, seat.id as seat_id, seat.no as seat_number
from owned join trips using (bus_id) left join taken using (trip_id)
where taken.trip_id is null or not (unknown or list_contains(ids, seat.id))
""")

oracle("double_booked_seats", "bookings", "passengers")("""
select b.trip_id, p.seat_id, count(*) as holders, count(distinct b.booking_id) as bookings
from bookings b join passengers p on p.booking_id = b.booking_id
where p.seat_id is not null
group by b.trip_id, p.seat_id having count(*) > 1
""")


# ---------------------------------------------------------------------------
# Read side
# ---------------------------------------------------------------------------
AS_OF = "timestamp '1998-08-02 12:00:00'"
_M = "decimal(18,2)"

oracle("booking_history", "users", "bookings", "trips", "routes", "buses", "bus_classes", "partners")("""
with offered as (
  select trip_id, departure_time, arrival_time, base_price,
         (select origin_city from routes x where x.route_id = trips.route_id) as origin_city,
         (select destination_city from routes x where x.route_id = trips.route_id) as destination_city,
         (select class_name from bus_classes c, buses v where v.bus_id = trips.bus_id and c.bus_class_id = v.bus_class_id) as bus_class,
         (select company_name from partners o where o.partner_id = trips.partner_id) as company_name
  from trips
  where exists (from routes x where x.route_id = trips.route_id) and exists (from partners o where o.partner_id = trips.partner_id)
    and exists (from bus_classes c, buses v where v.bus_id = trips.bus_id and c.bus_class_id = v.bus_class_id)),
per_user as (
  select user_id, count(*) as booking_count from bookings where trip_id in (select trip_id from offered) group by user_id)
select n.booking_count, h.user_id, h.full_name, k.booking_id, k.booking_status, s.*
from per_user n join users h using (user_id) join bookings k using (user_id) join offered s using (trip_id)
""")

oracle("booking_contacts", "bookings", "users")("""
with known as (select user_id, {'phone': phone_number, 'name': full_name} as who from users),
asked as (select booking_id, user_id, total_price from bookings where user_id in (select user_id from known))
select booking_id, user_id, who.phone as phone_number, who.name as full_name, total_price from asked natural join known
""")

oracle("default_cancel_policy", "trips", "cancel_policies")("""
select t.trip_id, t.partner_id,
       (select min(cp.cancel_policy_id) from cancel_policies cp
         where cp.partner_id = t.partner_id and cp.is_default = true and cp.is_active = true) as cancel_policy_id,
       case when not exists (select 1 from cancel_policies cp where cp.partner_id = t.partner_id
                             and cp.is_default = true and cp.is_active = true)
            then 'no_default_policy' end as reject_reason
from trips t
""")

oracle("latest_device_token", "user_device_tokens")("""
select user_id, fcm_token, device_type, created_at from (
  select *, row_number() over (partition by user_id order by created_at desc, fcm_token desc, device_type desc) as rn
  from user_device_tokens) x
where rn = 1 and fcm_token is not null and fcm_token not in ('', '0')
""")

oracle("faq_list", "faqs")("""
select faq_id as id, category, question, answer from faqs where is_active = true order by category asc, faq_id asc
""")

oracle("faq_category_counts", "faqs")("""
select category, count(*) as count from faqs where is_active = true group by category order by category asc
""")

oracle("filter_listing", "commissions")("""
select * from commissions
where status = 'Pending' and created_at >= '1995-03-01' and created_at <= '1996-12-31'
order by created_at desc
""")

_SUMMARY = """
v_commission_summary as (
  select c.commission_id, c.booking_id, c.partner_id, c.booking_amount, c.commission_amount, c.partner_revenue,
         c.status, c.created_at, b.user_id, b.booking_status, p.company_name
  from commissions c join bookings b on b.booking_id = c.booking_id join partners p on p.partner_id = c.partner_id)
"""
_LISTING_WHERE = "status = 'Paid' and created_at >= '1994-01-01' and created_at <= '1997-06-30'"


def _with_extra(extra: str, *fixtures: str):
    """Fixture prefix followed by one more CTE (an assumed view body)."""
    def deco(name: str, body: str):
        ORACLES[name] = _join(duckdb_prefix(*fixtures).rstrip("\n") + ",\n" + extra.strip() + "\n", body)
    return deco


_with_extra(_SUMMARY, "commissions", "bookings", "partners")("partner_commissions", f"""
select * from v_commission_summary where {_LISTING_WHERE} order by created_at desc
""")

_with_extra(_SUMMARY, "commissions", "bookings", "partners")("partner_commission_totals", f"""
select p.partner_id,
       count(s.commission_id) as count,
       cast(coalesce(sum(s.commission_amount), 0) as {_M}) as total_commission,
       cast(coalesce(sum(s.partner_revenue), 0) as {_M}) as total_partner_revenue
from partners p left join (select * from v_commission_summary where {_LISTING_WHERE}) s on s.partner_id = p.partner_id
group by p.partner_id
""")

_MONTH_STATS = f"""
month_stats as (
  select partner_id, y as year, m as month, count(*) as total_bookings,
         count(*) filter (where status = 'Pending') as pending_count, count(*) filter (where status = 'Paid') as paid_count,
         cast(sum(booking_amount) as {_M}) as total_revenue, cast(sum(partner_revenue) as {_M}) as total_partner_revenue,
         cast(sum(commission_amount) as {_M}) as total_commission,
         cast(coalesce(sum(commission_amount) filter (where status = 'Pending'), 0) as {_M}) as pending_amount,
         cast(coalesce(sum(commission_amount) filter (where status = 'Paid'), 0) as {_M}) as paid_amount
  from (select *, cast(year(created_at) as integer) as y, cast(month(created_at) as integer) as m from commissions) dated
  group by all)
"""
_with_extra(_MONTH_STATS.replace("group by all", "group by partner_id, y, m"), "commissions")(
    "partner_month_stats", "select *, concat_ws('-', year, month) as period from month_stats")
_with_extra(_MONTH_STATS.replace("group by all", "group by partner_id, y, m"), "commissions", "stats_requests")("partner_stats_for", """
select r.partner_id, r.year, r.month, concat_ws('-', r.year, r.month) as period, s.* exclude (partner_id, year, month)
       replace (coalesce(s.total_bookings, 0) as total_bookings, coalesce(s.pending_count, 0) as pending_count,
                coalesce(s.paid_count, 0) as paid_count)
from stats_requests r left join month_stats s on (s.partner_id, s.year, s.month) = (r.partner_id, r.year, r.month)
""")

_with_extra(_SUMMARY, "commissions", "bookings", "partners", "listing_requests")("partner_listing", f"""
select q.request_id, q.partner_id, s.commission_id, s.booking_id, s.commission_amount, s.partner_revenue, s.status, s.created_at,
       count(*) over r as count, cast(sum(s.commission_amount) over r as {_M}) as total_commission,
       cast(sum(s.partner_revenue) over r as {_M}) as total_partner_revenue
from listing_requests q join v_commission_summary s on s.partner_id = q.partner_id and trim(q.status) in ('', s.status)
where s.created_at >= coalesce(q.ts_from, timestamp '0001-01-01') and s.created_at <= coalesce(q.ts_to, timestamp '9999-12-31')
window r as (partition by q.request_id)
""")

oracle("sink_batches", "refund_transactions")("""
select refund_id, booking_id, refund_status, created_at, cast(refund_id % 3 as integer) as batch_id from refund_transactions
""")
oracle("sink_appends", "refund_transactions")("select refund_id, booking_id, refund_status, created_at from refund_transactions")
oracle("sink_json", "users")("select *, (select count(*) from users) as count from users")

_LEAD = r"regexp_extract(s, '^\s*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1)"
oracle("lenient_casts", "awkward_numbers")(rf"""
select row_id,
       case when s is null or {_LEAD} = '' then 0
            when regexp_full_match({_LEAD}, '[+-]?[0-9]+')
            then cast(least(greatest(try_cast(ltrim({_LEAD}, '+') as hugeint), -9223372036854775808::hugeint), 9223372036854775807::hugeint) as bigint)
            when cast({_LEAD} as double) >= 9.223372036854775807e18 then 9223372036854775807
            when cast({_LEAD} as double) <= -9.223372036854775807e18 then -9223372036854775808
            else cast(trunc(cast({_LEAD} as double)) as bigint) end as as_int,
       case when s is null or {_LEAD} = '' then cast(0 as decimal(12,2)) else try_cast({_LEAD} as decimal(12,2)) end as as_price,
       coalesce(regexp_full_match(s, '\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*') and try_cast(trim(s) as double) >= 1, false) as positive
from awkward_numbers
""")

oracle("merge_payload", "payment_updates")("""
select command_id, cast(booking_id as varchar) as booking_id, payment_status as status,
       coalesce(nullif(payment_method, ''), 'push') as channel, nullif(transaction_id, '') as tx,
       cast(3 + (transaction_id <> '')::int as integer) as n_keys
from payment_updates
""")

for _mode, _held in (("not_exists", ""), ("active", " and ps.passenger_status is distinct from 'Cancelled'")):
    oracle(f"available_seats_{_mode}", "trips", "buses", "seats", "bookings", "passengers")(f"""
    select t.trip_id, s.seat_id, s.seat_number
    from trips t join seats s on s.bus_id = t.bus_id and s.bus_id in (select bus_id from buses)
    where not exists (from bookings k join passengers ps using (booking_id) where k.trip_id = t.trip_id and ps.seat_id = s.seat_id{_held})
    """)

oracle("daily_commission_summary", "commissions")(f"""
select cast(d.day as date) as commission_date,
       coalesce(dc.total_bookings, 0) as total_bookings,
       cast(coalesce(dc.total_revenue, 0) as {_M}) as total_revenue,
       cast(coalesce(dc.total_commission, 0) as {_M}) as total_commission
from (select unnest(generate_series(min(cast(created_at as date)), max(cast(created_at as date)), interval 1 day)) as day
      from commissions) d
left join (select cast(created_at as date) as commission_date, count(*) as total_bookings,
                  sum(booking_amount) as total_revenue, sum(commission_amount) as total_commission
           from commissions group by 1) dc on dc.commission_date = cast(d.day as date)
""")

_with_extra(_SUMMARY, "commissions", "bookings", "partners")("commission_by_booking", """
select b.booking_id, s.commission_id is not null as found, s.commission_id, s.partner_id, s.commission_amount,
       s.partner_revenue, s.status
from bookings b
left join (select *, row_number() over (partition by booking_id order by commission_id) as rn
           from v_commission_summary) s on s.booking_id = b.booking_id and s.rn = 1
""")

oracle("refund_commission_report", "commissions", "refund_transactions")("""
select r.refund_id, r.booking_id, r.refund_status, r.created_at, c.commission_id, c.partner_id,
       c.commission_amount, c.partner_revenue, c.status as commission_status, count(*) over () as count
from refund_transactions r join commissions c on c.booking_id = r.booking_id
order by r.created_at desc
""")

_DETAILS = """
v_refund_details as (
  select r.refund_id, r.booking_id, r.refund_status, r.created_at, b.user_id, b.total_price, b.payment_status,
         u.full_name, u.email, u.phone_number
  from refund_transactions r join bookings b on b.booking_id = r.booking_id join users u on u.user_id = b.user_id)
"""

_with_extra(_DETAILS, "refund_transactions", "bookings", "users")("refund_listing", """
select *, count(*) over () as count from v_refund_details
where refund_status = 'Pending' and created_at <= '1996-06-30'
order by created_at desc
""")

_with_extra(_DETAILS, "refund_transactions", "bookings", "users")("refund_by_booking", """
select b.booking_id, d.refund_id is not null as found, d.refund_id, d.refund_status, d.created_at
from bookings b
left join (select *, row_number() over (partition by booking_id order by refund_id) as rn
           from v_refund_details) d on d.booking_id = b.booking_id and d.rn = 1
""")

_K1_WINNERS = """
items as (select distinct command_id, trim(coalesce(notes, '')) as new_notes, unnest(commission_ids) as commission_id
          from commission_commands where len(commission_ids) > 0),
winners as (
  select i.commission_id, i.command_id, i.new_notes, c.notes as old_notes,
         row_number() over (partition by i.commission_id order by i.command_id) as rn
  from items i join commissions c on c.commission_id = i.commission_id
  where c.status = 'Pending' and i.commission_id is not null)
"""

_with_extra(_K1_WINNERS, "commissions", "commission_commands")("mark_commissions_paid", """
select k.command_id,
       case when k.commission_ids is null or len(k.commission_ids) = 0 then null
            else (select count(*) from winners w where w.command_id = k.command_id and w.rn = 1) end as updated_count,
       case when k.commission_ids is null or len(k.commission_ids) = 0 then 'commission_ids_required' end as reject_reason
from commission_commands k
""")

_with_extra(_K1_WINNERS, "commissions", "commission_commands")("mark_commissions_paid_rows", f"""
select commission_id, command_id, 'Paid' as status, {AS_OF} as payment_date,
       coalesce(nullif(new_notes, ''), old_notes) as notes
from winners where rn = 1
""")

oracle("recalculate_commissions", "commissions", "commission_adjustments")("""
select command_id, booking_id, commission_id, reject_reason,
       case when reject_reason is null then new_amount end as booking_amount,
       case when reject_reason is null then new_comm end as commission_amount,
       case when reject_reason is null then cast(new_amount - new_comm as decimal(12,2)) end as partner_revenue
from (
  select a.command_id, a.booking_id, c.commission_id, cast(a.new_amount as decimal(12,2)) as new_amount,
         case when a.booking_id <= 0 or a.new_amount <= 0 then 'booking_id_and_new_amount_required'
              when c.commission_id is null then 'commission_not_found'
              when c.booking_amount = 0 then 'zero_booking_amount' end as reject_reason,
         -- half-up rounding of new * commission / booking in integer cents
         cast(cast((2 * cast(a.new_amount * 100 as hugeint) * cast(c.commission_amount * 100 as hugeint)
                     + cast(c.booking_amount * 100 as hugeint))
                    // (2 * nullif(cast(c.booking_amount * 100 as hugeint), 0)) as decimal(18,0)) * 0.01
              as decimal(12,2)) as new_comm
  from commission_adjustments a left join commissions c on c.booking_id = a.booking_id) x
""")

ORACLES["recalculate_commissions_rows"] = f"""
select commission_id, arg_max(booking_amount, command_id) as booking_amount, arg_max(commission_amount, command_id) as commission_amount,
       arg_max(partner_revenue, command_id) as partner_revenue
from ({ORACLES["recalculate_commissions"]}) where reject_reason is null group by commission_id
"""

_REFUND_METHODS = "('Bank Transfer', 'Kareemi', 'Cash', 'Same as Original')"
_PROCESSING_NOTE = "'جاري معالجة طلب الاسترداد. سيتم التحويل خلال 3-5 أيام عمل.'"

oracle("process_refunds", "refund_transactions", "refund_commands")(f"""
with cmd as (
  select command_id, refund_id, trim(coalesce(refund_method, '')) as refund_method, employee_id,
         case when refund_id <= 0 or trim(coalesce(refund_method, '')) = '' then 'refund_id_and_method_required'
              when trim(coalesce(refund_method, '')) not in {_REFUND_METHODS} then 'invalid_refund_method' end as invalid
  from refund_commands),
ranked as (
  select c.*, r.refund_status as old_status,
         row_number() over (partition by c.refund_id order by (c.invalid is not null), c.command_id) as rn
  from cmd c left join refund_transactions r on r.refund_id = c.refund_id),
decided as (
  select *, coalesce(invalid, case when old_status is null or old_status <> 'Pending' or rn > 1
                                   then 'not_found_or_already_processed' end) as reject_reason
  from ranked)
select refund_id, refund_method, reject_reason,
       case when reject_reason is null then 'Processing' end as refund_status,
       case when reject_reason is null then '' end as bank_name,
       case when reject_reason is null then '' end as bank_account,
       case when reject_reason is null then '' end as account_holder_name,
       case when reject_reason is null then '' end as kareemi_number,
       case when reject_reason is null then cast(employee_id as bigint) end as processed_by,
       case when reject_reason is null then {AS_OF} end as processing_started_at,
       case when reject_reason is null then '' end as internal_notes,
       case when reject_reason is null then {_PROCESSING_NOTE} end as customer_notes
from decided
""")

oracle("complete_refunds", "refund_transactions", "refund_commands")(f"""
with ranked as (
  select c.refund_id, trim(coalesce(c.refund_reference, '')) as refund_reference, c.employee_id,
         case when c.refund_id <= 0 then 'refund_id_required' end as invalid, r.refund_status as old_status,
         row_number() over (partition by c.refund_id order by c.command_id) as rn
  from refund_commands c left join refund_transactions r on r.refund_id = c.refund_id),
decided as (
  select *, coalesce(invalid, case when old_status is null or old_status <> 'Processing' or rn > 1
                                   then 'not_found_or_not_processing' end) as reject_reason
  from ranked)
select refund_id, reject_reason,
       case when reject_reason is null then 'Completed' end as refund_status,
       case when reject_reason is null then refund_reference end as refund_reference,
       case when reject_reason is null then cast(employee_id as bigint) end as completed_by,
       case when reject_reason is null then {AS_OF} end as completed_at,
       case when reject_reason is null then '' end as internal_notes,
       case when reject_reason is null then 'تم إرجاع المبلغ بنجاح.' ||
            case when refund_reference <> '' then ' رقم المعاملة: ' || refund_reference else '' end end as customer_notes
from decided
""")


# ---------------------------------------------------------------------------
# Accounts, contact quality, tokens
# ---------------------------------------------------------------------------

_EMAIL_RE = EMAIL_PATTERN.replace("'", "''")


def _empty(c):
    return _EMPTY.format(c=c)


oracle("resolve_identifiers", "identifier_lookups", "users")(f"""
select l.lookup_id, l.identifier,
       case when not {_empty('l.identifier')} then m.user_id end as user_id,
       case when {_empty('l.identifier')} then 'identifier_required'
            when m.user_id is null then 'user_not_found' end as reject_reason
from identifier_lookups l
left join (select l2.lookup_id, min(u.user_id) as user_id from identifier_lookups l2
           join users u on u.email = l2.identifier or u.phone_number = l2.identifier group by l2.lookup_id) m
  on m.lookup_id = l.lookup_id
""")

oracle("duplicate_accounts", "users")("""
select email as key_value, count(*) as n_users, min(user_id) as first_user_id, max(user_id) as last_user_id,
       'email' as key_kind
from users where email is not null and trim(email) <> '' group by email having count(*) > 1
union all
select phone_number, count(*), min(user_id), max(user_id), 'phone'
from users where phone_number is not null and trim(phone_number) <> '' group by phone_number having count(*) > 1
""")

# Sequential fold of the reference, one registration per recursion step.
oracle("admit_accounts", "registrations", "users")(f"""
with recursive cand as (
  select registration_id, trim(coalesce(full_name, '')) as full_name, trim(coalesce(email, '')) as email,
         trim(coalesce(phone_number, '')) as phone_number, password,
         row_number() over (order by registration_id) as k
  from registrations),
pre as (
  select c.*,
         case when {_empty('c.full_name')} or {_empty('c.email')} or {_empty('c.phone_number')}
                   or {_empty('c.password')} then 'missing_fields'
              when exists (select 1 from users u where u.email = c.email or u.phone_number = c.phone_number)
              then 'already_in_use' end as pre_reason
  from cand c),
walk(k, used_e, used_p, acc) as (
  select 0::bigint, []::varchar[], []::varchar[], false
  union all
  select p.k,
         case when ok then list_append(w.used_e, p.email) else w.used_e end,
         case when ok then list_append(w.used_p, p.phone_number) else w.used_p end,
         ok
  from walk w join (select *, null as _ from pre) p on p.k = w.k + 1,
       lateral (select p.pre_reason is null and not list_contains(w.used_e, p.email)
                       and not list_contains(w.used_p, p.phone_number) as ok) o),
accepted as (
  select p.registration_id,
         (select coalesce(max(user_id), 0) from users) + row_number() over (order by p.k) as user_id
  from pre p join walk w on w.k = p.k where w.acc)
select p.registration_id, p.full_name, p.email, p.phone_number,
       case when a.user_id is not null then 'Customer' end as user_type,
       case when a.user_id is not null then 'Unverified' end as account_status,
       a.user_id,
       case when p.pre_reason = 'missing_fields' then 'missing_fields'
            when a.user_id is null then 'already_in_use' end as reject_reason
from pre p left join accepted a on a.registration_id = p.registration_id
""")

oracle("apply_phone_updates", "registrations", "users")("""
select r.registration_id as user_id, trim(coalesce(r.phone_number, '')) as phone,
       case when r.registration_id <= 0 then 'invalid_user_id'
            when u.user_id is null then 'user_not_found'
            when trim(coalesce(r.phone_number, '')) = '' then 'nothing_to_update' end as reject_reason,
       case when r.registration_id > 0 and u.user_id is not null and trim(coalesce(r.phone_number, '')) <> ''
            then trim(r.phone_number) end as user_phone
from registrations r left join users u on u.user_id = r.registration_id
""")

oracle("apply_phone_updates_state", "registrations", "users")("""
select u.user_id, u.full_name, u.email,
       coalesce((select max_by(trim(r.phone_number), r.phone_number) from registrations r
                 where r.registration_id = u.user_id and r.registration_id > 0
                   and trim(coalesce(r.phone_number, '')) <> ''),
                u.phone_number) as phone_number,
       u.user_type
from users u
""")

oracle("upsert_device_tokens", "user_device_tokens")("""
with new as (
  select user_id, trim(coalesce(fcm_token, '')) as fcm_token,
         case when trim(coalesce(device_type, 'android')) in ('android', 'ios', 'web')
              then trim(coalesce(device_type, 'android')) else 'android' end as device_type, created_at
  from user_device_tokens where created_at >= timestamp '2024-01-20 00:00:00'),
latest as (
  select user_id, device_type, fcm_token, created_at from (
    select *, row_number() over (partition by user_id, device_type order by created_at desc, fcm_token desc) as rn
    from new where fcm_token not in ('', '0')) x where rn = 1)
select t.user_id, t.fcm_token, t.device_type, t.created_at
from user_device_tokens t
where t.created_at < timestamp '2024-01-20 00:00:00'
  and not exists (select 1 from latest l where l.user_id = t.user_id and l.device_type = t.device_type)
union all
select user_id, fcm_token, device_type, created_at from latest
""")

_Q_CHECKS = f"""
  select user_id,
         coalesce(not (full_name is null or full_name = ''), false) as ok_name,
         coalesce(not {_empty('email')} and regexp_full_match(email, '{_EMAIL_RE}')
                  and length(split_part(email, '@', 1)) <= 64 and length(email) <= 320, false) as ok_email,
         coalesce(not {_empty('phone_number')}
                  and regexp_full_match(regexp_replace(phone_number, '\\s+', '', 'g'), '{PHONE_PATTERN}'), false) as ok_phone
  from users"""

oracle("quality_report", "users")(f"""
with q as ({_Q_CHECKS})
select user_id,
       list_filter([case when not ok_name then 'full_name' end, case when not ok_email then 'email' end,
                    case when not ok_phone then 'phone_number' end], lambda x: x is not null) as error_fields,
       '{{' || array_to_string(list_filter([
           case when not ok_name then '"full_name":"full_name is required"' end,
           case when not ok_email then '"email":"email is missing or invalid"' end,
           case when not ok_phone then '"phone_number":"phone_number is missing or invalid"' end],
           lambda x: x is not null), ',') || '}}' as errors,
       case when not ok_name then 'full_name is required'
            when not ok_email then 'email is missing or invalid'
            when not ok_phone then 'phone_number is missing or invalid' end as first_error,
       not (ok_name and ok_email and ok_phone) as has_errors
from q
""")

oracle("quality_summary", "users")(f"""
with q as ({_Q_CHECKS})
select count(*) as rows_checked, 'full_name' as field, count(*) filter (where not ok_name) as violations from q
union all select count(*), 'email', count(*) filter (where not ok_email) from q
union all select count(*), 'phone_number', count(*) filter (where not ok_phone) from q
""")


# ---------------------------------------------------------------------------
# Rules, guarded updates, notifications, scalar functions
# ---------------------------------------------------------------------------
_HOURS = "date_sub('second', c.requested_at, bt.departure_time) / 3600.0"
_BT = "(select b.*, t.departure_time from bookings b join trips t on t.trip_id = b.trip_id)"
_RULE_JOIN = """
  join cancel_policy_rules r on r.cancel_policy_id = q.cancel_policy_id and r.is_active
   and r.min_hours_before_departure <= q.hours
   and (r.max_hours_before_departure is null or q.hours < r.max_hours_before_departure)"""
_REFUND = "greatest(cast(0 as decimal(12,2)), cast(round(q.total_price * m.refund_percentage * 0.01 - m.cancellation_fee, 2) as decimal(12,2)))"

oracle("match_cancel_rule", "cancel_requests", "bookings", "trips", "cancel_policy_rules")(f"""
with q as (
  select c.booking_id, c.requested_at, bt.cancel_policy_id, {_HOURS} as hours
  from cancel_requests c join {_BT} bt on bt.booking_id = c.booking_id),
m as (
  select q.booking_id, q.requested_at, r.cancel_policy_rule_id, r.refund_percentage, r.cancellation_fee,
         row_number() over (partition by q.booking_id, q.requested_at
                            order by r.min_hours_before_departure desc, r.cancel_policy_rule_id) as rn
  from q {_RULE_JOIN})
select q.booking_id, q.requested_at, q.cancel_policy_id, q.hours as hours_before_departure,
       m.cancel_policy_rule_id, m.refund_percentage, m.cancellation_fee
from q left join m on m.booking_id = q.booking_id and m.requested_at = q.requested_at and m.rn = 1
""")


def _cancel_cte(looks_up: str) -> str:
    return f"""
with q as (
  select c.booking_id, c.command_id, c.requested_at, coalesce(c.reason, 'Customer request') as reason, bt.booking_id is not null as found,
         bt.total_price, bt.booking_status, bt.payment_status, bt.cancel_policy_id, {_HOURS} as hours,
         {looks_up} as looks_up
  from cancel_requests c left join {_BT} bt on bt.booking_id = c.booking_id),
m as (
  select q.booking_id, q.requested_at, r.cancel_policy_rule_id, r.refund_percentage, r.cancellation_fee,
         row_number() over (partition by q.booking_id, q.requested_at
                            order by r.min_hours_before_departure desc, r.cancel_policy_rule_id) as rn
  from q {_RULE_JOIN}
  where q.found and q.looks_up),
qm as (
  select q.*, m.cancel_policy_rule_id as rule_id, m.refund_percentage as pct, m.cancellation_fee as rule_fee,
         case when q.looks_up and m.cancel_policy_rule_id is not null then {_REFUND} else cast(0 as decimal(12,2)) end as refund
  from q left join m on m.booking_id = q.booking_id and m.requested_at = q.requested_at and m.rn = 1)"""


_QUOTE_CTE = _cancel_cte("coalesce(bt.payment_status, 'Unpaid') <> 'Unpaid'")
_QUOTE_SELECT = """
select booking_id, requested_at, reason_code as reject_reason,
       case when ok then total_price end as total_price,
       case when ok then hours end as hours_before_departure,
       case when ok then cast(coalesce(case when looks_up then rule_id end, 0) as bigint) end as cancel_policy_rule_id,
       case when ok then cast(coalesce(case when looks_up then pct end, 0) as decimal(5,2)) end as refund_percentage,
       case when ok then cast(case when not looks_up then 0 when rule_id is not null then rule_fee else total_price end
                              as decimal(12,2)) end as cancellation_fee,
       case when ok then refund end as refund_amount,
       case when ok then cast(greatest(0, total_price - refund) as decimal(12,2)) end as non_refundable_part
from (select *, case when booking_id <= 0 then 'invalid_booking_id' when not found then 'booking_not_found'
                     when booking_status = 'Cancelled' then 'already_cancelled' end as reason_code,
             not (booking_id <= 0 or not found or coalesce(booking_status = 'Cancelled', false)) as ok
      from qm) x
"""

oracle("cancellation_quote", "cancel_requests", "bookings", "trips", "cancel_policy_rules")(_QUOTE_CTE + _QUOTE_SELECT)

_CONFIRM_CTE = _cancel_cte("(bt.payment_status is null or bt.payment_status <> 'Unpaid')") + """,
dec as (
  select qm.*, cast(case when looks_up and rule_id is not null then rule_fee else total_price end as decimal(12,2)) as fee,
         cast(case when looks_up and rule_id is not null then pct else 0 end as decimal(5,2)) as pct2,
         cast(case when looks_up and rule_id is not null then rule_id else 0 end as bigint) as rid,
         case when not found or booking_status = 'Cancelled'
                   or row_number() over (partition by booking_id order by requested_at, command_id) > 1
              then 'invalid_or_already_cancelled' end as reject_reason
  from qm)"""

oracle("apply_cancellations", "cancel_requests", "bookings", "trips", "cancel_policy_rules")(_CONFIRM_CTE + """
select booking_id, requested_at, reject_reason, case when reject_reason is null then refund end as refund_amount from dec
""")

oracle("apply_cancellations_bookings", "cancel_requests", "bookings", "trips", "cancel_policy_rules")(_CONFIRM_CTE + """
select booking_id, 'Cancelled' as booking_status,
       case when payment_status = 'Paid' then 'Refunded' else payment_status end as payment_status,
       reason as cancel_reason, requested_at as cancel_timestamp
from dec where reject_reason is null
""")

oracle("apply_cancellations_ledger", "cancel_requests", "bookings", "trips", "cancel_policy_rules")(_CONFIRM_CTE + """
select booking_id, cancel_policy_id, rid as cancel_policy_rule_id, pct2 as refund_percentage, fee as cancellation_fee,
       refund as refund_amount, reason, hours as hours_before_departure
from dec where reject_reason is null
""")

oracle("apply_cancellations_freed_seats", "cancel_requests", "bookings", "trips", "cancel_policy_rules",
       "passengers")(_CONFIRM_CTE + """
select distinct p.seat_id, true as is_available
from passengers p join dec d on d.booking_id = p.booking_id
where d.reject_reason is null and p.seat_id is not null
""")

oracle("refund_fee_quote", "refund_transactions", "bookings", "trips", "cancel_policy_rules")(
    (_QUOTE_CTE + _QUOTE_SELECT).replace("from cancel_requests c",
                                         "from (select refund_id as command_id, booking_id, created_at as requested_at, cast(null as varchar) as reason "
                                         "from refund_transactions) c")
    .replace("\nselect booking_id, requested_at, reason_code as reject_reason,",
             ",\nquote as (select booking_id, requested_at, reason_code as reject_reason,", 1)
    .rstrip() + """)
select q.booking_id, q.requested_at, q.reject_reason, b.total_price,
       cast(b.total_price - q.refund_amount as decimal(12,2)) as refund_fee,
       cast(b.total_price - cast(b.total_price - q.refund_amount as decimal(12,2)) as decimal(12,2)) as net_refund
from quote q left join bookings b on b.booking_id = q.booking_id
""")

_PAY_CTE = """
with u as (
  select command_id, booking_id, ts, trim(coalesce(payment_status, '')) as status,
         trim(coalesce(payment_method, '')) as method, trim(coalesce(transaction_id, '')) as txn
  from payment_updates),
d as (
  select u.*, case when u.booking_id <= 0 or u.status = '' then 'booking_id_and_status_required'
                   when u.status not in ('Unpaid', 'Paid', 'Refunded') then 'invalid_payment_status'
                   when u.method <> '' and u.method not in ('Electronic', 'Cash', 'Kareemi', 'Transfer') then 'invalid_payment_method'
                   when not exists (select 1 from bookings b where b.booking_id = u.booking_id) then 'booking_not_found'
              end as reject_reason
  from u)"""

oracle("apply_payment_updates", "bookings", "payment_updates")(_PAY_CTE + """
select booking_id, ts, status, method, txn, reject_reason from d
""")

oracle("apply_payment_updates_state", "bookings", "payment_updates")(_PAY_CTE + """,
last as (
  select booking_id, arg_max(status, (ts, command_id)) as status,
         arg_max(method, (ts, command_id)) filter (where method <> '') as method,
         arg_max(txn, (ts, command_id)) filter (where txn <> '') as txn,
         arg_max(ts, (ts, command_id)) filter (where status = 'Paid') as paid_at
  from d where reject_reason is null group by booking_id)
select b.booking_id, l.status as payment_status, coalesce(l.method, b.payment_method) as payment_method,
       coalesce(l.paid_at, b.payment_timestamp) as payment_timestamp,
       coalesce(l.txn, b.gateway_transaction_id) as gateway_transaction_id
from bookings b join last l on l.booking_id = b.booking_id
""")

_CONF_CTE = """
with c as (
  select command_id, booking_id, employee_id, ts, ip_address,
         trim(coalesce(payment_status, '')) as force, trim(coalesce(notes, '')) as notes2,
         case when booking_id <= 0 then 'invalid_booking_id'
              when trim(coalesce(payment_status, '')) <> ''
               and trim(coalesce(payment_status, '')) not in ('Unpaid', 'Paid', 'Refunded') then 'invalid_payment_status'
         end as invalid
  from confirm_commands),
r as (
  select c.*, row_number() over (partition by c.booking_id
                                 order by (c.invalid is not null), c.ts, c.command_id) as rn,
         bu.booking_id is not null as found, bu.booking_status, bu.payment_status
  from c left join (select b.* from bookings b join users u on u.user_id = b.user_id) bu on bu.booking_id = c.booking_id),
d as (
  select r.*, coalesce(invalid, case when not found then 'booking_not_found'
                                     when booking_status is null or booking_status <> 'Pending' or rn > 1
                                     then 'not_pending' end) as reject_reason,
         case when force <> '' then force else payment_status end as new_pay
  from r)"""

oracle("confirm_bookings", "bookings", "users", "confirm_commands")(_CONF_CTE + """
select booking_id, employee_id, reject_reason,
       case when reject_reason is null then 'Confirmed' end as booking_status,
       case when reject_reason is null then new_pay end as payment_status
from d
""")

oracle("confirm_bookings_audit", "bookings", "users", "confirm_commands")(_CONF_CTE + """
select booking_id, employee_id, 'CONFIRM_BOOKING' as action_type, booking_status as old_status,
       'Confirmed' as new_status,
       case when notes2 in ('', '0') then 'Payment Status: ' || coalesce(new_pay, '') else notes2 end as notes, ip_address
from d where reject_reason is null
""")

_PROOF_CTE = """
with p as (
  select command_id, ts, booking_id, actor_user_id, actor_user_type, trim(coalesce(transaction_id, '')) as txn,
         trim(coalesce(payment_method, '')) as method, trim(coalesce(note, '')) as note
  from payment_proofs),
d as (
  select p.*, case when p.booking_id <= 0 or p.txn in ('', '0') then 'booking_id_and_transaction_required'
                   when b.booking_id is null then 'booking_not_found'
                   when not coalesce(b.user_id = p.actor_user_id, false)
                        and not coalesce(p.actor_user_type in ('Employee', 'Admin'), false) then 'access_denied'
                   when b.payment_status = 'Paid' then 'already_paid'
                   when p.method <> '' and p.method not in ('Electronic', 'Cash', 'Kareemi', 'Transfer')
                   then 'invalid_payment_method' end as reject_reason
  from p left join bookings b on b.booking_id = p.booking_id)"""

oracle("submit_payment_proof", "bookings", "payment_proofs")(_PROOF_CTE + """
select booking_id, actor_user_id, txn, reject_reason from d
""")

oracle("submit_payment_proof_state", "bookings", "payment_proofs")(_PROOF_CTE + """,
last as (
  select booking_id, arg_max(txn, (ts, command_id)) as txn,
         arg_max(method, (ts, command_id)) filter (where method <> '') as method,
         arg_max(case when note in ('', '0') then 'Submitted by customer' else note end, (ts, command_id)) as note
  from d where reject_reason is null group by booking_id)
select b.booking_id, b.payment_status, l.txn as gateway_transaction_id,
       coalesce(l.method, b.payment_method) as payment_method, l.note as notes
from bookings b join last l on l.booking_id = b.booking_id
""")

_GREET = "'مرحبا ' || coalesce(x.full_name, '') || '، '"
oracle("notification_outbox", "bookings", "users", "payment_updates", "confirm_commands", "user_device_tokens")(
    _PAY_CTE + "," + _CONF_CTE.replace("with c as", "c as", 1).replace("\nd as (", "\nd2 as (") + f""",
changes as (
  select booking_id, status from d where reject_reason is null
  union all
  select booking_id, 'Confirmed' from d2 where reject_reason is null),
x as (
  select ch.booking_id, u.user_id, ch.status, u.phone_number, u.full_name, bk.total_price
  from changes ch join bookings bk on bk.booking_id = ch.booking_id join users u on u.user_id = bk.user_id),
tok as (
  select user_id, fcm_token from (
    select *, row_number() over (partition by user_id order by created_at desc, fcm_token desc, device_type desc) as rn
    from user_device_tokens) t where rn = 1 and fcm_token not in ('', '0')),
msg as (
  select x.booking_id, x.user_id, x.status, x.phone_number,
         case x.status when 'Unpaid' then 'تم إنشاء الحجز بنجاح' when 'Paid' then 'تم الدفع بنجاح'
                       when 'Refunded' then 'تم استرداد المبلغ' when 'Confirmed' then 'تم تأكيد الحجز' end as title,
         case x.status
           when 'Unpaid' then {_GREET} || 'تم حجز رحلتك رقم ' || cast(x.booking_id as varchar)
                || '. يرجى الدفع لإتمام التأكيد. المبلغ: ' || coalesce(cast(x.total_price as varchar), '')
           when 'Paid' then {_GREET} || 'تم استلام دفعة الحجز رقم ' || cast(x.booking_id as varchar)
                || ' بنجاح. نتمنى لك رحلة سعيدة!'
           when 'Refunded' then {_GREET} || 'تم استرداد مبلغ الحجز رقم ' || cast(x.booking_id as varchar) || '.'
           when 'Confirmed' then {_GREET} || 'تم تأكيد حجزك رقم ' || cast(x.booking_id as varchar)
                || ' بنجاح! نتمنى لك رحلة سعيدة.' end as body
  from x where x.status in ('Unpaid', 'Paid', 'Refunded', 'Confirmed'))
select booking_id, user_id, status, 'db' as channel, cast(null as varchar) as recipient, title, body from msg
union all
select booking_id, user_id, status, 'whatsapp',
       case when length(regexp_replace(phone_number, '[^0-9]', '', 'g')) = 9
                 and starts_with(regexp_replace(phone_number, '[^0-9]', '', 'g'), '7')
            then '967' || regexp_replace(phone_number, '[^0-9]', '', 'g')
            else regexp_replace(phone_number, '[^0-9]', '', 'g') end, title, body
from msg where phone_number is not null and phone_number not in ('', '0')
union all
select m.booking_id, m.user_id, m.status, 'push', t.fcm_token, m.title, m.body
from msg m join tok t on t.user_id = m.user_id
""")

oracle("trip_duration", "trips")(f"""
select t.trip_id, {_DURATION} as duration, cast({_SECS} // 60 as bigint) as duration_minutes from trips t
""")

oracle("minor_units", "bookings")("""
select booking_id, total_price, cast(trunc(cast(total_price as double) * 100) as bigint) as amount_minor,
       cast(total_price * 100 as bigint) as amount_minor_exact
from bookings
""")

oracle("contact_checks", "users")(f"""
with q as ({_Q_CHECKS.replace("select user_id,", "select user_id, phone_number,", 1)})
select user_id, ok_email as email_ok, ok_phone as phone_ok,
       case when length(regexp_replace(phone_number, '[^0-9]', '', 'g')) = 9
                 and starts_with(regexp_replace(phone_number, '[^0-9]', '', 'g'), '7')
            then '967' || regexp_replace(phone_number, '[^0-9]', '', 'g')
            else regexp_replace(phone_number, '[^0-9]', '', 'g') end as whatsapp_number,
       ok_name as name_ok
from q
""")


# ---------------------------------------------------------------------------
# Admission: booking requests
# ---------------------------------------------------------------------------
_INT = r"coalesce(try_cast(regexp_extract(json_extract_string(body, '$.{f}'), '^\s*([+-]?[0-9]+)', 1) as bigint), 0)"
_DEC = (r"(case when regexp_extract(json_extract_string(body, '$.{f}'), "
        r"'^\s*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1) is distinct from '' then "
        r"try_cast(regexp_extract(json_extract_string(body, '$.{f}'), "
        r"'^\s*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1) as decimal(12,2)) else 0 end)")
_REQ_CTE = f"""
with req as (
  select request_id, received_at, {_INT.format(f='user_id')} as user_id, {_INT.format(f='trip_id')} as trip_id,
         {_DEC.format(f='total_price')} as total_price,
         case when json_extract_string(body, '$.payment_method') is null then 'Cash'
              else trim(json_extract_string(body, '$.payment_method')) end as payment_method,
         case when json_type(json_extract(body, '$.passengers')) = 'ARRAY' then json_extract(body, '$.passengers')
              else '[]'::json end as pax
  from booking_requests_raw),
pax as (
  select request_id, i + 1 as passenger_no,
         json_extract_string(pax, '$[' || i || '].full_name') as full_name,
         coalesce(json_extract_string(pax, '$[' || i || '].id_number'), '') as id_number,
         trim(coalesce(json_extract_string(pax, '$[' || i || '].seat_code'), '')) as seat_code,
         json_extract_string(pax, '$[' || i || '].gender') as gender,
         json_extract_string(pax, '$[' || i || '].birth_date') as birth_date,
         json_extract_string(pax, '$[' || i || '].phone_number') as phone_number,
         json_extract_string(pax, '$[' || i || '].id_image') as id_image
  from (select request_id, pax, unnest(range(cast(json_array_length(pax) as bigint))) as i from req) x),
codes as (
  select p.request_id, r.trip_id, p.seat_code,
         (select s.seat_id from trips t join buses b on b.bus_id = t.bus_id join seats s on s.bus_id = b.bus_id
           where t.trip_id = r.trip_id and s.seat_number = p.seat_code) as seat_id
  from pax p join req r on r.request_id = p.request_id
  where p.seat_code not in ('', '0')),
per as (
  select r.request_id, count(c.seat_code) as n_codes, count(distinct c.seat_id) as n_found
  from req r left join codes c on c.request_id = r.request_id group by r.request_id),
chk as (
  select r.*, pol.cancel_policy_id,
         case when r.user_id <= 0 or r.trip_id <= 0 or json_array_length(r.pax) = 0 then 'missing_fields'
              when not exists (select 1 from trips t where t.trip_id = r.trip_id) then 'trip_not_found'
              when pol.cancel_policy_id is null then 'no_default_policy'
              when p.n_codes = 0 then 'no_seat_codes'
              when p.n_codes <> p.n_found then 'unknown_seats'
              when exists (select 1 from codes c join passengers ps on ps.seat_id = c.seat_id
                           join bookings bk on bk.booking_id = ps.booking_id and bk.trip_id = c.trip_id
                           where c.request_id = r.request_id) then 'already_booked'
              when r.payment_method not in ('Electronic', 'Cash', 'Kareemi', 'Transfer') then 'invalid_payment_method'
              when r.total_price is null then 'price_out_of_range'
         end as reject_reason
  from req r join per p on p.request_id = r.request_id
  left join (select t.trip_id, min(cp.cancel_policy_id) as cancel_policy_id from trips t
             join cancel_policies cp on cp.partner_id = t.partner_id and cp.is_default and cp.is_active
             group by t.trip_id) pol on pol.trip_id = r.trip_id)"""

oracle("parse_booking_requests", "booking_requests_raw")(_REQ_CTE.split(",\npax as (")[0] + """
select request_id, received_at, user_id, trip_id, total_price, payment_method,
       cast(json_array_length(pax) as integer) as n_passengers
from req
""")

oracle("expand_passengers", "booking_requests_raw", "trips", "buses", "seats")(
    _REQ_CTE.split(",\ncodes as (")[0] + """
select request_id, cast(passenger_no as integer) as passenger_no, full_name, id_number, seat_code, gender, birth_date,
       phone_number, id_image from pax
""")

oracle("resolve_seat_codes", "booking_requests_raw", "trips", "buses", "seats")(
    _REQ_CTE.split(",\nchk as (")[0] + """
select request_id, n_codes, n_found,
       case when n_codes = 0 then 'no_seat_codes' when n_codes <> n_found then 'unknown_seats' end as reject_reason
from per
""")

_ADMIT_FX = ("booking_requests_raw", "trips", "buses", "seats", "cancel_policies", "bookings", "passengers")

oracle("booking_request_checks", *_ADMIT_FX)(_REQ_CTE + """
select request_id, trip_id, cancel_policy_id, reject_reason from chk
""")

# Sequential fold per trip: the k-th surviving request of a trip is accepted
# when none of its seats is among the seats taken by steps 1..k-1.
_ADMIT_CTE = "with recursive " + _REQ_CTE.strip()[5:] + """,
cand as (
  select c.request_id, c.trip_id, c.received_at,
         row_number() over (partition by c.trip_id order by c.received_at, c.request_id) as k,
         (select list(distinct cd.seat_id) from codes cd where cd.request_id = c.request_id) as seats
  from chk c where c.reject_reason is null),
walk(trip_id, k, taken, acc) as (
  select distinct trip_id, 0::bigint, []::bigint[], false from cand
  union all
  select w.trip_id, c.k,
         case when not list_has_any(w.taken, c.seats) then list_concat(w.taken, c.seats) else w.taken end,
         not list_has_any(w.taken, c.seats)
  from walk w join cand c on c.trip_id = w.trip_id and c.k = w.k + 1),
won as (
  select c.request_id, (select coalesce(max(booking_id), 0) from bookings)
           + row_number() over (order by c.received_at, c.request_id) as booking_id
  from cand c join walk w on w.trip_id = c.trip_id and w.k = c.k where w.acc)"""

oracle("admit_bookings", *_ADMIT_FX)(_ADMIT_CTE + """
select c.request_id, c.trip_id, w.booking_id,
       coalesce(c.reject_reason, case when w.booking_id is null then 'already_booked' end) as reject_reason
from chk c left join won w on w.request_id = c.request_id
""")

oracle("admit_bookings_passengers", *_ADMIT_FX)(_ADMIT_CTE + """
select w.booking_id, cast(p.passenger_no as integer) as passenger_no, p.full_name, p.id_number,
       (select min(cd.seat_id) from codes cd where cd.request_id = p.request_id and cd.seat_code = p.seat_code) as seat_id,
       r.trip_id, p.gender, p.birth_date, p.phone_number, p.id_image, 'Active' as passenger_status
from won w join pax p on p.request_id = w.request_id join req r on r.request_id = w.request_id
""")


# ---------------------------------------------------------------------------
# Streams: payment webhooks, daily commissions
# ---------------------------------------------------------------------------

_IPAD, _OPAD = hmac_pads(WEBHOOK_TEST_SECRET)
_VERIFY_CTE = f"""
with parts as (
  select w.*, list_filter(list_transform(string_split(coalesce(sig_header, ''), ','),
                                         lambda p: [split_part(p, '=', 1),
                                                    case when strpos(p, '=') > 0 then substr(p, strpos(p, '=') + 1) end]),
                          lambda kv: kv[2] is not null) as kvs
  from webhooks_raw w),
hdr as (
  select *, list_transform(list_filter(kvs, lambda kv: trim(kv[1]) = 't'), lambda kv: trim(kv[2])) as ts_vals,
         list_transform(list_filter(kvs, lambda kv: trim(kv[1]) = 'v1'), lambda kv: trim(kv[2])) as sigs
  from parts),
v as (
  select event_id, received_at, payload,
         ts_vals[len(ts_vals)] as t_text,
         coalesce(try_cast(regexp_extract(ts_vals[len(ts_vals)], '^\\s*([+-]?[0-9]+)', 1) as bigint), 0) as t,
         sigs
  from hdr),
chk as (
  select *, case when payload is null or payload in ('', '0') then 'empty_request'
                 when t_text is null or len(sigs) = 0 then 'malformed_signature'
                 when abs(date_sub('second', timestamp '1970-01-01', received_at) - t) > 300 then 'rejected_late'
                 when not list_contains(sigs, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}')
                                              || encode(t_text || '.' || payload)))))
                 then 'bad_signature' end as reject_reason
  from v)"""

oracle("verify_payment_events", "webhooks_raw")(_VERIFY_CTE + """
select event_id, received_at, t, reject_reason is null as verified, reject_reason from chk
""")

_GATEWAY_CTE = _VERIFY_CTE + """,
pay as (
  select event_id, received_at, coalesce(json_extract_string(payload, '$.data.object.id'), '') as session_id,
         coalesce(try_cast(regexp_extract(json_extract_string(payload, '$.data.object.metadata.booking_id'),
                                          '^\\s*([+-]?[0-9]+)', 1) as bigint), 0) as booking_id,
         json_extract_string(payload, '$.data.object.metadata.booking_id') as raw_bid
  from chk
  where reject_reason is null and json_extract_string(payload, '$.type') = 'checkout.session.completed')"""

oracle("gateway_payments", "webhooks_raw")(_GATEWAY_CTE + """
select event_id, received_at, session_id, booking_id from pay where raw_bid is not null and raw_bid not in ('', '0')
""")

_APPLY_GATEWAY = _GATEWAY_CTE + """,
firsts as (
  select *, row_number() over (partition by booking_id order by received_at, event_id) as rn
  from pay where raw_bid is not null and raw_bid not in ('', '0'))
select f.booking_id, 'Paid' as payment_status, 'Electronic' as payment_method, f.session_id as gateway_transaction_id,
       f.received_at as payment_timestamp, f.event_id
from firsts f join bookings b on b.booking_id = f.booking_id
where f.rn = 1 and b.payment_status <> 'Paid'
"""

oracle("apply_gateway_payments", "webhooks_raw", "bookings")(_APPLY_GATEWAY)
oracle("gateway_payment_stream", "webhooks_raw", "bookings")(_APPLY_GATEWAY)
oracle("gateway_payment_stream_unordered", "webhooks_raw", "bookings")(_GATEWAY_CTE + """
select b.booking_id, 'Paid' as payment_status, 'Electronic' as payment_method
from bookings b where b.payment_status <> 'Paid'
  and exists (select 1 from pay where pay.booking_id = b.booking_id and raw_bid is not null and raw_bid not in ('', '0'))
""")
oracle("gateway_rejects_stream", "webhooks_raw")(_VERIFY_CTE + """
select event_id, reject_reason from chk where reject_reason is not null
""")

oracle("stream_daily_commissions", "commissions")("""
select cast(created_at as date) as commission_date, count(*) as total_bookings,
       cast(sum(booking_amount) as decimal(18,2)) as total_revenue,
       cast(sum(commission_amount) as decimal(18,2)) as total_commission
from commissions
group by 1
having cast(created_at as date) + interval 1 day <= (select max(created_at) from commissions)
""")


oracle("admit_tickets", "tickets_raw")(f"""
with t as (
  select *, ({_empty('user_id')} or {_empty('issue_type')} or {_empty('title')} or {_empty('description')}) as missing
  from tickets_raw)
select ticket_key,
       case when not missing then row_number() over (partition by missing order by ticket_key) end as ticket_id,
       user_id, issue_type, title, description,
       case when not missing then 'Open' end as status, case when not missing then 'Normal' end as priority,
       case when not missing then {AS_OF} end as created_at,
       case when missing then 'missing_fields' end as reject_reason
from t
""")


# ---------------------------------------------------------------------------
# Sequential fold per booking, one command per recursion step
# ---------------------------------------------------------------------------
_E4_CTE = _GATEWAY_CTE.replace("with parts as", "parts as", 1) + """,
gw as (select event_id, booking_id, received_at as ts, session_id as txn from pay
       where raw_bid is not null and raw_bid not in ('', '0')),
cmds as (
  select booking_id, ts, 0 as ko, command_id as id, 'confirm' as kind, trim(coalesce(payment_status, '')) as status,
         null::varchar as method, null::varchar as txn, trim(coalesce(notes, '')) as note
  from confirm_commands
  where booking_id > 0 and trim(coalesce(payment_status, '')) in ('', 'Unpaid', 'Paid', 'Refunded')
  union all
  select booking_id, ts, 1, command_id, 'pay', trim(coalesce(payment_status, '')), trim(coalesce(payment_method, '')),
         trim(coalesce(transaction_id, '')), null
  from payment_updates
  where booking_id > 0 and trim(coalesce(payment_status, '')) in ('Unpaid', 'Paid', 'Refunded')
    and trim(coalesce(payment_method, '')) in ('', 'Electronic', 'Cash', 'Kareemi', 'Transfer')
  union all
  select booking_id, ts, 2, event_id, 'gateway', null, null, txn, null from gw
  union all
  select p.booking_id, p.ts, 3, p.command_id, 'proof', null, trim(coalesce(p.payment_method, '')), trim(coalesce(p.transaction_id, '')),
         trim(coalesce(p.note, ''))
  from payment_proofs p join bookings b on b.booking_id = p.booking_id
  where p.booking_id > 0 and trim(coalesce(p.transaction_id, '')) not in ('', '0')
    and (coalesce(b.user_id = p.actor_user_id, false) or coalesce(p.actor_user_type in ('Employee', 'Admin'), false))
    and trim(coalesce(p.payment_method, '')) in ('', 'Electronic', 'Cash', 'Kareemi', 'Transfer')
  union all
  select booking_id, requested_at, 4, command_id, 'cancel', null, null, null, null from cancel_requests),
seqd as (
  select c.*, row_number() over (partition by c.booking_id order by c.ts, c.ko, c.id) as k
  from cmds c where exists (select 1 from bookings b where b.booking_id = c.booking_id)),
walk(booking_id, k, kind, ts, bs, ps, method, txn, paid_at, notes, accepted) as (
  select b.booking_id, 0::bigint, null::varchar, null::timestamp, b.booking_status, b.payment_status, b.payment_method,
         b.gateway_transaction_id, b.payment_timestamp, b.notes, null::boolean
  from bookings b where b.booking_id in (select booking_id from seqd)
  union all
  select w.booking_id, c.k, c.kind, c.ts,
         case when o.ok and c.kind = 'confirm' then 'Confirmed' when o.ok and c.kind = 'cancel' then 'Cancelled'
              else w.bs end,
         case when o.ok and c.kind = 'confirm' and c.status <> '' then c.status
              when c.kind = 'pay' then c.status
              when o.ok and c.kind = 'gateway' then 'Paid'
              when o.ok and c.kind = 'cancel' and w.ps = 'Paid' then 'Refunded'
              else w.ps end,
         case when c.kind = 'pay' and c.method <> '' then c.method
              when o.ok and c.kind = 'gateway' then 'Electronic'
              when o.ok and c.kind = 'proof' and c.method <> '' then c.method
              else w.method end,
         case when c.kind = 'pay' and c.txn <> '' then c.txn
              when o.ok and c.kind in ('gateway', 'proof') then c.txn
              else w.txn end,
         case when c.kind = 'pay' and c.status = 'Paid' then c.ts
              when o.ok and c.kind = 'gateway' then c.ts
              else w.paid_at end,
         case when o.ok and c.kind = 'proof' then (case when c.note in ('', '0') then 'Submitted by customer' else c.note end)
              else w.notes end,
         o.ok
  from walk w join seqd c on c.booking_id = w.booking_id and c.k = w.k + 1,
       lateral (select case c.kind when 'confirm' then coalesce(w.bs = 'Pending', false)
                                   when 'pay' then true
                                   when 'gateway' then w.ps is not null and w.ps <> 'Paid'
                                   when 'proof' then w.ps is distinct from 'Paid'
                                   when 'cancel' then w.bs is distinct from 'Cancelled' end as ok) o)"""

oracle("booking_state", "webhooks_raw", "bookings", "confirm_commands", "payment_updates", "payment_proofs",
       "cancel_requests")("with recursive " + _E4_CTE.strip() + """
select booking_id, bs as booking_status, ps as payment_status, method as payment_method, txn as gateway_transaction_id,
       paid_at as payment_timestamp, notes
from (select *, row_number() over (partition by booking_id order by k desc) as r from walk) x where r = 1
""")

ORACLES["booking_state_stream"] = ORACLES["booking_state"]

oracle("booking_state_verdicts", "webhooks_raw", "bookings", "confirm_commands", "payment_updates", "payment_proofs",
       "cancel_requests")("with recursive " + _E4_CTE.strip() + """
select booking_id, ts, kind, accepted from walk where k > 0
""")
ORACLES["booking_state_stream_verdicts"] = ORACLES["booking_state_verdicts"]


oracle("login_lookup", "identifier_lookups", "users")(f"""
with b as (
  select lookup_id, json_object(['identifier', 'email', 'phone', 'phone_number'][lookup_id % 4 + 1], identifier) as body
  from identifier_lookups),
l as (
  select lookup_id, coalesce(json_extract_string(body, '$.identifier'), json_extract_string(body, '$.email'),
                             json_extract_string(body, '$.phone'), json_extract_string(body, '$.phone_number'), '')
         as identifier
  from b)
select l.lookup_id, l.identifier,
       case when not {_empty('l.identifier')} then m.user_id end as user_id,
       case when {_empty('l.identifier')} then 'identifier_required'
            when m.user_id is null then 'user_not_found' end as reject_reason
from l
left join (select l2.lookup_id, min(u.user_id) as user_id from l l2
           join users u on u.email = l2.identifier or u.phone_number = l2.identifier group by l2.lookup_id) m
  on m.lookup_id = l.lookup_id
""")


oracle("apply_cancellations_passengers", "cancel_requests", "bookings", "trips", "cancel_policy_rules",
       "passengers")(_CONFIRM_CTE + """
select p.passenger_id, p.booking_id, p.trip_id, p.seat_id, 'Cancelled' as passenger_status
from passengers p where p.booking_id in (select booking_id from dec where reject_reason is null)
""")

oracle("admit_bookings_bookings", *_ADMIT_FX)(_ADMIT_CTE + """
select w.booking_id, r.user_id, r.trip_id, r.total_price, 'Pending' as booking_status, r.payment_method,
       'Unpaid' as payment_status, r.received_at as booking_date, c.cancel_policy_id
from won w join req r on r.request_id = w.request_id join chk c on c.request_id = w.request_id
""")

oracle("admit_bookings_seat_updates", *_ADMIT_FX)(_ADMIT_CTE + """
select distinct cd.seat_id, false as is_available
from codes cd join won w on w.request_id = cd.request_id
""")


ORACLES["admit_bookings_stream"] = ORACLES["admit_bookings"]
ORACLES["admit_bookings_stream_passengers"] = ORACLES["admit_bookings_passengers"]

oracle("admit_bookings_outbox", *_ADMIT_FX, "users", "user_device_tokens")(_ADMIT_CTE + """,
x as (
  select w.booking_id, r.user_id, coalesce(u.full_name, 'Customer') as full_name,
         coalesce(u.phone_number, '') as phone_number, r.total_price
  from won w join req r on r.request_id = w.request_id left join users u on u.user_id = r.user_id),
tok as (
  select user_id, fcm_token from (
    select *, row_number() over (partition by user_id order by created_at desc, fcm_token desc, device_type desc) as rn
    from user_device_tokens) t where rn = 1 and fcm_token not in ('', '0')),
msg as (
  select booking_id, user_id, 'Unpaid' as status, phone_number, 'تم إنشاء الحجز بنجاح' as title,
         'مرحبا ' || full_name || '، تم حجز رحلتك رقم ' || cast(booking_id as varchar)
         || '. يرجى الدفع لإتمام التأكيد. المبلغ: ' || cast(total_price as varchar) as body
  from x)
select booking_id, user_id, status, 'db' as channel, cast(null as varchar) as recipient, title, body from msg
union all
select booking_id, user_id, status, 'whatsapp',
       case when length(regexp_replace(phone_number, '[^0-9]', '', 'g')) = 9
                 and starts_with(regexp_replace(phone_number, '[^0-9]', '', 'g'), '7')
            then '967' || regexp_replace(phone_number, '[^0-9]', '', 'g')
            else regexp_replace(phone_number, '[^0-9]', '', 'g') end, title, body
from msg where phone_number not in ('', '0')
union all
select m.booking_id, m.user_id, m.status, 'push', t.fcm_token, m.title, m.body from msg m join tok t on t.user_id = m.user_id
""")


# ---------------------------------------------------------------------------
# Updates applied to stored tables: the table with the changed rows' values
# ---------------------------------------------------------------------------
def _patched(name: str, changes: str, table: str, key: str, columns: list[str], where: str = "true"):
    """``table`` with ``columns`` taken from the rows of the oracle ``changes`` that have the key."""
    values = ", ".join(f"case when u.{key} is null then b.{c} else u.{c} end as {c}" for c in columns)
    ORACLES[name] = _join(duckdb_prefix(table), f"""
select b.* replace ({values}) from {table} b left join (from ({ORACLES[changes]}) where {where}) u on u.{key} = b.{key}
""")


_patched("store_payment_updates", "apply_payment_updates_state", "bookings", "booking_id",
         ["payment_status", "payment_method", "payment_timestamp", "gateway_transaction_id"])
_patched("store_confirmations", "confirm_bookings", "bookings", "booking_id", ["booking_status", "payment_status"], "reject_reason is null")
_patched("store_recalculated_commissions", "recalculate_commissions_rows", "commissions", "commission_id",
         ["booking_amount", "commission_amount", "partner_revenue"])
_patched("store_cancellations_seats", "apply_cancellations_freed_seats", "seats", "seat_id", ["is_available"])

ORACLES["store_cancellations"] = _join(duckdb_prefix("bookings"), f"""
select b.* replace (coalesce(u.booking_status, b.booking_status) as booking_status,
                    case when u.booking_id is null then b.payment_status else u.payment_status end as payment_status),
       u.cancel_reason, u.cancel_timestamp
from bookings b left join ({ORACLES["apply_cancellations_bookings"]}) u on u.booking_id = b.booking_id
""")

ORACLES["store_paid_commissions"] = _join(duckdb_prefix("commissions"), f"""
select c.* replace (coalesce(u.status, c.status) as status, coalesce(u.notes, c.notes) as notes), u.payment_date
from commissions c left join ({ORACLES["mark_commissions_paid_rows"]}) u on u.commission_id = c.commission_id
""")

ORACLES["store_phone_updates"] = ORACLES["apply_phone_updates_state"]

ORACLES["store_refunds"] = _join(duckdb_prefix("refund_transactions", "refund_commands"), f"""
with processed as (from ({ORACLES["process_refunds"]}) where reject_reason is null),
now_ as (
  select r.*, p.refund_id is not null as was_pending, coalesce(p.refund_status, r.refund_status) as status_,
         p.refund_method, p.processed_by, p.processing_started_at, p.internal_notes, p.customer_notes
  from refund_transactions r left join processed p on p.refund_id = r.refund_id),
first_ as (
  select refund_id, arg_min(trim(coalesce(refund_reference, '')), command_id) as ref, cast(arg_min(employee_id, command_id) as bigint) as who
  from refund_commands where refund_id > 0 group by refund_id),
done as (select n.*, f.ref, f.who, n.status_ = 'Processing' and f.refund_id is not null as closes from now_ n left join first_ f using (refund_id))
select refund_id, booking_id, created_at, case when closes then 'Completed' else status_ end as refund_status, refund_method, processed_by,
       processing_started_at, case when closes then '' else internal_notes end as internal_notes,
       case when closes then 'تم إرجاع المبلغ بنجاح.' || case when ref <> '' then ' رقم المعاملة: ' || ref else '' end
            else customer_notes end as customer_notes,
       case when closes then ref end as refund_reference, case when closes then who end as completed_by,
       case when closes then {AS_OF} end as completed_at
from done
""")

ORACLES["trip_search_by_day"] = ORACLES["trip_search"]
for _name in ("booking_history", "booking_contacts", "double_booked_seats", "apply_gateway_payments"):
    ORACLES[f"{_name}_bucketed"] = ORACLES[_name]

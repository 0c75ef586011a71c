"""Queries over trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardstream.bindings.register import events
from yardstream.bindings.views import with_views
from yardstream.functions.plate_rules import plate_clean
from yardstream.operators import trips as T
from yardstream.sources import derived as D

AS_OF_TRIPS = "timestamp_ntz'2001-01-01 00:00:00'"


def _open_trip(s, d):
    r = D.reads(s, d).withColumn("plate_number", plate_clean(F.col("raw_plate")))
    return r.join(T.open_trip_per_plate(D.trips(s, d)), "plate_number", "left").select("read_id", "plate_number", "trip_id", "status")


def _changes(s, d):
    t = D.trips(s, d)
    step = F.inline(F.array(
        F.struct(F.lit("inside_plant").alias("new_status"), F.expr("expected_arrival + (trip_id%50) * interval '1' minute").alias("changed_at"), (F.col("trip_id") % 2 == 0).alias("on")),
        F.struct(F.lit("completed").alias("new_status"), F.expr("expected_arrival + (60 + trip_id%70) * interval '1' minute + (trip_id%60) * interval '1' second").alias("changed_at"), (F.col("trip_id") % 3 == 0).alias("on")),
    ))
    return t.select("trip_id", step).filter("on").select("trip_id", F.col("new_status").alias("status"), "changed_at")


def _status_apply(s, d):
    return T.apply_status_changes(D.trips(s, d), _changes(s, d)).select("trip_id", "status", "actual_entry_time", "actual_exit_time", "dwell_minutes")


def _violations(s, d):
    h = D.trip_history(s, d).withColumn("to_status", F.when((F.col("trip_id") % 7 == 0) & (F.col("seq") == 3), F.lit("arrived")).otherwise(F.col("to_status")))
    return T.lifecycle_violations(h)


def _occupancy(s, d):
    return T.running_occupancy(events(s, d)).select("event_id", "gate_id", F.col("occupancy").cast("long").alias("occupancy"))


def _overstays(s, d):
    return T.overstays(D.trips(s, d), F.expr(AS_OF_TRIPS)).select("trip_id", "plate_number", "status", "expected_departure")


QUERIES = {
    "trips_last_event": lambda s, d: T.trips_with_last_event(D.trips(s, d), D.vehicles(s, d), events(s, d)),
    "active_trips": lambda s, d: T.active_trips(D.trips(s, d), D.vehicles(s, d), events(s, d)),
    "open_trip_per_plate": _open_trip,
    "trip_progression": lambda s, d: T.progress_trips(events(s, d), D.trips(s, d)),
    "trip_simple": lambda s, d: T.progress_trips(events(s, d), D.trips(s, d)).groupBy("status", "is_auto").agg(F.count("*").alias("n"), F.sum("dwell_minutes").alias("dwell")),
    "auto_trip_ids": lambda s, d: T.number_new_trips(T.progress_trips(events(s, d), D.trips(s, d)), D.trips(s, d)).select("trip_id", "event_id", "plate_number", "status"),
    "trip_history_rows": lambda s, d: T.trip_history(events(s, d), D.trips(s, d)),
    "dwell_pairs": lambda s, d: T.exit_dwells(events(s, d), D.trips(s, d)),
    "trip_status_apply": _status_apply,
    "status_durations": lambda s, d: T.status_durations(D.trip_history(s, d)),
    "lifecycle_violations": _violations,
    "occupancy_running": _occupancy,
    "overstay_alerts": _overstays,
}

_LAST = "(select plate_number as lp, arg_max(ts, event_id) as last_event from ev group by 1)"
_TRIPS = f"""select t.trip_id, t.plate_number, t.transporter, t.gate_name, t.purpose, t.expected_arrival, t.expected_departure, t.status,
  t.actual_entry_time as entry_time, t.dwell_minutes, v.vehicle_type, {{last}} as last_event
from trips t join veh v on v.vehicle_id = t.vehicle_id left join {_LAST} on lp = t.plate_number"""

# event-by-event simulation: a stack of open trips (ids, entry times) per plate
_WALK = """
with op as (select plate_number as pl, list(trip_id order by trip_id) as ids, list(actual_entry_time order by trip_id) as ents, list(status order by trip_id) as sts
            from trips where status not in ('completed','cancelled') group by 1),
e as (select event_id, ts, plate_number, event_type, decision, row_number() over (partition by plate_number order by ts, event_id) as rn from ev where plate_number <> 'UNKNOWN'),
walk as (
  select e.plate_number, cast(0 as bigint) as rn, cast(null as bigint) as event_id, cast(null as timestamp) as ts, coalesce(op.ids, cast([] as bigint[])) as ids,
         coalesce(op.ents, cast([] as timestamp[])) as ents, coalesce(op.sts, cast([] as varchar[])) as sts, cast(null as bigint) as trip_ref,
         cast(null as varchar) as kind, cast(null as timestamp) as entry_time, cast(null as varchar) as from_status
  from (select distinct plate_number from e) e left join op on op.pl = e.plate_number
  union all
  select w.plate_number, e.rn, e.event_id, e.ts,
    case when e.event_type = 'exit' then w.ids[:-2] when e.decision = 'allow' and len(w.ids) = 0 then [-e.event_id] else w.ids end,
    case when e.event_type = 'exit' then w.ents[:-2] when e.decision = 'allow' then list_append(w.ents[:-2], e.ts) else w.ents end,
    case when e.event_type = 'exit' then w.sts[:-2] when e.decision = 'allow' and len(w.ids) = 0 then ['scheduled'] else w.sts end,
    case when e.event_type = 'exit' then w.ids[-1] when e.decision = 'allow' then coalesce(w.ids[-1], -e.event_id) end,
    case when e.event_type = 'exit' then 'exit' when e.decision = 'allow' then 'entry' end,
    case when e.event_type = 'exit' then w.ents[-1] when e.decision = 'allow' then e.ts end,
    case when e.event_type = 'exit' then w.sts[-1] when e.decision = 'allow' then coalesce(w.sts[-1], 'scheduled') end
  from walk w join e on e.plate_number = w.plate_number and e.rn = w.rn + 1),
steps as (select *, case when kind = 'exit' then case when trip_ref is null then 30 when entry_time is null then 25
     else greatest(1, cast(round_even((epoch_us(ts) - epoch_us(entry_time)) / 60000000.0, 0) as int)) end end as dwell from walk where kind is not null),
moved as (select trip_ref, plate_number, trip_ref < 0 or bool_or(kind = 'entry' and trip_ref = -event_id) as is_auto, max(from_status) as from_status,
   case when bool_or(kind = 'exit') then 'completed' else 'inside_plant' end as status, max(entry_time) as entry_time,
   max(case when kind = 'exit' then ts end) as exit_time, max(dwell) as dwell_minutes, min(ts) as first_ts
  from steps where trip_ref is not null group by 1, 2)
"""

ORACLE = {
    "trips_last_event": _TRIPS.format(last="last_event"),
    "active_trips": _TRIPS.format(last="coalesce(last_event, t.actual_entry_time)") + " where t.status in ('arrived','entry_approved','inside_plant','at_destination')",
    "open_trip_per_plate": """
select read_id, plate as plate_number, t.trip_id, t.status from (select *, regexp_replace(upper(raw_plate), '[^A-Z0-9]', '', 'g') as plate from reads) r
left join (select * from (select *, row_number() over (partition by plate_number order by trip_id desc) as rn from trips where status not in ('completed','cancelled')) where rn = 1) t
 on t.plate_number = r.plate""",
    "trip_progression": _WALK + """
select trip_ref, plate_number, is_auto, from_status, status, entry_time, exit_time, dwell_minutes,
  case when is_auto then first_ts end as auto_created_at, case when is_auto then first_ts + interval '2' hour end as auto_expected_departure from moved""",
    "trip_simple": _WALK + "select status, is_auto, count(*) as n, cast(sum(dwell_minutes) as bigint) as dwell from moved group by 1, 2",
    "auto_trip_ids": _WALK + """
select (select max(trip_id) from trips) + row_number() over (order by first_ts, -trip_ref) as trip_id, -trip_ref as event_id, plate_number, status from moved where is_auto""",
    "trip_history_rows": _WALK + """,
seen as (select *, coalesce(bool_or(kind = 'entry') over (partition by plate_number, trip_ref order by rn rows between unbounded preceding and 1 preceding), false) as entered
  from steps where trip_ref is not null)
select trip_ref, plate_number, case when entered then 'inside_plant' else from_status end as from_status,
  case when kind = 'exit' then 'completed' else 'inside_plant' end as to_status, event_id as trigger_event_id, ts from seen where kind = 'exit' or not entered""",
    "dwell_pairs": _WALK + "select event_id, plate_number, trip_ref, entry_time, ts as exit_time, dwell as dwell_minutes from steps where kind = 'exit'",
    "trip_status_apply": """
with ch as (select trip_id, 'inside_plant' as s, expected_arrival + (trip_id%50) * interval '1' minute as tm from trips where trip_id%2=0
  union all select trip_id, 'completed', expected_arrival + (60 + trip_id%70) * interval '1' minute + (trip_id%60) * interval '1' second from trips where trip_id%3=0),
c as (select trip_id, arg_max(s, tm) as s, min(case when s='inside_plant' then tm end) as i, min(case when s='completed' then tm end) as o from ch group by 1)
select t.trip_id, coalesce(c.s, t.status) as status, coalesce(t.actual_entry_time, c.i) as actual_entry_time, coalesce(t.actual_exit_time, c.o) as actual_exit_time,
 case when t.actual_exit_time is null and c.o is not null and coalesce(t.actual_entry_time, c.i) is not null
   then greatest(1, cast(floor((epoch_us(c.o) - epoch_us(coalesce(t.actual_entry_time, c.i))) / 60000000.0) as int)) else t.dwell_minutes end as dwell_minutes
from trips t left join c on c.trip_id = t.trip_id""",
    "status_durations": """
select trip_id, lag(to_status) over w as from_status, to_status, ts as entered_at, lead(ts) over w as left_at,
 round((epoch_us(lead(ts) over w) - epoch_us(ts)) / 60000000.0, 2) as minutes_in_state from history window w as (partition by trip_id order by ts, seq)""",
    "lifecycle_violations": """
with h as (select trip_id, seq, ts, case when trip_id%7=0 and seq=3 then 'arrived' else to_status end as s from history),
r as (select unnest(['scheduled','arrived','entry_approved','inside_plant','at_destination','exit_detected','completed']) as st, unnest(range(7)) as k),
l as (select *, lag(s) over (partition by trip_id order by ts, seq) as p from h)
select trip_id, p as from_status, s as to_status, ts from l join r a on a.st = l.s join r b on b.st = l.p where a.k <= b.k or l.p = 'completed'""",
    "occupancy_running": """
select event_id, gate_id, cast(sum(case when event_type='entry' then 1 else -1 end) over (partition by gate_id order by ts, event_id rows unbounded preceding) as bigint) as occupancy from ev""",
    "overstay_alerts": """
select trip_id, plate_number, status, expected_departure from trips where status in ('inside_plant','at_destination')
 and (coalesce(dwell_minutes,0) > 60 or timestamp '2001-01-01 00:00:00' > expected_departure)""",
}
ORACLE = {k: with_views(v, recursive="walk as (" in v) for k, v in ORACLE.items()}

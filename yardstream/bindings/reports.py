"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardstream.bindings.register import events
from yardstream.bindings.views import with_views
from yardstream.plans import reports as P
from yardstream.sources import derived as D

AS_OF = "timestamp_ntz'2024-01-30 12:00:00'"
AS_OF_TRIPS = "timestamp_ntz'2001-01-01 00:00:00'"


def _volume(s, d):
    e = events(s, d).withColumn("gate_id", F.when(F.col("event_id") % 10 != 0, F.col("gate_id")))
    e = e.withColumn("gate_name", F.when(F.col("event_id") % 15 == 0, F.lit("Gate 01")).otherwise(F.col("gate_name")))
    return P.gate_volume(e, D.gates(s, d))


def _daily(s, d):
    e = events(s, d).withColumn("dwell_minutes", F.when(F.col("event_type") == "exit", F.col("event_id") % 90 + 1))
    return P.daily_gate_summary(e, D.alerts(s, d).withColumn("gate_id", (F.col("gate_id") - 1).cast("int")))


def _corrections(s, d):
    return D.table(s, d, "events").filter("event_id % 50 = 0").select("event_id")


QUERIES = {
    "dashboard_summary": lambda s, d: P.dashboard_summary(D.trips(s, d), events(s, d), D.alerts(s, d), D.cameras(s, d), D.gates(s, d), F.expr(AS_OF)),
    "decision_counts": lambda s, d: P.decision_counts(events(s, d)),
    "gate_volume": _volume,
    "transporter_top6": lambda s, d: P.top_transporters(events(s, d)),
    "dwell_trend": lambda s, d: P.dwell_trend(events(s, d), D.trips(s, d)),
    "dwell_by_weekday": lambda s, d: P.dwell_by_weekday(D.trips(s, d)),
    "repeat_visitors": lambda s, d: P.repeat_visitors(events(s, d)),
    "overstays": lambda s, d: P.overstay_count(D.trips(s, d), F.expr(AS_OF_TRIPS)),
    "overstays_75": lambda s, d: P.overstay_count(D.trips(s, d).withColumn("expected_departure", F.lit(None).cast("timestamp_ntz")).withColumn("dwell_minutes", (F.col("trip_id") % 100).cast("int")), F.expr(AS_OF_TRIPS), 75),
    "corrected_reads": lambda s, d: P.corrected_reads(_corrections(s, d), events(s, d)),
    "daily_gate_summary": _daily,
    "camera_health_latest": lambda s, d: P.camera_health_latest(D.health(s, d)),
    "hourly_traffic": lambda s, d: P.hourly_traffic(events(s, d)),
    "hourly_heat_map": lambda s, d: P.hourly_heat_map(events(s, d)),
}

_DAY = "['Mon','Tue','Wed','Thu','Fri','Sat','Sun']"
ORACLE = {
    "dashboard_summary": """
select (select count(*) from trips where status in ('inside_plant','at_destination','entry_approved')) as vehicles_inside,
 (select count(*) from ev where event_type='entry' and ts >= timestamp '2024-01-30 00:00:00') as entries_today,
 (select count(*) from ev where event_type='exit' and ts >= timestamp '2024-01-30 00:00:00') as exits_today,
 (select count(*) from alerts where not is_read) as active_alerts,
 (select round(avg(dwell_minutes),1) from trips where dwell_minutes > 0) as avg_dwell_minutes,
 (select round(avg(confidence),2) from ev) as recognition_accuracy,
 (select count(*) from cams where status='online') as gates_online, (select count(*) from gate) as total_gates""",
    "decision_counts": """
with c as (select count(*) filter (decision='allow') as a, count(*) filter (decision='manual_review') as r, count(*) filter (decision='deny') as x, count(*) as t from ev)
select 0 as position, 'Allow' as label, a as value, round(a::double/t*100) as approval_rate from c union all select 1, 'Review', r, round(a::double/t*100) from c union all select 2, 'Deny', x, round(a::double/t*100) from c""",
    "gate_volume": """
with e as (select case when event_id%10<>0 then gate_id end as gid, case when event_id%15=0 then 'Gate 01' else gate_name end as gn, event_type from ev)
select replace(gate_name,'Gate ','G') as label, count(gn) as value, count(gn) filter (event_type='exit') as secondary from gate left join e on gid = gate_id or gn = gate_name group by 1""",
    "transporter_top6": """
select split_part(transporter,' ',1) as label, n as value from (select transporter, count(*) as n, min(event_id) as f from ev group by 1 order by n desc, f limit 6)""",
    "dwell_trend": f"""
with m as (select coalesce(cast(trunc(avg(dwell_minutes)) as bigint), 28) as m from trips), c as (select isodow(ts)-1 as d, count(*) as n from ev group by 1)
select {_DAY}[i+1] as label, greatest(10, m + coalesce(n,0)*2) as value, cast(floor(greatest(10, m + coalesce(n,0)*2)*1.25) as bigint) as secondary
from (select unnest(range(7)) as i) cross join m left join c on d = i""",
    "dwell_by_weekday": f"""
select {_DAY}[cast(isodow(actual_exit_time) as int)] as label, round(avg(dwell_minutes),4) as mean_dwell, count(*) as n from trips where actual_exit_time is not null and dwell_minutes is not null group by 1""",
    "repeat_visitors": "select count(*) as repeat_visitors from (select plate_number from ev where plate_number <> 'UNKNOWN' group by 1 having count(*) > 1)",
    "overstays": """
select count(*) as overstays from trips where status in ('inside_plant','at_destination') and (coalesce(dwell_minutes,0) > 60 or timestamp '2001-01-01 00:00:00' > expected_departure)""",
    "overstays_75": "select count(*) as overstays from trips where status in ('inside_plant','at_destination') and trip_id%100 > 75",
    "corrected_reads": "select (select count(*) from events where event_id%50=0) + count(*) filter (is_corrected) as corrected_reads, count(*) as total_reads from ev",
    "daily_gate_summary": """
with a as (select cast(gate_id-1 as int) as g, cast(created_at as date) as dt, count(*) as n from alerts group by 1,2),
e as (select gate_id, cast(ts as date) as summary_date, count(*) filter (event_type='entry') as total_entries, count(*) filter (event_type='exit') as total_exits,
 count(*) filter (decision='deny') as total_denied, count(*) filter (decision='manual_review') as total_reviews,
 coalesce(round(avg(case when event_type='exit' then event_id%90+1 end),4), 0.0) as avg_dwell_minutes from ev group by 1,2)
select e.*, coalesce(a.n, 0) as total_alerts from e left join a on a.g = e.gate_id and a.dt = e.summary_date""",
    "camera_health_latest": """
select camera_id, arg_max(is_online, (last_check_at, sample_id)) as is_online, arg_max(response_time_ms, (last_check_at, sample_id)) as response_time_ms, max(last_check_at) as last_check_at,
 count(*) as samples, round(avg(case when is_online then 1 else 0 end),4) as online_share, round(avg(response_time_ms),4) as mean_response_ms from health group by 1""",
    "hourly_traffic": "select gate_name, cast(hour(ts) as int) as hour, count(*) as n, count(*) filter (event_type='exit') as exits from ev group by 1,2",
    "hourly_heat_map": "select gate_name, " + ", ".join(f"count(*) filter (hour(ts)={h}) as h{h:02d}" for h in range(24)) + " from ev group by 1",
}
ORACLE = {k: with_views(v) for k, v in ORACLE.items()}

"""Queries that load and change master data."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardstream.bindings.lookups import plates, predictions
from yardstream.bindings.register import events
from yardstream.bindings.views import with_views
from yardstream.operators import master as M
from yardstream.sources import derived as D
from yardstream.sources.tables import table_profile

AS_OF = "timestamp_ntz'2024-01-31 00:00:00'"


def _seed(s, d):
    old = D.drivers(s, d).filter("driver_id % 2 = 0").select("license_number", "name")
    new = D.drivers(s, d).select("license_number", F.upper("name").alias("name"))
    once = M.insert_missing(old, new, "license_number")
    return M.insert_missing(once, new, "license_number")


def _requests(s, d):
    return D.texts(s, d).select(
        F.col("read_id").alias("request_id"), F.col("text").alias("plate"), F.when(F.col("read_id") % 2 == 0, F.lit("Truck")).otherwise(F.lit("Car")).alias("vehicle_type"),
        F.concat(F.lit("Owner "), F.col("user_id").cast("string")).alias("owner_name"),
        F.when(F.col("read_id") % 5 == 0, F.concat(F.lit("NEW-"), (F.col("read_id") % 3).cast("string"))).otherwise(F.lit("BUILDING")).alias("transporter"),
        (F.col("read_id") % 4 != 0).alias("authorized"),
    )


def _registration(s, d):
    known = D.vehicles(s, d).select(F.col("transporter").alias("name")).distinct()
    return M.register_vehicles(_requests(s, d), D.vehicles(s, d).select("plate_number"), known, F.expr(AS_OF))


def _register(s, d):
    r = _registration(s, d)
    lists = r.whitelist.select("vehicle_id", F.lit("whitelist").alias("list_name")).unionByName(r.watchlist.select("vehicle_id", F.lit("watchlist").alias("list_name")))
    return r.vehicles.join(lists, "vehicle_id")


def _numbered(s, d):
    hauliers = D.vehicles(s, d).groupBy(F.col("transporter").alias("name")).agg(F.min("vehicle_id").alias("transporter_id"))
    return M.number_registration(_registration(s, d), D.vehicles(s, d), hauliers)


def _vehicle_ids(s, d):
    n = _numbered(s, d)
    lists = n.whitelist.select("vehicle_id", F.lit("whitelist").alias("list_name")).unionByName(n.watchlist.select("vehicle_id", F.lit("watchlist").alias("list_name")))
    audit = n.audit.select(F.col("entity_id").cast("long").alias("vehicle_id"), "details")
    return n.vehicles.join(lists, "vehicle_id").join(audit, "vehicle_id").select("vehicle_id", "plate_number", "transporter", "transporter_id", "list_name", "details")


def _patch(s, d):
    patch = D.vehicles(s, d).filter("vehicle_id % 3 = 0").select(
        "vehicle_id", F.when(F.col("vehicle_id") % 2 == 0, F.lit("Van")).alias("vehicle_type"), F.lit(None).cast("string").alias("owner_name"),
        F.when(F.col("vehicle_id") % 5 == 0, F.lit(False)).alias("is_authorized"),
    )
    return M.merge_patches(D.vehicles(s, d).select("vehicle_id", "vehicle_type", "owner_name", "is_authorized"), patch, "vehicle_id")


def _patches_in_turn(s, d):
    """Every read of a vehicle's owner patches its type, owner or both; later reads overwrite earlier ones."""
    patch = _requests(s, d).join(D.texts(s, d).select(F.col("read_id").alias("request_id"), F.col("user_id").alias("vehicle_id")), "request_id").select(
        "vehicle_id", "request_id", F.when(F.col("request_id") % 3 == 0, F.col("vehicle_type")).alias("vehicle_type"),
        F.when(F.col("request_id") % 2 == 0, F.concat("owner_name", F.lit("/"), F.col("request_id").cast("string"))).alias("owner_name"))
    return M.merge_patches(D.vehicles(s, d).select("vehicle_id", "vehicle_type", "owner_name"), patch, "vehicle_id", "request_id")


def _audit_changes(s, d):
    v = D.vehicles(s, d)
    gone = D.texts(s, d).filter("read_id % 10 = 0").select(F.col("user_id").alias("vehicle_id"))
    patched = D.texts(s, d).filter("read_id % 7 = 0").select(F.col("user_id").alias("vehicle_id"))
    rows = M.audit_vehicle_updates(v, patched, F.expr(AS_OF)).unionByName(M.audit_vehicle_deletes(v, gone, F.expr(AS_OF)))
    return rows.select("action", "entity_type", "entity_id", "details")


def _cascade(s, d):
    gone = D.vehicles(s, d).filter("vehicle_id % 10 = 0").select("vehicle_id")
    keep, owned, linked = M.delete_cascade(
        gone, "vehicle_id", D.vehicles(s, d), {"plates": plates(s, d)},
        {"trips": (D.trips(s, d).select(F.col("trip_id").alias("id"), "vehicle_id"), "vehicle_id"),
         "drivers": (D.drivers(s, d).select(F.col("driver_id").alias("id"), F.col("assigned_vehicle_id").alias("vehicle_id")), "vehicle_id")},
    )
    parts = [keep.select(F.lit("vehicles").alias("source"), F.col("vehicle_id").alias("id"), "vehicle_id"),
             owned["plates"].select(F.lit("plates").alias("source"), F.col("plate_id").alias("id"), "vehicle_id")]
    parts += [df.select(F.lit(n).alias("source"), "id", "vehicle_id") for n, df in linked.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _clear(s, d):
    a = D.alerts(s, d)
    marked = M.mark_alerts_read(a, a.filter("alert_id % 6 = 1").select("alert_id"), F.expr(AS_OF))
    return M.clear_read_alerts(marked).select("alert_id", "alert_type", "is_read")


def _mark(s, d):
    a = D.alerts(s, d)
    return M.mark_alerts_read(a, a.filter("alert_id % 6 = 1").select("alert_id"), F.expr(AS_OF)).select("alert_id", "is_read", "read_at")


def _schedule(s, d):
    t = D.trips(s, d)
    iso = lambda c, z: F.concat(F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(z))
    req = t.select(
        F.col("trip_id").alias("request_id"), F.concat(F.lit(" "), F.lower(F.substring("plate_number", 1, 4)), F.lit(" "), F.substring("plate_number", 5, 2), F.lit("-"),
                                                       F.when(F.col("trip_id") % 9 == 0, F.lit("XX")).otherwise(F.substring("plate_number", 7, 4))).alias("plate"),
        F.when(F.col("trip_id") % 4 == 0, F.lit("Unknown Carrier")).otherwise(F.col("transporter")).alias("transporter"),
        F.when(F.col("trip_id") % 6 == 0, F.lit("Gate 99")).otherwise(F.col("gate_name")).alias("gate_name"),
        F.when(F.col("trip_id") % 7 == 0, F.lit("tomorrow")).otherwise(iso("expected_arrival", "Z")).alias("arrival_text"),
        F.when(F.col("trip_id") % 5 == 0, F.lit("")).otherwise(iso("expected_departure", "+05:30")).alias("departure_text"),
    )
    known = D.vehicles(s, d).select(F.col("transporter").alias("name")).distinct()
    return M.schedule_trips(req, D.vehicles(s, d), known, D.gates(s, d), F.expr(AS_OF))


def _profile(s, d):
    return table_profile({
        "vehicles": D.vehicles(s, d), "plates": plates(s, d), "drivers": D.drivers(s, d), "gates": D.gates(s, d), "cameras": D.cameras(s, d),
        "scheduled_trips": D.trips(s, d), "trip_status_history": D.trip_history(s, d), "plate_predictions": predictions(s, d),
        "entry_exit_events": events(s, d), "whitelist_entries": D.whitelist(s, d), "watchlist_entries": D.watchlist(s, d),
        "alerts": D.alerts(s, d), "camera_health": D.health(s, d),
    })


def _corrections(s, d):
    e = events(s, d).select("event_id", F.col("event_id").alias("prediction_id"), "plate_number", "decision", "is_corrected")
    fixes = predictions(s, d).filter("status = 'manual_review'").select(
        "prediction_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), "fused_text", "created_at"
    ).select("prediction_id", F.concat(F.lit(" fx-"), F.col("fused_text"), F.col("k").cast("string")).alias("corrected_plate"), (F.col("created_at") + F.expr("make_dt_interval(0, k)")).alias("corrected_at"))
    return M.apply_corrections(predictions(s, d), e, fixes)


def _apply(s, d):
    c = _corrections(s, d)
    ev = c.events.select(F.col("prediction_id"), F.col("plate_number").alias("event_plate"), "decision", "is_corrected")
    return c.predictions.join(ev, "prediction_id").select("prediction_id", "fused_text", "status", "confidence", "event_plate", "decision", "is_corrected")


QUERIES = {
    "seed_idempotent": _seed,
    "vehicle_register_batch": _register,
    "vehicle_patches_in_turn": _patches_in_turn,
    "audit_vehicle_changes": _audit_changes,
    "vehicle_register_ids": _vehicle_ids,
    "transporter_ids": lambda s, d: _numbered(s, d).transporters,
    "vehicle_register_rejected": lambda s, d: _registration(s, d).rejected,
    "transporters_after_register": lambda s, d: _registration(s, d).transporters,
    "vehicle_patch_merge": _patch,
    "delete_cascade": _cascade,
    "alerts_clear_read": _clear,
    "alerts_mark_read": _mark,
    "trip_schedule_batch": _schedule,
    "table_profile": _profile,
    "audit_rows": lambda s, d: _corrections(s, d).audit.select("action", "entity_type", "entity_id", "details"),
    "apply_corrections": _apply,
}

_REQ = """(select read_id as request_id, replace(replace(upper(text),' ',''),'-','') as p, case when read_id%2=0 then 'Truck' else 'Car' end as vehicle_type, concat('Owner ', cast(user_id as varchar)) as owner_name,
 case when read_id%5=0 then concat('NEW-', cast(read_id%3 as varchar)) else 'BUILDING' end as transporter, read_id%4<>0 as auth from texts)"""
_FRESH = f"""r as (select *, row_number() over (partition by p order by request_id) as rn from {_REQ}),
f as (select * from r where rn = 1 and not exists (select 1 from veh where plate_number = r.p))"""

_IDS = f"""{_FRESH},
v as (select *, (select max(vehicle_id) from veh) + row_number() over (order by request_id) as id from f),
old as (select transporter as name, min(vehicle_id) as transporter_id from veh group by 1),
made as (select transporter as name, min(id) as first_id from v where transporter not in (select name from old) group by 1),
tr as (select transporter_id, name from old union all select (select max(transporter_id) from old) + row_number() over (order by first_id), name from made)"""

ORACLE = {
    "vehicle_register_ids": f"""
with {_IDS}
select id as vehicle_id, p as plate_number, transporter, transporter_id, case when auth then 'whitelist' else 'watchlist' end as list_name,
 concat('Created vehicle ', p, ' (type=', vehicle_type, ', transporter=', transporter, ')') as details from v left join tr on tr.name = v.transporter""",
    "vehicle_patches_in_turn": f"""
with p as (select q.*, t.user_id as vid from {_REQ} q join texts t on t.read_id = q.request_id),
l as (select vid, arg_max(vehicle_type, request_id) filter (request_id%3=0) as vt, arg_max(concat(owner_name, '/', cast(request_id as varchar)), request_id) filter (request_id%2=0) as ow from p group by 1)
select vehicle_id, coalesce(vt, vehicle_type) as vehicle_type, coalesce(ow, owner_name) as owner_name from veh left join l on vid = vehicle_id""",
    "audit_vehicle_changes": """
select 'VEHICLE_UPDATE' as action, 'VEHICLE' as entity_type, cast(user_id as varchar) as entity_id, concat('Updated vehicle ', cast(user_id as varchar)) as details
from texts where read_id%7=0 and user_id in (select vehicle_id from veh)
union all select 'VEHICLE_DELETE', 'VEHICLE', cast(vehicle_id as varchar), concat('Deleted vehicle ', cast(vehicle_id as varchar), ' (', plate_number, ')') from veh
where vehicle_id in (select user_id from texts where read_id%10=0)""",
    "transporter_ids": f"with {_IDS} select * from tr",
    "seed_idempotent": "select license_number, case when driver_id%2=0 then name else upper(name) end as name from drivers",
    "vehicle_register_batch": f"""
with {_FRESH}
select request_id as vehicle_id, p as plate_number, case when length(p)>=2 then p[1:2] else 'IN' end as state_code, vehicle_type, owner_name, transporter, auth as is_authorized,
 case when auth then 'Available' else 'Flagged' end as status, case when auth then 'whitelist' else 'watchlist' end as list_name from f""",
    "vehicle_register_rejected": f"with {_FRESH} select request_id, p as plate_number from r where request_id not in (select request_id from f)",
    "transporters_after_register": f"with {_FRESH} select distinct transporter as name from veh union select transporter from f",
    "vehicle_patch_merge": """
select vehicle_id, case when vehicle_id%6=0 then 'Van' else vehicle_type end as vehicle_type, owner_name, case when vehicle_id%15=0 then false else is_authorized end as is_authorized from veh""",
    "delete_cascade": """
select 'vehicles' as source, vehicle_id as id, vehicle_id from veh where vehicle_id%10<>0
union all select 'plates', vehicle_id*2+k, vehicle_id from veh cross join (select unnest(range(2)) as k) where vehicle_id%11<>0 and vehicle_id%10<>0
union all select 'trips', trip_id, case when vehicle_id%10<>0 then vehicle_id end from trips
union all select 'drivers', driver_id, case when assigned_vehicle_id%10<>0 then assigned_vehicle_id end from drivers""",
    "alerts_clear_read": "select alert_id, alert_type, is_read from alerts where not is_read and alert_id%6<>1",
    "alerts_mark_read": "select alert_id, is_read or alert_id%6=1 as is_read, case when alert_id%6=1 then timestamp '2024-01-31 00:00:00' end as read_at from alerts",
    "trip_schedule_batch": """
with q as (select *, case when trip_id%9=0 then concat(plate_number[1:6],'XX') else plate_number end as p, case when trip_id%7=0 then timestamp '2024-01-31 00:00:00' else expected_arrival end as arr,
  case when trip_id%4=0 then 'Unknown Carrier' else transporter end as tr, case when trip_id%6=0 then 'Gate 99' else gate_name end as gn from trips)
select trip_id as request_id, p as plate_number, v.vehicle_id, tr as transporter, trip_id%4<>0 as transporter_known, gn as gate_name, g.gate_id, arr as expected_arrival,
 case when trip_id%5=0 then arr + interval '2' hour else expected_departure end as expected_departure, 'scheduled' as status
from q left join veh v on v.plate_number = q.p left join gate g on g.gate_name = q.gn""",
    "table_profile": """
with c as (select 'vehicles' as table_name, count(*) as row_count from veh union all select 'plates', 2*count(*) from veh where vehicle_id%11<>0 union all select 'drivers', count(*) from drivers
 union all select 'gates', count(*) from gate union all select 'cameras', count(*) from cams union all select 'scheduled_trips', count(*) from trips union all select 'trip_status_history', count(*) from history
 union all select 'plate_predictions', count(*) from preds union all select 'entry_exit_events', count(*) from ev union all select 'whitelist_entries', count(*) from veh where whitelisted
 union all select 'watchlist_entries', count(*) from veh where watchlisted union all select 'alerts', count(*) from alerts union all select 'camera_health', count(*) from health)
select * from c union all select 'TOTAL', cast(sum(row_count) as bigint) from c""",
    "audit_rows": """
select 'MANUAL_PLATE_CORRECTION' as action, 'PLATE_PREDICTION' as entity_type, cast(prediction_id as varchar) as entity_id,
 concat('Plate corrected from ''', fused_text, ''' to ''FX', fused_text, '2''') as details from preds where status='manual_review'""",
    "apply_corrections": """
select p.prediction_id, case when p.status='manual_review' then concat('FX', fused_text, '2') else fused_text end as fused_text, 'finalized' as status,
 case when p.status='manual_review' then greatest(p.confidence, 0.98) else p.confidence end as confidence, case when p.status='manual_review' then concat('FX', fused_text, '2') else e.plate_number end as event_plate,
 case when p.status='manual_review' then 'allow' else e.decision end as decision, e.is_corrected or p.status='manual_review' as is_corrected
from preds p join ev e on e.event_id = p.prediction_id""",
}
ORACLE = {k: with_views(v) for k, v in ORACLE.items()}

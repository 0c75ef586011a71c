"""Queries over the register: sources, lookups, decisions, alerts, de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardstream.bindings.views import with_views
from yardstream.operators import register as R
from yardstream.operators.dedup import dedup_passages
from yardstream.plans.register_plan import decided_events
from yardstream.sources import derived as D


def events(spark, sf):
    return decided_events(
        D.reads(spark, sf), D.cameras(spark, sf), D.vehicles(spark, sf), D.whitelist(spark, sf), D.watchlist(spark, sf)
    )


def parsed(spark, sf):
    return R.parse_payloads(D.payloads(spark, sf))


def _scan_register(spark, sf):
    return events(spark, sf).select(
        "event_id", "ts", "plate_number", "event_type", "decision", "confidence", "gate_name", "camera_name",
        "transporter", "vehicle_type", "is_corrected",
    )


def _payload_defaults(spark, sf):
    return parsed(spark, sf).drop("supporting_predictions", "frame_predictions")


def _confidence_rescale(spark, sf):
    e = D.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(F.col("value") / 1000)
    return e.select("event_id", F.round(R.rescale_confidence(raw), 6).alias("confidence"))


def _prediction_columns(spark, sf):
    return R.prediction_columns(parsed(spark, sf)).select("read_id", "fused_plate", "is_fused", "frame_count", "prediction_status")


def _explode_frames(spark, sf):
    return R.explode_frames(parsed(spark, sf))


def _resolve_gate(spark, sf):
    return R.resolve_gate(parsed(spark, sf), D.gates(spark, sf)).select("read_id", "gate_ref", "gate_id")


def _resolve_camera(spark, sf):
    df = D.payloads(spark, sf)
    p = R.parse_payloads(df).select("read_id", "camera_code")
    cams = D.cameras(spark, sf)
    # every third message names the camera instead of giving its code
    named = p.join(cams.select("camera_code", "camera_name"), "camera_code", "left").select(
        "read_id",
        F.when((F.col("read_id") % 3 == 0) & F.col("camera_name").isNotNull(), F.col("camera_name"))
        .otherwise(F.col("camera_code")).alias("camera_code"),
    )
    return R.resolve_camera(named, cams)


def _reads_keyed(spark, sf):
    from yardstream.functions.plate_rules import plate_clean

    return D.reads(spark, sf).withColumn("plate", plate_clean(F.col("raw_plate")))


def _join_registry(spark, sf):
    return R.join_registry(_reads_keyed(spark, sf), D.vehicles(spark, sf)).select(
        "read_id", "plate", "vehicle_id", "registered_type", "owner_name", "transporter", "is_authorized"
    )


def _join_whitelist(spark, sf):
    return R.join_list(_reads_keyed(spark, sf), D.whitelist(spark, sf), "whitelist").select("read_id", "plate", "whitelist_match", "whitelist_reason")


def _join_whitelist_valid(spark, sf):
    """Two passes per listed vehicle with a gap or an overlap between them, matched at the time of the read."""
    day = lambda n: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast({n} as int))")
    listed = D.whitelist(spark, sf)
    first = listed.withColumns({"valid_from": F.lit(None).cast("timestamp_ntz"), "valid_until": day("vehicle_id % 20")})
    second = listed.withColumns({"valid_from": day("10 + vehicle_id % 10"), "valid_until": F.lit(None).cast("timestamp_ntz"), "reason": F.lit("Renewed pass")})
    reads = _reads_keyed(spark, sf).withColumn("read_at", F.col("ts").cast("timestamp_ntz"))
    return R.join_list(reads, first.unionByName(second), "whitelist", valid_at="read_at").select("read_id", "plate", "whitelist_match", "whitelist_reason")


def _join_watchlist(spark, sf):
    return R.join_list(_reads_keyed(spark, sf), D.watchlist(spark, sf), "watchlist").select("read_id", "plate", "watchlist_match", "watchlist_reason")


def _unknown(spark, sf):
    return R.unknown_vehicles(_reads_keyed(spark, sf), D.vehicles(spark, sf)).select("read_id", "plate")


def _decisions(spark, sf):
    return events(spark, sf).select("event_id", "decision", "reason", "rule_matched")


def _with_trip_flag(spark, sf, policy):
    from yardstream.operators.trips import open_trip_per_plate

    open_trips = open_trip_per_plate(D.trips(spark, sf)).select(F.col("plate_number").alias("_tp"), F.lit(True).alias("_open"))
    df = events(spark, sf).drop("decision", "reason", "rule_matched")
    df = df.join(open_trips, F.col("plate_number") == F.col("_tp"), "left")
    df = df.withColumn("has_open_trip", F.coalesce("_open", F.lit(False)))
    df = df.withColumn("watchlist_reason", F.lit("Security watchlist"))
    return R.gate_decisions(df, policy).select("event_id", "decision", "rule_matched")


def _alerts(spark, sf):
    return R.alert_rows(events(spark, sf)).drop("ts")


def _deliveries(spark, sf):
    return R.alert_deliveries(R.alert_rows(events(spark, sf))).drop("ts")


def _vehicle_status(spark, sf):
    return R.latest_vehicle_status(events(spark, sf))


def _dedup(spark, sf):
    return dedup_passages(events(spark, sf).select("event_id", "ts", "plate_number", "event_type"), 21600)


def _register_roundtrip(spark, sf):
    """Write the register tables of one batch, read them back and profile them: rows, sum of keys, length of texts."""
    from yardstream.plans.register_plan import register_batch
    from yardstream.sources.tables import append_register, read_register, scratch_dir

    tables = register_batch(
        D.payloads(spark, sf), D.cameras(spark, sf), D.gates(spark, sf), D.vehicles(spark, sf),
        D.whitelist(spark, sf), D.watchlist(spark, sf), dedup_seconds=15,
    )
    root = scratch_dir(spark, "register")
    append_register(tables, root)
    return profile_rows({name: read_register(spark, root, name) for name, _, _ in _PROFILED})


def profile_rows(tables):
    """Rows, sum of keys and length of texts of each register table."""
    out = None
    for name, key, text in _PROFILED:
        one = tables[name].agg(
            F.count("*").alias("row_count"), F.sum(key).cast("long").alias("key_sum"), F.sum(F.length(text)).cast("long").alias("text_length"))
        one = one.select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


#: Table, key and text column that the round trip profiles.
_PROFILED = [
    ("detections", "read_id", "vehicle_type"), ("predictions", "read_id", "fused_plate_text"), ("prediction_frames", "read_id", "ocr_text"), ("events", "event_id", "plate_number"),
    ("decisions", "event_id", "decision"), ("alerts", "event_id", "alert_type"), ("deliveries", "event_id", "recipient"), ("vehicle_status", "vehicle_id", "status"),
]


def _decisions_by_gate(spark, sf):
    return events(spark, sf).groupBy("gate_name", "decision").agg(F.count("*").alias("n"))


QUERIES = {
    "decisions_by_gate": _decisions_by_gate,
    "scan_register": _scan_register,
    "payload_defaults": _payload_defaults,
    "confidence_rescale": _confidence_rescale,
    "prediction_columns": _prediction_columns,
    "explode_frames": _explode_frames,
    "register_write_roundtrip": _register_roundtrip,
    "resolve_gate": _resolve_gate,
    "resolve_camera": _resolve_camera,
    "join_registry": _join_registry,
    "join_whitelist": _join_whitelist,
    "join_whitelist_valid": _join_whitelist_valid,
    "join_watchlist": _join_watchlist,
    "unknown_vehicles": _unknown,
    "gate_decisions": _decisions,
    "gate_decisions_trip": lambda s, d: _with_trip_flag(s, d, "trip_required"),
    "gate_decisions_watchlist_first": lambda s, d: _with_trip_flag(s, d, "watchlist_first"),
    "alerts_generated": _alerts,
    "alert_deliveries": _deliveries,
    "vehicle_status_latest": _vehicle_status,
    "dedup_passages": _dedup,
}

_CLEAN = "regexp_replace(upper(raw_plate), '[^A-Z0-9]', '', 'g')"
_KEYED = f"(select *, {_CLEAN} as plate from reads)"
_ALERT = """
select event_id, alert_type, case when alert_type = 'Low Confidence Read' then 'medium' else 'high' end as severity,
       case alert_type when 'Watchlist Alert' then concat('Watchlist vehicle ', plate_number, ' detected at ', gate_name)
            when 'Unknown Vehicle' then 'Unregistered vehicle'
            else concat('Low confidence read of ', plate_number, ' (', cast(cast(floor(confidence*100) as int) as varchar), '%) at ', gate_name) end as message,
       plate_number, vehicle_id, gate_name
from (select *, case when watchlist_match or not coalesce(is_authorized, true) then 'Watchlist Alert'
                     when vehicle_id is null and plate_number <> 'UNKNOWN' then 'Unknown Vehicle'
                     when confidence < 0.75 and plate_number <> 'UNKNOWN' then 'Low Confidence Read' end as alert_type from ev) a
where alert_type is not null"""
_OPEN = "(select distinct plate_number as tp from trips where status not in ('completed','cancelled'))"


def _dedup_chain(source: str, seconds: int) -> str:
    """Greedy acceptance as a recursive walk; ``source`` has event_id, ts, plate_number, event_type."""
    late = f"e.ts - c.last_ts > interval '{seconds} seconds'"
    return f"""
with src as ({source}),
e as (select event_id, ts, plate_number, event_type, row_number() over (partition by plate_number, event_type order by ts, event_id) as rn from src where plate_number <> 'UNKNOWN'),
chain as (
  select event_id, ts, plate_number, event_type, rn, ts as last_ts, event_id as last_id from e where rn = 1
  union all
  select e.event_id, e.ts, e.plate_number, e.event_type, e.rn, case when {late} then e.ts else c.last_ts end, case when {late} then e.event_id else c.last_id end
  from chain c join e on e.plate_number = c.plate_number and e.event_type = c.event_type and e.rn = c.rn + 1),
deduped as (select event_id, ts, plate_number, event_type, last_id as accepted_id from chain
  union all select event_id, ts, plate_number, event_type, event_id from src where plate_number = 'UNKNOWN')
"""


_PASSAGES = """select read_id as event_id, ts, case when plate = '' then 'UNKNOWN' else plate end as plate_number,
  case when c.direction = 'exit' then 'exit' else 'entry' end as event_type from parsed p left join cams c on c.camera_code = p.camera_code"""

_FRAMES = """select p.read_id, case when p.read_id%2=0 then r.raw_plate else lower(r.raw_plate) end as ocr_text
 from parsed p join reads r on r.read_id = p.read_id join (select 0 as pos union all select 1) f on f.pos < p.n_frames union all select read_id, plate from parsed where n_frames = 0 and plate <> ''"""

ORACLE = {
    "decisions_by_gate": """
select c.gate_name, case when r.confidence < 0.75 then 'manual_review' when v.watchlisted or v.is_authorized = false then 'deny'
       when v.whitelisted then 'allow' when v.vehicle_id is not null then 'allow' else 'manual_review' end as decision, count(*) as n
from reads r join cams c on c.camera_id=r.camera_id left join veh v on replace(replace(upper(r.raw_plate),' ',''),'-','') = v.plate_number
group by 1,2""",
    "scan_register": """
select event_id, ts, plate_number, event_type, decision, confidence, gate_name, camera_name, transporter, vehicle_type, is_corrected from ev""",
    "payload_defaults": """
select read_id, ts, raw_plate, plate, status, track_id, confidence, vehicle_type, camera_code, gate_ref, is_corrected, frame_number,
       given_frame_count, bbox_x1, bbox_y1, bbox_x2, bbox_y2 from parsed""",
    "confidence_rescale": """
select event_id, round(case when c > 1.0 then c / 100.0 else c end, 6) as confidence
from (select event_id, case when event_id%2=0 then value else value/1000 end as c from events)""",
    "prediction_columns": """
select read_id, case when plate = '' then 'UNKNOWN' else plate end as fused_plate, n_frames > 1 as is_fused,
       greatest(n_frames, given_frame_count) as frame_count,
       case when confidence >= 0.75 then status else 'manual_review' end as prediction_status from parsed""",
    "explode_frames": """
with f as (select 0 as pos, 1 as k union all select 1, 3)
select p.read_id, f.pos, cast(p.read_id%50 + f.k as int) as frame_number,
       case when p.read_id%2=0 then r.raw_plate else lower(r.raw_plate) end as ocr_text, r.confidence, 'PaddleOCR' as engine
from parsed p join reads r on r.read_id = p.read_id join f on f.pos < p.n_frames
union all
select read_id, 0, 1, plate, confidence, 'PaddleOCR' from parsed where n_frames = 0 and plate <> ''""",
    "register_write_roundtrip": _dedup_chain(_PASSAGES, 15) + """,
kept as (select p.* from parsed p join deduped d on d.event_id = p.read_id and d.accepted_id = d.event_id),
passage_rows as (PASSAGES),
seen as (select p.*, v.vehicle_id, v.is_authorized, v.watchlisted, v.whitelisted, case when plate = '' then 'UNKNOWN' else plate end as fused, e.event_type
  from kept p left join veh v on v.plate_number = p.plate join passage_rows e on e.event_id = p.read_id),
judged as (select *, case when confidence < 0.75 then 'manual_review' when watchlisted or is_authorized = false then 'deny' when vehicle_id is not null then 'allow' else 'manual_review' end as decision,
  case when watchlisted or not is_authorized then 'Watchlist Alert' when vehicle_id is null and plate <> '' then 'Unknown Vehicle' when confidence < 0.75 and plate <> '' then 'Low Confidence Read' end as alert_type from seen),
all_rows as (
 select 'detections' as table_name, read_id as k, vehicle_type as t from parsed
 union all select 'predictions', read_id, case when plate = '' then 'UNKNOWN' else plate end from parsed
 union all select 'prediction_frames', read_id, ocr_text from (FRAMES)
 union all select 'events', read_id, fused from seen
 union all select 'decisions', read_id, decision from judged
 union all select 'alerts', read_id, alert_type from judged where alert_type is not null
 union all select 'deliveries', read_id, case when alert_type = 'Watchlist Alert' then 'security_guard_console' else 'guard_console' end from judged where alert_type in ('Watchlist Alert', 'Unknown Vehicle')
 union all select 'vehicle_status', vehicle_id, case when arg_max(event_type, (ts, read_id)) = 'entry' then 'Inside' else 'Exited' end from seen where vehicle_id is not null group by vehicle_id)
select table_name, count(*) as row_count, sum(k)::bigint as key_sum, sum(length(t))::bigint as text_length from all_rows group by 1""".replace("PASSAGES", _PASSAGES).replace("FRAMES", _FRAMES),
    "resolve_gate": """
select read_id, gate_ref, coalesce(n.gate_id, c.gate_id) as gate_id from parsed p
left join gate n on n.gate_name = p.gate_ref left join gate c on c.gate_code = p.gate_ref""",
    "resolve_camera": """
select p.read_id, case when p.read_id%3=0 and c.camera_name is not null then c.camera_name else p.camera_code end as camera_code,
       c.camera_id, case when c.direction = 'exit' then 'exit' else 'entry' end as event_type
from parsed p left join cams c on c.camera_code = p.camera_code""",
    "join_registry": f"""
select read_id, plate, v.vehicle_id, v.vehicle_type as registered_type, v.owner_name, coalesce(v.transporter, 'Unregistered') as transporter, v.is_authorized
from {_KEYED} r left join veh v on v.plate_number = r.plate""",
    "join_whitelist": f"""
select read_id, plate, v.vehicle_id is not null as whitelist_match, case when v.vehicle_id is not null then 'Fleet registration' end as whitelist_reason
from {_KEYED} r left join veh v on v.plate_number = r.plate and v.whitelisted""",
    "join_whitelist_valid": f"""
select read_id, plate, reason is not null as whitelist_match, reason as whitelist_reason from (
 select r.read_id, r.plate, case when v.vehicle_id is null then null when r.ts <= timestamp '2024-01-01' + to_days(cast(v.vehicle_id % 20 as int)) then 'Fleet registration'
   when r.ts >= timestamp '2024-01-01' + to_days(cast(10 + v.vehicle_id % 10 as int)) then 'Renewed pass' end as reason
 from {_KEYED} r left join veh v on v.plate_number = r.plate and v.whitelisted)""",
    "join_watchlist": f"""
select read_id, plate, v.vehicle_id is not null as watchlist_match, case when v.vehicle_id is not null then 'Security watchlist' end as watchlist_reason
from {_KEYED} r left join veh v on v.plate_number = r.plate and v.watchlisted""",
    "unknown_vehicles": f"""
select read_id, plate from {_KEYED} r where plate <> '' and not exists (select 1 from veh v where v.plate_number = r.plate)""",
    "gate_decisions": "select event_id, decision, reason, rule_matched from ev",
    "gate_decisions_trip": f"""
select event_id, case when vehicle_id is not null and not is_authorized then 'deny' when vehicle_id is null or tp is null then 'manual_review' else 'allow' end as decision,
       case when vehicle_id is not null and not is_authorized then 'unauthorized_vehicle' when vehicle_id is null or tp is null then 'trip_missing' else 'scheduled_trip_valid' end as rule_matched
from ev left join {_OPEN} on tp = plate_number""",
    "gate_decisions_watchlist_first": f"""
select event_id, case when watchlist_match or not coalesce(is_authorized, true) then 'deny' when whitelist_match then 'allow'
            when confidence < 0.75 then 'manual_review' when tp is not null then 'allow' else 'manual_review' end as decision,
       case when watchlist_match or not coalesce(is_authorized, true) then 'watchlist_blacklist_enforcement' when whitelist_match then 'whitelist_preapproved'
            when confidence < 0.75 then 'low_confidence_threshold' when tp is not null then 'scheduled_trip_valid' else 'no_open_trip_review' end as rule_matched
from ev left join {_OPEN} on tp = plate_number""",
    "alerts_generated": _ALERT,
    "alert_deliveries": f"""
select event_id, 'websocket' as channel, case when alert_type = 'Watchlist Alert' then 'security_guard_console' else 'guard_console' end as recipient, 'delivered' as status
from ({_ALERT}) where severity = 'high'""",
    "vehicle_status_latest": """
select vehicle_id, case when arg_max(event_type, (ts, event_id)) = 'entry' then 'Inside' else 'Exited' end as status, max(ts) as last_event_at
from ev where vehicle_id is not null group by vehicle_id""",
    "dedup_passages": _dedup_chain("select event_id, ts, plate_number, event_type from ev", 21600) + "select * from deduped",
}
ORACLE = {k: with_views(v, recursive="chain as (" in v) for k, v in ORACLE.items()}

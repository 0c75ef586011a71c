"""Queries that search and list the register."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardstream.bindings.register import events
from yardstream.bindings.views import with_views
from yardstream.functions.plate_rules import plate_clean
from yardstream.operators import boxes as B
from yardstream.operators import lookups as L
from yardstream.sources import derived as D


def predictions(s, d):
    cams = D.cameras(s, d).select("camera_id", "gate_name")
    p = plate_clean(F.col("raw_plate"))
    return D.reads(s, d).join(cams, "camera_id").select(
        F.col("read_id").alias("prediction_id"), F.col("raw_plate").alias("raw_text"), p.alias("clean_text"),
        F.when(p == "", F.lit("UNKNOWN")).otherwise(p).alias("fused_text"), "confidence",
        F.when(F.col("confidence") < 0.75, F.lit("manual_review")).otherwise(F.lit("finalized")).alias("status"),
        "gate_name", F.col("ts").alias("created_at"),
    )


def plates(s, d):
    """Two plates per vehicle: an older one and the registered one, some of them inactive."""
    v = D.vehicles(s, d)
    pick = F.inline(F.array(
        F.struct((F.col("vehicle_id") * 2).alias("plate_id"), F.concat(F.lit("OLD"), F.col("vehicle_id").cast("string")).alias("p"), F.lit(False).alias("is_primary"), F.lit(True).alias("is_active")),
        F.struct((F.col("vehicle_id") * 2 + 1).alias("plate_id"), F.col("plate_number").alias("p"), F.lit(True).alias("is_primary"), (F.col("vehicle_id") % 5 != 0).alias("is_active")),
    ))
    return v.select("vehicle_id", pick).withColumnRenamed("p", "plate_number").filter("vehicle_id % 11 <> 0")


def _sources(s, d):
    e, v, t, p = events(s, d), D.vehicles(s, d), D.trips(s, d), predictions(s, d)
    none = F.lit(None).cast("timestamp_ntz").alias("ts")
    a = D.alerts(s, d).join(e.select("event_id", "plate_number"), F.col("alert_id") == F.col("event_id"))
    return {
        "vehicles": v.select(F.col("vehicle_id").alias("id"), F.col("plate_number").alias("plate"), F.col("vehicle_type").alias("detail"), none),
        "events": e.select(F.col("event_id").alias("id"), F.col("plate_number").alias("plate"), F.col("decision").alias("detail"), "ts"),
        "predictions": p.select(F.col("prediction_id").alias("id"), F.col("fused_text").alias("plate"), F.col("status").alias("detail"), F.col("created_at").alias("ts")),
        "trips": t.select(F.col("trip_id").alias("id"), F.col("plate_number").alias("plate"), F.col("status").alias("detail"), F.col("expected_arrival").alias("ts")),
        "whitelist": D.whitelist(s, d).select(F.col("vehicle_id").alias("id"), F.col("plate_number").alias("plate"), F.col("reason").alias("detail"), none),
        "watchlist": D.watchlist(s, d).select(F.col("vehicle_id").alias("id"), F.col("plate_number").alias("plate"), F.col("reason").alias("detail"), none),
        "alerts": a.select(F.col("alert_id").alias("id"), F.col("plate_number").alias("plate"), F.col("alert_type").alias("detail"), F.col("created_at").alias("ts")),
    }


def _inbox(s, d):
    a = D.alerts(s, d)
    return L.alert_inbox(a).select("alert_id", "alert_type", "severity", "created_at", "is_read", L.unread_count(a).scalar().alias("unread"))


def _latest(s, d):
    e = events(s, d).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("plate_number").alias("plate"), "ts")
    p = predictions(s, d).select(F.lit("prediction").alias("kind"), F.col("prediction_id").alias("id"), F.col("fused_text").alias("plate"), F.col("created_at").alias("ts"))
    return L.latest_rows(e, "ts").unionByName(L.latest_rows(p, "ts"))


def _bands(s, d):
    return D.reads(s, d).groupBy(L.confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


def _detection_filter(s, d):
    b = D.boxes(s, d).withColumn("label", F.element_at(F.lit(["person", "car", "truck", "bus", "bike"]), (F.col("box_id") % 5 + 1).cast("int")))
    b = b.withColumn("x2", F.col("x2") + F.when(F.col("box_id") % 6 == 0, F.lit(-75.0)).otherwise(F.lit(0.0)))
    return B.filter_detections(b, 640, 360).select("frame_id", "box_id", "label", "x1", "y1", "x2", "y2", "confidence")


QUERIES = {
    "events_search": lambda s, d: L.search_events(events(s, d), "gate 02", "allow", "entry"),
    "activity_feed": lambda s, d: L.activity_feed(events(s, d)),
    "activity_feed_short": lambda s, d: L.activity_feed(events(s, d), 8, name_transporter=False),
    "alert_inbox": _inbox,
    "alert_inbox_high": lambda s, d: L.alert_inbox(D.alerts(s, d), 50, "high", "Unknown Vehicle").select("alert_id", "alert_type", "severity", "created_at", "is_read"),
    "review_queue": lambda s, d: L.review_queue(predictions(s, d)),
    "vehicle_list": lambda s, d: L.vehicle_list(D.vehicles(s, d), plates(s, d)),
    "driver_list": lambda s, d: L.driver_list(D.drivers(s, d), plates(s, d)),
    "camera_list": lambda s, d: L.camera_list(D.cameras(s, d), D.gates(s, d).filter("gate_id <> 3")),
    "plate_search_all": lambda s, d: L.search_plate(_sources(s, d), "as0"),
    "latest_rows": _latest,
    "vehicle_text_filter": lambda s, d: L.text_filter(D.vehicles(s, d), ["plate_number", "owner_name", "transporter"], "A1").select("vehicle_id", "plate_number"),
    "confidence_bands": _bands,
    "crop_quality_gate": lambda s, d: B.crop_quality(D.crops(s, d)).select("crop_id", "w", "h", "is_usable", "reason", F.round("score", 4).alias("score")),
    "crop_quality_gate_browser": lambda s, d: B.crop_quality_browser(D.crops(s, d)).select("crop_id", "w", "h", "is_usable", "reason"),
    "region_usable": lambda s, d: D.crops(s, d).select("crop_id", B.region_usable(F.col("w"), F.col("h"), F.col("contrast") * 10).alias("usable")),
    "detection_filter": _detection_filter,
    "plate_regions": lambda s, d: B.plate_regions(D.boxes(s, d), 640, 360),
}

_NOTE = "case decision when 'allow' then 'Authorized movement' when 'deny' then {deny} else '{wait}' end"
_FEED = """
select event_id, case when decision='deny' then 'alert' else event_type end as kind, concat(plate_number, case when event_type='entry' then ' entered' else ' exited' end) as title,
  concat(gate_name, ' · ', {note}) as detail, ts,
  case when decision='deny' then 'danger' when decision='manual_review' then 'warning' when row_number() over (order by event_id desc) = 1 then 'accent' else 'muted' end as tone
from (select * from ev order by event_id desc limit {n})"""
_OLD = "concat('OLD', cast(vehicle_id as varchar))"
_PRIMARY = f"(select *, case when vehicle_id%11=0 then null when vehicle_id%5<>0 then plate_number else {_OLD} end as pp from veh)"

ORACLE = {
    "events_search": """
select event_id, plate_number, event_type, gate_name, camera_name, decision, round(confidence, 2) as confidence, ts, vehicle_type, transporter, is_corrected from ev
where (plate_number ilike '%gate 02%' or gate_name ilike '%gate 02%' or transporter ilike '%gate 02%') and decision='allow' and event_type='entry' order by event_id desc limit 100""",
    "activity_feed": _FEED.format(note=_NOTE.format(deny="concat('Access denied (', transporter, ')')", wait="Awaiting manual review"), n=10),
    "activity_feed_short": _FEED.format(note=_NOTE.format(deny="'Access denied'", wait="Awaiting review"), n=8),
    "alert_inbox": "select alert_id, alert_type, severity, created_at, is_read, (select count(*) from alerts where not is_read) as unread from alerts order by alert_id desc limit 50",
    "alert_inbox_high": "select alert_id, alert_type, severity, created_at, is_read from alerts where severity='high' and alert_type='Unknown Vehicle' order by alert_id desc limit 50",
    "review_queue": """
select prediction_id, fused_text as plate, case when raw_text='' then fused_text else raw_text end as raw_text, round(confidence,2) as confidence, gate_name, created_at,
  concat('Low OCR confidence (', cast(cast(trunc(confidence*100) as int) as varchar), '% < 75%) requires operator confirmation') as reason, 'Pending' as status
from preds where status='manual_review' order by prediction_id desc limit 30""",
    "vehicle_list": f"select vehicle_id, coalesce(pp, 'UNKNOWN') as plate, vehicle_type, owner_name, transporter, is_authorized from {_PRIMARY}",
    "driver_list": f"select driver_id, name, license_number, coalesce(pp, 'Unassigned') as plate from drivers left join {_PRIMARY} on vehicle_id = assigned_vehicle_id where is_active",
    "camera_list": "select camera_id, camera_name, case when gate_id=3 then 'Gate 01' else gate_name end as gate_name, direction, status, case when status='online' then 'just now' else 'offline' end as last_seen from cams",
    "plate_search_all": """
with u as (select 'vehicles' as source, vehicle_id as id, plate_number as plate, vehicle_type as detail, cast(null as timestamp) as ts from veh
 union all select 'events', event_id, plate_number, decision, ts from ev union all select 'predictions', prediction_id, fused_text, status, created_at from preds
 union all select 'trips', trip_id, plate_number, status, expected_arrival from trips
 union all select 'whitelist', vehicle_id, plate_number, 'Fleet registration', null from veh where whitelisted
 union all select 'watchlist', vehicle_id, plate_number, 'Security watchlist', null from veh where watchlisted
 union all select 'alerts', a.alert_id, e.plate_number, a.alert_type, a.created_at from alerts a join ev e on e.event_id = a.alert_id)
select * from u where plate ilike '%as0%'""",
    "latest_rows": """
select * from (select 'event' as kind, event_id as id, plate_number as plate, ts from ev order by ts desc limit 5)
union all select * from (select 'prediction', prediction_id, fused_text, created_at from preds order by created_at desc limit 5)""",
    "vehicle_text_filter": "select vehicle_id, plate_number from veh where concat(plate_number,' ',owner_name,' ',transporter) ilike '%a1%'",
    "confidence_bands": "select case when round(confidence*100) >= 90 then 'high' when round(confidence*100) >= 75 then 'medium' else 'low' end as band, count(*) as n from reads group by 1",
    "crop_quality_gate": """
select crop_id, w, h, reason is null as is_usable, reason, case when reason is null then round(least(100.0, sharpness/4.0 + contrast*0.4 + least(w,200)*0.2), 4) else 0.0 end as score
from (select *, case when w<16 or h<6 then 'too_small' when w/h::double < 0.5 or w/h::double > 9.0 then 'bad_aspect_ratio'
  when brightness<10 or brightness>250 or contrast<4.0 then 'poor_exposure' when sharpness<4.0 then 'too_blurry' end as reason from crops)""",
    "crop_quality_gate_browser": """
select crop_id, w, h, reason is null as is_usable, reason from (select *, case when w<30 or h<12 or w*h<360 then 'too_small' when w/h::double < 1.1 or w/h::double > 7.5 then 'bad_aspect_ratio'
  when sharpness<5 then 'too_blurry' end as reason from crops)""",
    "region_usable": "select crop_id, w>=30 and h>=8 and w/h::double between 1.2 and 12 and contrast*10 >= 55 as usable from crops",
    "detection_filter": """
select frame_id, box_id, label, x1, y1, x2, y2, confidence from (
 select frame_id, box_id, ['person','car','truck','bus','bike'][box_id%5+1] as label,
   greatest(0, least(639, cast(floor(x1) as int))) as x1, greatest(0, least(359, cast(floor(y1) as int))) as y1,
   greatest(0, least(640, cast(floor(x2 + case when box_id%6=0 then -75.0 else 0.0 end) as int))) as x2, greatest(0, least(360, cast(floor(y2) as int))) as y2, confidence from boxes)
where label <> 'person' and x2-x1 >= 25 and y2-y1 >= 24""",
    "plate_regions": """
with r as (select * from (values ('front-bottom-center',0.10,0.62,0.80,0.30),('front-bottom-wide',0.02,0.55,0.96,0.42),('top-center',0.15,0.08,0.70,0.25),('mid-center',0.10,0.38,0.80,0.28)) t(label,fx,fy,fw,fh)),
c as (select frame_id, box_id, label, greatest(0.0, least(639.0, x1 + (x2-x1)*fx::double)) as sx, greatest(0.0, least(359.0, y1 + (y2-y1)*fy::double)) as sy, (x2-x1)*fw::double as w0, (y2-y1)*fh::double as h0 from boxes cross join r)
select frame_id, box_id, label, round(sx,4) as sx, round(sy,4) as sy, round(greatest(1.0, least(640-sx, w0)),4) as sw, round(greatest(1.0, least(360-sy, h0)),4) as sh
from c where greatest(1.0, least(640-sx, w0)) >= 25 and greatest(1.0, least(360-sy, h0)) >= 7""",
}
ORACLE = {k: with_views(v) for k, v in ORACLE.items()}

"""Queries over detections and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardstream.bindings.views import with_views
from yardstream.operators import boxes as B
from yardstream.operators import tracking as T
from yardstream.sources import derived as D
from yardstream.sources.tables import staged


def plate_boxes(s, d):
    return D.boxes(s, d).selectExpr(
        "frame_id", "box_id as plate_id", "x1 + (box_id*37)%80 as x1", "y1 + (box_id*11)%60 as y1",
        "x1 + (box_id*37)%80 + 40 as x2", "y1 + (box_id*11)%60 + 14 as y2",
    )


def video_boxes(s, d):
    """Ten frames of boxes make one video; every fourth pause is longer than a track lives."""
    return D.boxes(s, d).selectExpr(
        "cast(floor(frame_id/10) as bigint) as video_id", "frame_id%10 + (case when frame_id%10 >= 5 and floor(frame_id/10)%4 = 0 then 60 else 0 end) as frame_index",
        "box_id", "x1", "y1", "x2", "y2", "confidence",
    )


def tracks(s, d):
    f = D.frames(s, d)
    t = T.track_summary(f, ["track_id"])
    extra = f.groupBy("track_id").agg(
        F.first("true_plate").alias("p"), F.round(F.avg("ocr_confidence"), 6).alias("final_confidence"), F.max_by("ocr_confidence", "frame_number").alias("ocr_confidence"),
    )
    return t.join(extra, "track_id").select(
        (F.col("track_id") % 7).alias("video_id"), "track_id", F.when(F.col("track_id") % 4 != 0, F.col("p")).otherwise(F.lit("")).alias("plate_number"),
        "final_confidence", "ocr_confidence", "vehicle_confidence", "frames_seen", "first_seen_frame", "last_seen_frame", "x1", "y1", "x2", "y2",
    )


def _merge_tracks(s, d):
    t = tracks(s, d).filter("plate_number <> ''")
    return T.merge_tracks(t, T.class_counts(D.frames(s, d), ["track_id"], "vehicle_class"))


def _merge_frames(s, d):
    f = D.frames(s, d).select((F.col("track_id") % 7).alias("video_id"), "track_id", F.col("true_plate").alias("plate"), "frame_number",
                              F.col("raw_text").alias("plate_number"), F.col("ocr_confidence").alias("confidence"))
    return T.merge_frame_predictions(f, ["video_id", "plate"])


def _sides(s, d):
    """Plate-less tracks, and confirmed ones in the order in which they were created."""
    t = staged(tracks(s, d), "tracks").drop("ocr_confidence", "final_confidence")
    return t.filter("plate_number = ''"), t.filter("plate_number <> ''").withColumn("position", F.col("track_id"))


def _plateless(s, d):
    return T.attach_plateless(*_sides(s, d), 1280.0, 720.0).select("video_id", "track_id", "merged_into", "is_kept")


def _budget(s, d):
    b = D.boxes(s, d).select(
        F.col("frame_id").alias("track_id"), F.col("box_id").alias("frame_number"),
        (F.col("box_id") * 150 + F.col("x1") % 100).cast("long").alias("t_ms"),
        (F.col("confidence") >= 0.55).alias("has_text"), (F.col("confidence") >= 0.75).alias("confirms"),
    )
    return T.reading_budget(b)


def _live_budget(s, d):
    b = D.boxes(s, d).select(
        F.col("frame_id").alias("track_id"), F.col("box_id").alias("frame_number"),
        (F.col("box_id") * 150 + F.col("x1") % 100).cast("long").alias("t_ms"), F.lit(True).alias("has_text"), F.lit(False).alias("confirms"),
    )
    return T.reading_budget(b, max_attempts=8, max_reads=8, cooldown_ms=200, frame_gap=0).select("track_id", "frame_number", "run_ocr")


QUERIES = {
    "box_iou": lambda s, d: B.box_pairs(D.boxes(s, d)),
    "plate_in_vehicle": lambda s, d: B.plates_in_vehicles(plate_boxes(s, d), D.boxes(s, d).withColumnRenamed("box_id", "vehicle_id")),
    "nms_class_agnostic": lambda s, d: B.suppress_boxes(D.boxes(s, d)).select("frame_id", "box_id", "confidence"),
    "nms_plain": lambda s, d: B.suppress_boxes(D.boxes(s, d), 0.45, None, iou_inclusive=False).select("frame_id", "box_id", "confidence"),
    "track_assign": lambda s, d: T.assign_tracks(video_boxes(s, d)).select("video_id", "frame_index", "box_id", "track_id"),
    "track_assign_live": lambda s, d: T.assign_tracks(video_boxes(s, d), max_missed=0).select("video_id", "frame_index", "box_id", "track_id"),
    "track_assign_velocity": lambda s, d: T.assign_tracks(video_boxes(s, d), "velocity").select("video_id", "frame_index", "box_id", "track_id"),
    "track_summary": lambda s, d: T.track_summary(D.frames(s, d), ["track_id"]),
    "dominant_class": lambda s, d: T.dominant_class(D.frames(s, d), ["track_id"], "vehicle_class", "frame_number"),
    "merge_tracks": _merge_tracks,
    "rank_detections": lambda s, d: T.rank_detections(tracks(s, d)).select("video_id", "track_id", "plate_number", F.col("detection_no").cast("long").alias("detection_no")),
    "merge_frame_predictions": _merge_frames,
    "merge_plateless": _plateless,
    "consolidated_tracks": lambda s, d: T.consolidate_tracks(*_sides(s, d), 1280.0, 720.0),
    "last_n_observations": lambda s, d: T.last_observations(D.frames(s, d), ["track_id"], "frame_number", 3).select("track_id", "frame_number", "raw_text"),
    "frame_sampling": lambda s, d: T.sample_frames(D.frames(s, d), 15.0, 6.0).select("track_id", "frame_number"),
    "ocr_budget": _budget,
    "ocr_budget_live": _live_budget,
    "fps_per_second": lambda s, d: T.frames_per_second(D.table(s, d, "events")),
}

_INTER = "greatest(0.0, least({a}x2,{b}x2)-greatest({a}x1,{b}x1)) * greatest(0.0, least({a}y2,{b}y2)-greatest({a}y1,{b}y1))"
_I = _INTER.format(a="a.", b="b.")
_A = "(a.x2-a.x1)*(a.y2-a.y1)"
_B = "(b.x2-b.x1)*(b.y2-b.y1)"


def _nms(condition: str) -> str:
    inter = "greatest(0.0, least(k.x2, e.x2)-greatest(k.x1, e.x1)) * greatest(0.0, least(k.y2, e.y2)-greatest(k.y1, e.y1))"
    ae, ak = "greatest(1.0, (e.x2-e.x1)*(e.y2-e.y1))", "greatest(1.0, (k.x2-k.x1)*(k.y2-k.y1))"
    cond = condition.format(i=inter, iou=f"({inter}) / ({ae} + {ak} - {inter})", con=f"({inter}) / least({ae}, {ak})")
    return f"""
with o as (select *, row_number() over (partition by frame_id order by confidence desc, box_id) as rn from boxes),
w as (select frame_id, rn, box_id, confidence, true as keep, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] as kept from o where rn = 1
  union all
  select frame_id, rn, box_id, confidence, keep, case when keep then list_append(kept, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) else kept end
  from (select e.*, w.kept, len(list_filter(w.kept, lambda k: ({inter}) > 0 and ({cond}))) = 0 as keep from w join o e on e.frame_id = w.frame_id and e.rn = w.rn + 1))
select frame_id, box_id, confidence from w where keep"""


def _budget_sql(attempts: int, reads: int, cool: int, gap: int, text: str, confirms: str, columns: str) -> str:
    run = f"not w.conf and w.att < {attempts} and w.rd < {reads} and e.t_ms - w.lt >= {cool} and e.frame_number - w.lf >= {gap}"
    return f"""
with o as (select frame_id as track_id, box_id as frame_number, cast(box_id*150 + x1%100 as bigint) as t_ms, {text} as has_text, {confirms} as confirms,
   row_number() over (partition by frame_id order by box_id*150 + x1%100, box_id) as rn from boxes),
w as (select track_id, rn, frame_number, t_ms, has_text, confirms, true as run, 1 as att, case when has_text then 1 else 0 end as rd, t_ms as lt, frame_number as lf, has_text and confirms as conf from o where rn = 1
  union all
  select e.track_id, e.rn, e.frame_number, e.t_ms, e.has_text, e.confirms, {run}, case when {run} then w.att+1 else w.att end, case when {run} and e.has_text then w.rd+1 else w.rd end,
    case when {run} then e.t_ms else w.lt end, case when {run} then e.frame_number else w.lf end, case when {run} then e.has_text and e.confirms else w.conf end
  from w join o e on e.track_id = w.track_id and e.rn = w.rn + 1)
select {columns} from w"""


def _track_sql(alive: int, velocity: bool) -> str:
    """The greedy association as a recursion over the detections of every video: the live tracks are a list."""
    moved = {c: f"(k.{c} + k.{c[0]}1 - k.b{c[0]})" if velocity else f"k.{c}" for c in ("x1", "y1", "x2", "y2")}
    overlap = " * ".join(f"greatest(0.0, least({moved[a + '2']}, e.{a}2) - greatest({moved[a + '1']}, e.{a}1))" for a in "xy")
    area = lambda x: f"(greatest(0.0, {x['x2']} - {x['x1']}) * greatest(0.0, {x['y2']} - {x['y1']}))"
    own = {c: f"e.{c}" for c in ("x1", "y1", "x2", "y2")}
    union = f"({area(own)} + {area(moved)} - {overlap})"
    iou = f"(case when {union} > 0 then ({overlap}) / {union} else 0.0 end)"
    gap = lambda a: f"(abs((e.{a}1 + e.{a}2) / 2.0 - (k.{a}1 + k.{a}2) / 2.0) / greatest(1.0, greatest(e.{a}2 - e.{a}1, k.{a}2 - k.{a}1)))"
    far = f"sqrt({gap('x')} * {gap('x')} + {gap('y')} * {gap('y')})"
    near = f"(case when {iou} > 0.15 or {far} < 0.40 then case when {far} < 0.8 then {iou} + greatest(0.0, (1.0 - {far}) * 0.4) else {iou} end else 0.0 end)"
    score = f"(case when {iou} > 0.2 then {iou} else 0.0 end)" if velocity else near
    fresh = "{'id': %s, 'x1': e.x1, 'y1': e.y1, 'x2': e.x2, 'y2': e.y2, 'bx': %s, 'by': %s, 'f': e.f}"
    return f"""
with v as (select cast(floor(frame_id/10) as bigint) as video_id, cast(frame_id%10 + (case when frame_id%10 >= 5 and floor(frame_id/10)%4 = 0 then 60 else 0 end) as bigint) as f, box_id, x1::double as x1, y1::double as y1, x2::double as x2, y2::double as y2, confidence from boxes),
o as materialized (select *, row_number() over (partition by video_id order by f, confidence desc, box_id) as rn from v),
w as (select e.video_id, e.f, e.box_id, e.rn, 1::bigint as track_id, 2::bigint as next, [{fresh % ("1::bigint", "e.x1", "e.y1")}] as live from o e where rn = 1
  union all
  select video_id, f, box_id, rn, coalesce(hit.id, next), case when hit is null then next + 1 else next end,
    case when hit is null then list_append(live, {fresh.replace("e.", "") % ("next", "x1", "y1")})
      else list_transform(live, lambda k: case when k.id = hit.id then {fresh.replace("e.", "") % ("k.id", "k.x1", "k.y1")} else k end) end
  from (select *, case when list_max(scores) > 0 then live[list_position(scores, list_max(scores))] end as hit
    from (select e.*, w.next, list_filter(w.live, lambda k: k.f >= e.f - 1 - {alive}) as live,
      list_transform(list_filter(w.live, lambda k: k.f >= e.f - 1 - {alive}), lambda k: case when k.f = e.f then 0.0 else {score} end) as scores
      from w join o e on e.video_id = w.video_id and e.rn = w.rn + 1)))
select video_id, cast(f as int) as frame_index, box_id, track_id from w"""


_TRACKS = """(select track_id%7 as video_id, track_id, case when track_id%4<>0 then min(true_plate) else '' end as plate_number, round(avg(ocr_confidence),6) as final_confidence,
  arg_max(ocr_confidence, frame_number) as ocr_confidence, max(ocr_confidence) as vehicle_confidence, count(*) as frames_seen, min(frame_number) as first_seen_frame, max(frame_number) as last_seen_frame,
  arg_max(x1, frame_number) as x1, arg_max(y1, frame_number) as y1, arg_max(x2, frame_number) as x2, arg_max(y2, frame_number) as y2 from frames group by track_id)"""

_PLACE = "(({i}) / ({a} + {b} - {i}) > 0.20 or (abs((a.x1+a.x2)/2-(b.x1+b.x2)/2)/1280.0 < 0.22 and abs((a.y1+a.y2)/2-(b.y1+b.y2)/2)/720.0 < 0.35))".format(i=_I, a=_A, b=_B)
_MERGED = f"""
with t as materialized (select * from {_TRACKS}), c as (select * from t where plate_number <> ''), n as (select *, row_number() over (partition by video_id order by track_id) as rn from t where plate_number = ''),
m as materialized (select a.track_id, min(b.track_id) as owner from n a join c b on b.video_id = a.video_id and {_PLACE} group by 1),
o as materialized (select n.*, m.owner as seen from n left join m using (track_id)),
w as (select video_id, rn, track_id, seen as owner, seen is null and frames_seen >= 2 as keep, case when seen is null and frames_seen >= 2 then [{{'id': track_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] else [] end as kept from o where rn = 1
  union all
  select video_id, rn, track_id, owner, owner is null and frames_seen >= 2, case when owner is null and frames_seen >= 2 then list_append(kept, {{'id': track_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) else kept end
  from (select a.*, w.kept, coalesce(a.seen, list_filter(w.kept, lambda b: {_PLACE})[1].id) as owner from w join o a on a.video_id = w.video_id and a.rn = w.rn + 1))
"""

ORACLE = {
    "box_iou": f"""
select frame_id, box_id, w, h, area, iou, sqrt(dx*dx + dy*dy) as center_distance, containment from (
 select a.frame_id, a.box_id, a.x2-a.x1 as w, a.y2-a.y1 as h, {_A} as area, ({_I}) / ({_A} + {_B} - {_I}) as iou,
  abs((a.x1+a.x2)/2.0-(b.x1+b.x2)/2.0)/greatest(1.0,a.x2-a.x1,b.x2-b.x1) as dx, abs((a.y1+a.y2)/2.0-(b.y1+b.y2)/2.0)/greatest(1.0,a.y2-a.y1,b.y2-b.y1) as dy, ({_I}) / ({_A}) as containment
 from boxes a join boxes b on b.frame_id = a.frame_id and b.box_id = a.box_id + 1)""",
    "plate_in_vehicle": f"""
select a.frame_id, a.plate_id, b.box_id as vehicle_id
from (select frame_id, box_id as plate_id, x1+(box_id*37)%80 as x1, y1+(box_id*11)%60 as y1, x1+(box_id*37)%80+40 as x2, y1+(box_id*11)%60+14 as y2 from boxes) a
join boxes b on b.frame_id = a.frame_id where ((a.x1+a.x2)/2 between b.x1-25 and b.x2+25 and (a.y1+a.y2)/2 between b.y1-25 and b.y2+25) or ({_I}) / ({_A}) > 0.40""",
    "nms_class_agnostic": _nms("{iou} >= 0.35 or {con} >= 0.50"),
    "nms_plain": _nms("{iou} > 0.45"),
    "track_assign": _track_sql(30, False),
    "track_assign_live": _track_sql(0, False),
    "track_assign_velocity": _track_sql(10, True),
    "track_summary": """
select track_id, min(frame_number) as first_seen_frame, max(frame_number) as last_seen_frame, count(*) as frames_seen, max(ocr_confidence) as vehicle_confidence,
 arg_max(x1, frame_number) as x1, arg_max(y1, frame_number) as y1, arg_max(x2, frame_number) as x2, arg_max(y2, frame_number) as y2 from frames group by 1""",
    "dominant_class": """
select track_id, vehicle_class as dominant_class, cast(t as bigint) as frames_seen from (select *, sum(n) over (partition by track_id) as t, row_number() over (partition by track_id order by n desc, f) as rn
 from (select track_id, vehicle_class, count(*) as n, min(frame_number) as f from frames group by 1,2)) where rn = 1""",
    "merge_tracks": f"""
with t as (select * from {_TRACKS} where plate_number <> ''),
r as (select *, row_number() over (partition by video_id, plate_number order by final_confidence desc, ocr_confidence desc, frames_seen desc, track_id) as rn from t),
m as (select track_id, video_id, plate_number, max(case when rn=1 then track_id end) over (partition by video_id, plate_number) as can from r),
c as (select m.video_id, m.plate_number, m.track_id, m.can, f.vehicle_class, count(*) as n, min(frame_number) as ff from m join frames f on f.track_id = m.track_id group by 1,2,3,4,5),
s as (select video_id, plate_number, vehicle_class, sum(n) as n, min(case when track_id = can then ff end) as cf, min(case when track_id <> can then track_id end) as ot,
   arg_min(ff, track_id) filter (track_id <> can) as of from c group by 1,2,3),
k as (select *, row_number() over (partition by video_id, plate_number order by n desc, case when cf is not null then 0 else 1 end, cf, ot, of) as rk from s)
select r.video_id, r.plate_number, max(case when rn=1 then r.track_id end) as track_id, min(first_seen_frame) as first_seen_frame, max(last_seen_frame) as last_seen_frame,
 cast(sum(frames_seen) as bigint) as frames_seen, max(vehicle_confidence) as vehicle_confidence, max(final_confidence) as final_confidence, count(*) as merged_tracks, max(k.vehicle_class) as vehicle_class
from r join k on k.video_id = r.video_id and k.plate_number = r.plate_number and k.rk = 1 group by 1,2""",
    "rank_detections": f"""
select video_id, track_id, plate_number, row_number() over (partition by video_id order by case when length(plate_number)>=4 then 1 else 0 end desc, final_confidence desc, vehicle_confidence desc, frames_seen desc, track_id) as detection_no
from {_TRACKS}""",
    "merge_frame_predictions": """
select video_id, plate, frame_number, track_id, plate_number, confidence from (
 select track_id%7 as video_id, true_plate as plate, frame_number, track_id, raw_text as plate_number, ocr_confidence as confidence,
  row_number() over (partition by track_id%7, true_plate, frame_number order by track_id) as rn from frames) where rn = 1""",
    "merge_plateless": _MERGED + "select video_id, track_id, case when not keep then owner end as merged_into, keep as is_kept from w",
    "consolidated_tracks": _MERGED + """, z as (select video_id, case when keep or owner is null then track_id else owner end as track_id, track_id as member, case when keep then false end as has_plate from w where keep or owner is not null
  union all select video_id, track_id, track_id, true from t where plate_number <> '')
select z.video_id, z.track_id, bool_or(z.has_plate) as has_plate, min(first_seen_frame) as first_seen_frame, max(last_seen_frame) as last_seen_frame, cast(sum(frames_seen) as bigint) as frames_seen, max(vehicle_confidence) as vehicle_confidence, count(*) as merged_tracks
from z join t on t.track_id = z.member group by 1, 2""",
    "last_n_observations": "select track_id, frame_number, raw_text from (select *, row_number() over (partition by track_id order by frame_number desc) as rn from frames) where rn <= 3",
    "frame_sampling": "select track_id, frame_number from frames where frame_number % 2 = 0",
    "ocr_budget": _budget_sql(4, 3, 400, 2, "confidence >= 0.55", "confidence >= 0.75", "track_id, frame_number, t_ms, has_text, confirms, run as run_ocr"),
    "ocr_budget_live": _budget_sql(8, 8, 200, 0, "true", "false", "track_id, frame_number, run as run_ocr"),
    "fps_per_second": "select date_trunc('second', ts) as second, count(*) as fps from events group by 1",
}
ORACLE = {k: with_views(v, recursive=("w as (select" in v)) for k, v in ORACLE.items()}

"""Queries that fuse several reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardstream.bindings.plates import browser_sql, normalize_sql, validate_sql, _list, _CONF_PAIRS
from yardstream.bindings.views import with_views
from yardstream.functions import plate_rules as P
from yardstream.operators import fusion as X
from yardstream.operators.recognition import frame_quality
from yardstream.sources import derived as D


def _fused(s, d, detail=False):
    return X.fuse_tracks(D.frames(s, d), detail=detail)


_SCALARS = ("track_id", "plate_number", "display_plate", "status", "final_confidence", "frame_count", "evidence_count", "agreement_ratio", "is_finalized", "vehicle_type")


def _candidates(s, d):
    c = F.explode("all_candidates").alias("c")
    return _fused(s, d).select("track_id", c).select("track_id", "c.plate", "c.confidence", "c.count", "c.agreement")


def _evidence(s, d):
    p = F.explode("supporting_predictions").alias("p")
    return _fused(s, d, detail=True).select("track_id", p).select("track_id", "p.plate", "p.confidence", "p.frame", "p.is_valid")


def _vote(s, d):
    f = D.frames(s, d).withColumn("plate", P.plate_clean(F.col("raw_text")))
    spelled = f.groupBy("track_id", "plate").agg(
        F.count("*").alias("n"), F.sum(F.greatest(F.lit(0.1), F.col("ocr_confidence"))).alias("weight"), F.min("frame_number").alias("seen")
    )
    return X.vote_positions(spelled, ["track_id"])


def _variants(s, d):
    t = D.texts(s, d).withColumn("crop_id", F.floor(F.col("read_id") / 6)).withColumn("clean", P.plate_clean(F.col("text")))
    t = P.validate_plates(t, "text", "v", "browser")
    ocr = F.col("confidence") - F.when(F.col("crop_id") % 5 == 0, 0.7).otherwise(0.35)
    return t.select(
        "crop_id", F.col("read_id").alias("variant_no"), F.col("clean").alias("text"), F.round(ocr, 4).alias("ocr_confidence"),
        F.col("v_conf").alias("validation_confidence"), F.col("v_status").alias("validation_status"),
        F.round(F.col("v_conf") * 0.5 + ocr * 0.5, 6).alias("candidate_score"),
    )


def _browser(faithful):
    def run(s, d):
        f = D.frames(s, d).select(
            "track_id", "frame_number", F.col("raw_text").alias("text"), "ocr_confidence",
            (F.col("ocr_confidence") * 0.8).alias("validation_confidence"), F.col("plate_confidence").alias("detection_confidence"),
        )
        return X.fuse_frames_browser(f, faithful)

    return run


def _clips(s, d):
    f = D.frames(s, d)
    text = F.when(F.col("frame_number") % 5 != 4, F.col("raw_text"))
    return X.fuse_clips(f.select(
        F.col("track_id").alias("clip_id"), "frame_number", text.alias("text"),
        frame_quality(F.col("x1") > 100, F.col("y1") > 50, F.when(text.isNotNull(), F.col("ocr_confidence"))).alias("quality"),
        F.when(F.col("x1") > 100, F.col("vehicle_class")).alias("vehicle_class"),
    ))


QUERIES = {
    "char_vote": _vote,
    "track_fusion": lambda s, d: _fused(s, d).select(*_SCALARS),
    "track_fusion_candidates": _candidates,
    "track_fusion_evidence": _evidence,
    "track_fusion_live": lambda s, d: X.fuse_tracks(D.frames(s, d), 10, 3, 0.60, 0.60, force=False, strict_evidence=True, detail=False).select(*_SCALARS),
    "variant_fusion": lambda s, d: X.fuse_variants(_variants(s, d), ["crop_id"]),
    "frame_fusion_browser": _browser(True),
    "frame_fusion_browser_single_swap": _browser(False),
    "clip_fusion": _clips,
}


# --- SQL ---------------------------------------------------------------------------
def _vote_sql(source: str, keys: str) -> str:
    """keys and ``voted`` from spelled rows (keys, plate, n, weight, seen)."""
    return f"""
(select {keys}, string_agg(ch, '' order by pos) as voted from (
  select {keys}, pos, case when pos = 5 and jw is not null and (bw is not null or ew is not null) and jw >= coalesce(bw, 0.0)*0.7 then 'J' else best end as ch
  from (select {keys}, pos, max(case when rn=1 then ch end) as best, max(case when ch='J' then w end) as jw, max(case when ch='B' then w end) as bw, max(case when ch='8' then w end) as ew
    from (select *, row_number() over (partition by {keys}, pos order by round(w, 9) desc, sn) as rn
      from (select {keys}, pos, substr(plate, pos, 1) as ch, sum(weight) as w, min(seen) as sn
        from (select *, unnest(range(1, length(plate)+1)) as pos from (
           select * from (select *, dense_rank() over (partition by {keys} order by ln desc, length(plate)) as lr
              from (select *, sum(n) over (partition by {keys}, length(plate)) as ln from {source} where length(plate) >= 8)) where lr = 1))
        group by {keys}, pos, ch)) group by {keys}, pos)) group by {keys})"""


_S = _list(P.FUSION.states)
_PAIR_DIST = f"""list_reduce(list_transform(range(1, length(a)+1), lambda i: [cast(i as double)]),
   lambda prev, r: list_reduce(list_transform(range(1, length(b)+1), lambda j: [cast(j as double)]),
     lambda cur, q: list_append(cur, least(prev[cast(q[1] as int)+1] + 1.0, cur[cast(q[1] as int)] + 1.0, prev[cast(q[1] as int)] +
        case when substr(a, cast(r[1] as int), 1) = substr(b, cast(q[1] as int), 1) then 0.0
             when concat(substr(a, cast(r[1] as int), 1), substr(b, cast(q[1] as int), 1)) in {_CONF_PAIRS} then 0.15 else 1.0 end)), r),
   list_transform(range(0, length(b)+1), lambda z: cast(z as double)))[-1]"""


def _fusion_sql(min_obs: int, min_conf: float, min_agree: float, force: bool, strict: bool, final: str) -> str:
    val = lambda source, col: validate_sql(source, col, P.FUSION)
    loose = "" if strict else "or (valid and confidence >= 0.65)"
    forced = "or ((valid or confidence >= 0.50) and not conflict)" if force else ""
    return f"""
with base as (select track_id, frame_number, raw_text, ocr_confidence, plate_confidence, vehicle_class, plate, is_valid from {val(normalize_sql('(select * from frames)', 'raw_text', P.FUSION, 'nn'), 'nn')} where length(plate) >= 4),
obs as (select *, row_number() over (partition by track_id order by frame_number) - 1 as seen, count(*) over (partition by track_id) as total
   from (select *, row_number() over (partition by track_id order by frame_number desc) as back from base) where back <= 30),
sp as (select track_id, plate, min(seen) as f, row_number() over (partition by track_id order by min(seen)) as idx from obs group by 1, 2),
upairs as (select distinct x.plate as a, y.plate as b from sp x join sp y on y.track_id = x.track_id and y.idx < x.idx),
dist as (select a, b, {_PAIR_DIST} as dd from upairs),
near as (select a, b from dist where dd <= 1.5 or round(greatest(0.0, 1.0 - dd / greatest(length(a), length(b))), 3) >= 0.75),
cl as (select x.track_id, x.plate, x.idx, coalesce(list(y.idx order by y.idx) filter (n.a is not null), cast([] as bigint[])) as close
   from sp x left join sp y on y.track_id = x.track_id and y.idx < x.idx left join near n on n.a = x.plate and n.b = y.plate group by 1, 2, 3),
walk as (
  select track_id, plate, idx, [idx] as founders, idx as home from cl where idx = 1
  union all
  select c.track_id, c.plate, c.idx, case when len(list_intersect(c.close, w.founders)) = 0 then list_append(w.founders, c.idx) else w.founders end,
    coalesce(list_min(list_intersect(c.close, w.founders)), c.idx)
  from walk w join cl c on c.track_id = w.track_id and c.idx = w.idx + 1),
rws as (select o.*, w.home as cluster from obs o join walk w on w.track_id = o.track_id and w.plate = o.plate),
spelled as (select track_id, cluster, plate, count(*) as n, sum(ocr_confidence) as so, min(seen) as seen, sum(greatest(0.1, ocr_confidence)) as weight from rws group by 1, 2, 3),
graded as (select track_id, cluster, p0, so, seen, plate as vplate, is_valid, conf from {val('(select track_id, cluster, plate as p0, so, seen from spelled)', 'p0')}),
best as (select * from (select *, row_number() over (partition by track_id, cluster order by round(so * case when is_valid and p0[1:2] in {_S} then 2.5 when is_valid then 1.4 else 0.8 end, 9) desc, seen) as rn from graded) where rn = 1),
voted as (select track_id, cluster, voted, plate as wplate, is_valid as wvalid, conf as wconf from {val(_vote_sql('spelled', 'track_id, cluster'), 'voted')}),
st as (select track_id, cluster, count(*) as cnt, max(total) as total, avg(ocr_confidence) as ao, max(ocr_confidence) as mo, avg(plate_confidence) as ap from rws group by 1, 2),
cand as (select s.*, case when v.voted is not null and cnt >= 2 and (wvalid or wconf >= b.conf) then wplate else b.vplate end as plate,
   case when v.voted is not null and cnt >= 2 and (wvalid or wconf >= b.conf) then wvalid else b.is_valid end as valid,
   case when v.voted is not null and cnt >= 2 and (wvalid or wconf >= b.conf) then greatest(wconf, b.conf) else b.conf end as syn
   from st s join best b on b.track_id = s.track_id and b.cluster = s.cluster left join voted v on v.track_id = s.track_id and v.cluster = s.cluster),
ranked as (select *, row_number() over (partition by track_id order by round(cnt*3.5 + cnt::double/total*20.0 + ao*30.0 + mo*10.0 + ap*10.0
     + case when valid then 25.0 else 0.0 end + case when plate[1:2] in {_S} then 15.0 else 0.0 end, 9) desc, cluster) as rn,
   count(*) over (partition by track_id) as cands,
   round(round(greatest(0.10, least(0.99, ao*0.40 + cnt::double/total*0.25 + syn*0.25 + least(1.0, cnt/{float(min_obs)})*0.10)), 9), 2) as confidence, round(cnt::double/total, 2) as agreement from cand),
win as (select *, cands >= 2 and agreement < {min_agree} and cnt <= 1 as conflict from ranked where rn = 1),
decided as (select *, case when ((cnt >= {min_obs} and confidence >= {min_conf} and agreement >= {min_agree}) {loose}) and not conflict {forced} then 'finalized' else '{'manual_review' if force else 'pending'}' end as status from win),
kinds as (select track_id, arg_max(vehicle_class, frame_number) as vehicle_type from frames group by 1)
{final}"""


_FINAL = """
select d.track_id, case when status='finalized' then plate else '' end as plate_number,
  case status when 'finalized' then plate when 'manual_review' then 'Requires Manual Review' else 'Recognizing...' end as display_plate, status, confidence as final_confidence,
  cast(total as int) as frame_count, cnt as evidence_count, agreement as agreement_ratio, status <> 'pending' as is_finalized, vehicle_type
from decided d join kinds k on k.track_id = d.track_id"""
_VARIANTS = f"""(select crop_id, read_id as variant_no, c as text, round(ocr, 4) as ocr_confidence, conf as validation_confidence, status as validation_status, round(conf*0.5 + ocr*0.5, 6) as candidate_score
 from (select *, confidence - case when crop_id%5=0 then 0.7 else 0.35 end as ocr from {browser_sql("(select *, cast(floor(read_id/6) as bigint) as crop_id from texts)", "text")}))"""


def _browser_fusion_sql(swaps: int) -> str:
    expr = "regexp_replace(upper(raw_text), '[^A-Z0-9]', '', 'g')"
    for _ in range(swaps):
        expr = f"translate({expr}, 'OQILZSBG01568', '00112586OISGB')"
    return f"""
with t as (select track_id, {expr} as plate, count(*) as n, sum(ocr_confidence) as so, avg(ocr_confidence) as o, avg(ocr_confidence*0.8) as v, avg(plate_confidence) as dd, min(frame_number) as f, max(frame_number) as l
   from frames where length(regexp_replace(upper(raw_text), '[^A-Z0-9]', '', 'g')) >= 4 group by 1, 2),
r as (select *, row_number() over (partition by track_id order by case when n >= 3 then 1 else 0 end desc, case when n >= 3 then n end desc, case when n >= 3 then round(so, 9) end desc,
      case when n < 3 then round(n*0.55 + o*0.35 + v*0.25 + dd*0.15, 9) end desc, f) as rn, sum(n) over (partition by track_id) as fc, count(*) over (partition by track_id) as dp,
      min(f) over (partition by track_id) as ff, max(l) over (partition by track_id) as ll from t)
select track_id, plate as best_plate, round((o+v+dd)/3, 3) as confidence, round(o,3) as ocr_confidence, round(v,3) as validation_confidence, round(dd,3) as detection_confidence,
 case when n >= 3 or (o >= 0.40 and v >= 0.40) then 'VALID' else 'LOW_CONFIDENCE' end as validation_status, n as frame_agreement, cast(fc as bigint) as frame_count, dp as distinct_plates, ff as first_frame, ll as last_frame
from r where rn = 1"""


_PLAIN = (1, 0.50, 0.40, True, False)
ORACLE = {
    "char_vote": f"select track_id, voted from {_vote_sql('''(select track_id, regexp_replace(upper(raw_text), '[^A-Z0-9]', '', 'g') as plate, count(*) as n, sum(greatest(0.1, ocr_confidence)) as weight, min(frame_number) as seen from frames group by 1, 2)''', 'track_id')}",
    "track_fusion": _fusion_sql(*_PLAIN, _FINAL),
    "track_fusion_candidates": _fusion_sql(*_PLAIN, "select track_id, plate, confidence, cnt as count, agreement from ranked"),
    "track_fusion_evidence": _fusion_sql(*_PLAIN, """select r.track_id, r.plate, round(r.ocr_confidence, 2) as confidence, r.frame_number as frame, r.is_valid
from rws r join win w on w.track_id = r.track_id and w.cluster = r.cluster"""),
    "track_fusion_live": _fusion_sql(3, 0.60, 0.60, False, True, _FINAL),
    "variant_fusion": f"""
with v as (select *, length(text) >= 4 and ocr_confidence >= 0.25 as ok from {_VARIANTS}),
g as (select crop_id, text, count(*) as n, avg(validation_confidence*0.40 + ocr_confidence*0.40) + count(*)*0.20 as sc, avg(validation_confidence) as vc, min(variant_no) as f from v where ok group by 1, 2),
bv as (select *, row_number() over (partition by crop_id, text order by candidate_score desc, variant_no) as rn from v where ok),
w as (select *, row_number() over (partition by crop_id order by round(sc, 9) desc, f) as rn from g),
l as (select *, row_number() over (partition by crop_id order by variant_no) as rn, max(ocr_confidence) over (partition by crop_id) as mx, count(*) over (partition by crop_id) as nv from v)
select l.crop_id, case when w.crop_id is not null then w.text else l.text end as plate_text, case when w.crop_id is not null then bv.ocr_confidence else l.mx end as ocr_confidence,
 round(case when w.crop_id is not null then w.vc else l.validation_confidence end, 4) as validation_confidence, case when w.crop_id is not null then bv.validation_status else 'LOW_CONFIDENCE' end as validation_status,
 coalesce(w.n, 0) as variant_agreement, l.nv as variants
from l left join w on w.crop_id = l.crop_id and w.rn = 1 left join bv on bv.crop_id = w.crop_id and bv.text = w.text and bv.rn = 1 where l.rn = 1""",
    "frame_fusion_browser": _browser_fusion_sql(2),
    "frame_fusion_browser_single_swap": _browser_fusion_sql(1),
}
ORACLE = {k: with_views(v, recursive="walk as (" in v) for k, v in ORACLE.items()}

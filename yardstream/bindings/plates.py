"""Queries over plate texts: rules, distances, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardstream.bindings.views import with_views
from yardstream.functions import distance as X
from yardstream.functions import plate_rules as P
from yardstream.operators import recognition as G
from yardstream.sources import derived as D


def _normalize(s, d):
    return P.normalize_plates(D.texts(s, d), "text", "plate").select("read_id", "text", "plate")


def _validate(profile):
    def run(s, d):
        df = P.validate_plates(D.texts(s, d), "text", "v", profile)
        extra = [F.col(f"v_{c}").alias(c) for c in ("status", "pattern", "corrections")] if profile == "browser" else []
        return df.select("read_id", "text", F.col("v_valid").alias("is_valid"), F.col("v_conf").alias("conf"), F.col("v_plate").alias("plate"), *extra)

    return run


def _pattern_mix(s, d):
    df = P.validate_plates(D.texts(s, d), "text", "v", "browser")
    return df.groupBy(F.coalesce("v_pattern", F.lit("NONE")).alias("pattern")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("v_corrections", F.lit(0))).alias("corrections")
    )


def _swap(s, d):
    once = P.swap_browser(P.plate_clean(F.col("text")))
    return D.texts(s, d).select("read_id", once.alias("once"), P.swap_browser(once).alias("twice"))


def _consensus(s, d):
    f = D.frames(s, d)
    conf = F.round(0.75 + (F.col("frame_number") - 1) * 0.04, 2)
    df = G.detection_consensus(f.withColumn("c", conf), ["track_id"], "raw_text", "c", "frame_number")
    v = D.vehicles(s, d).select(F.col("plate_number").alias("_vp"), "is_authorized")
    df = df.join(v, F.col("final_plate") == F.col("_vp"), "left")
    return df.select(
        "track_id", "raw_plate", "final_plate", "confidence", "is_corrected", "n_frames",
        G.submission_decision(F.col("is_authorized"), F.col("confidence")).alias("decision"),
    )


def _folded(s, d):
    return G.match_known_plates(D.texts(s, d).select("read_id", "text"), D.vehicles(s, d), "text", "vehicle_id")


def _state_mix(s, d):
    return D.texts(s, d).groupBy(P.state_code(P.plate_key(F.col("text"))).alias("state")).agg(F.count("*").alias("n"))


def _best_candidate(s, d):
    return G.best_candidate(D.frames(s, d), ["track_id"], "raw_text", "ocr_confidence", "frame_number")


def _quality(s, d):
    t = D.texts(s, d)
    conf = F.when(F.col("text").rlike(P.CLIP_LOOSE), F.col("confidence"))
    return t.select("read_id", F.round(G.frame_quality(F.col("read_id") % 3 != 0, F.col("read_id") % 4 != 0, conf), 6).alias("quality"))


def _score(s, d):
    t = D.texts(s, d).withColumn("crop_id", F.floor(F.col("read_id") / 8))
    return G.score_candidates(t, ["crop_id"], "text", "confidence", "read_id")


def _service_best(s, d):
    t = D.texts(s, d).withColumn("crop_id", F.floor(F.col("read_id") / 8))
    return G.service_best_text(t, ["crop_id"], "text", "confidence", "read_id")


def _tokens(s, d):
    f = D.frames(s, d).withColumn("token", F.substring("raw_text", 1, 3))
    return G.assemble_tokens(f, ["track_id"], "token", "ocr_confidence", "x1", "y1", "frame_number")


def _gates(s, d):
    c = F.col("confidence") * 2 - 0.75
    return D.texts(s, d).select(
        "read_id", F.round(P.confidence_gate(c), 6).alias("gated"),
        ((c >= 0.25) & (F.length(P.plate_clean(F.col("text"))) >= 4)).alias("in_pool"),
    )


def _pairs(s, d):
    """Distinct (read, true plate) pairs: the distance is computed once per pair."""
    f = D.frames(s, d).select(P.plate_clean(F.col("raw_text")).alias("a"), F.col("true_plate").alias("b"))
    return f.groupBy("a", "b").agg(F.count("*").alias("n"))


def _confusion(s, d):
    return _pairs(s, d).withColumn("distance", F.round(X.confusion_distance(F.col("a"), F.col("b")), 6))


def _similarity(s, d):
    df = _pairs(s, d).withColumn("_d", X.confusion_distance(F.col("a"), F.col("b")))
    return df.select("a", "b", X.similarity_from_distance(F.col("a"), F.col("b"), F.col("_d")).alias("similarity"))


def _near_dup(s, d):
    e = D.table(s, d, "events").select(
        "event_id", "ts", (F.col("event_id") % 25).cast("int").alias("camera_id"), (F.col("event_id") % 400).alias("track_id"),
        F.concat(F.lit("ZZ99XX"), F.lpad((F.col("user_id") % 40).cast("string"), 4, "0")).alias("plate_number"),
    )
    return G.near_duplicates(e, window_seconds=43200).select("event_id", "camera_id", "plate_number", "is_duplicate")


QUERIES = {
    "plate_key": lambda s, d: D.texts(s, d).select("read_id", P.plate_key(F.col("text")).alias("result")),
    "plate_clean": lambda s, d: D.texts(s, d).select("read_id", P.plate_clean(F.col("text")).alias("result")),
    "normalize_fusion": _normalize,
    "validate_fusion": _validate("fusion"),
    "validate_video": _validate("video"),
    "validate_service": _validate("service"),
    "validate_browser": _validate("browser"),
    "pattern_mix": _pattern_mix,
    "swap_browser": _swap,
    "detection_consensus": _consensus,
    "folded_key_match": _folded,
    "state_mix": _state_mix,
    "frame_best_candidate": _best_candidate,
    "frame_quality": _quality,
    "candidate_score": _score,
    "service_best_text": _service_best,
    "assemble_tokens": _tokens,
    "confidence_gates": _gates,
    "confusion_distance": _confusion,
    "plate_similarity": _similarity,
    "unit_distance": lambda s, d: _pairs(s, d).select("a", "b", X.unit_distance(F.col("a"), F.col("b")).alias("distance")),
    "position_similarity": lambda s, d: _pairs(s, d).select("a", "b", F.round(X.position_similarity(F.col("a"), F.col("b")), 6).alias("similarity")),
    "near_dup_filter": _near_dup,
}


# --- SQL ---------------------------------------------------------------------------
def _list(items) -> str:
    return "(" + ",".join(f"'{i}'" for i in items) + ")"


def _case_fix(col: str, fixes) -> str:
    return "case " + " ".join(f"when {col} in {_list(k.split())} then '{t}'" for t, k in fixes) + f" else {col} end"


def normalize_sql(source: str, col: str, p: P.PlateProfile, out: str = "n") -> str:
    """``source`` columns plus ``out``."""
    known = _list([*p.states, *p.fix_keys()])
    lead = _list(p.lead)
    third = (
        f"when length(c) >= 11 and c[1] in {lead} then case when c[2:3] in {known} then c[2:] else c end"
        if p.lead_exclusive else f"when length(c) >= 11 and c[1] in {lead} and c[2:3] in {known} then c[2:]"
    )
    fourth = f"when length(c) >= 12 and c[3:4] in {known} then c[3:]" if p.drop_two else ""
    floor = f"length(k) > 10 and" if p.tail_min else ""
    return f"""
(select * exclude (c, k), case when {floor} regexp_matches(k, '{p.tails[0]}') then regexp_extract(k, '{p.tails[0]}', 1)
   when {floor} regexp_matches(k, '{p.tails[1]}') then regexp_extract(k, '{p.tails[1]}', 1) else k end as {out}
 from (select *, case when length(c) < 4 then '' when c like 'IND%' and length(c) >= 7 then c[4:]
     when c like 'IN%' and length(c) >= 8 and c[3:4] in {known} then c[3:] {third} {fourth} else c end as k
   from (select *, regexp_replace(upper({col}), '[^A-Z0-9]', '', 'g') as c from {source})))"""


def validate_sql(source: str, col: str, p: P.PlateProfile) -> str:
    """``source`` columns plus is_valid, conf, plate."""
    src, last = normalize_sql(source, col, p, "n1"), "n1"
    if p.passes == 2:
        src, last = normalize_sql(src, "n1", p, "n2"), "n2"
    d, l = p.digits, p.letters
    lens = {k for k, _ in p.length_rules}
    any_p = " or ".join(f"regexp_matches(plate, '{x}')" for x in p.patterns)
    known = f"plate[1:2] in {_list(p.states)}"
    rules = ""
    for k, (a, b, c, e) in p.length_rules:
        rules += f" when length(n) = {k} and regexp_matches(plate, '{P.BY_LENGTH[k]}') then (case when {known} then {a} else {b} end)"
        if c > 0:
            rules += f" when length(n) = {k} then (case when {known} then {c} else {e} end)"
    eleven = f"or (length(n) = 11 and regexp_matches(concat(strict, body), '{P.BY_LENGTH[11]}'))" if 11 in lens else ""
    empty = "case when n = '' then 'No text' else plate end" if p.name == "service" else "plate"
    return f"""
(select *, conf > {p.invalid_conf} as is_valid from (
 select * exclude (plate, n), {empty} as plate, cast(case when length(n) < 4 then 0.0 {rules}
   when {any_p} then (case when {known} then {p.pattern_conf[0]} else {p.pattern_conf[1]} end)
   when length(n) between 8 and 11 and {known} then {p.state_only_conf} else {p.invalid_conf} end as double) as conf
 from (select * exclude (strict, loose, body), case when length(n) < 4 then n when length(n) in (9,10) {eleven} then concat(strict, body) else concat(loose, body) end as plate
 from (select *, case when length(n) < 8 then translate(n[3:], '{d[0]}', '{d[1]}')
     else concat(translate(n[3:4], '{d[0]}', '{d[1]}'),
       case when length(n) = 10 and strict = 'TS' and translate(n[5:6], '{l[0]}', '{l[1]}') = 'BS' then 'JS' else translate(substr(n, 5, greatest(length(n)-8, 0)), '{l[0]}', '{l[1]}') end,
       translate(n[-4:], '{d[0]}', '{d[1]}')) end as body
 from (select * exclude (s), case when s in {_list(p.states)} then s else {_case_fix('s', p.fixes)} end as strict, {_case_fix('s', p.fixes)} as loose
 from (select * rename ({last} as n), translate({last}[1:2], '{l[0]}', '{l[1]}') as s from {src}))))))"""


def browser_sql(source: str, col: str) -> str:
    p = P.BROWSER
    d, l = p.digits, p.letters
    known, lead = _list([*p.states, *p.fix_keys()]), _list(p.lead)
    states = _list(p.states)
    mid = "substr(k, 5, greatest(length(k)-8, 0))"
    count = lambda part, chars: f"length(regexp_replace({part}, '[^{chars}]', '', 'g'))"
    x, k = f"x[1:2] in {states}", f"k[1:2] in {states}"
    return f"""
(select *, case when not usable then 'LOW_CONFIDENCE' when conf > 0.45 then 'VALID' else 'INVALID' end as status,
   usable and conf > 0.45 as is_valid,
   cast(case when not usable then null when pattern is null or pattern like '%STRICT' then 0 else cnt end as int) as corrections,
   case when not usable then c when pattern is null or pattern like '%STRICT' then k else x end as plate
 from (select *, cast(case when not usable then 0.0 when pattern = 'STANDARD_STRICT' then case when {k} then 1.0 else 0.90 end
    when pattern = 'BHARAT_SERIES_STRICT' then 0.98 when pattern = 'COMMERCIAL_STRICT' then case when {k} then 0.95 else 0.85 end
    when pattern = 'TEMPORARY_STRICT' then 0.92 when pattern = 'GOVERNMENT_STRICT' then 0.95
    when pattern = 'STANDARD_POSITION_CORRECTED' then case when {x} then 0.88 else 0.75 end when pattern = 'BHARAT_CORRECTED' then 0.85
    when pattern = 'COMMERCIAL_CORRECTED' then case when {x} then 0.82 else 0.70 end when pattern = 'TEMPORARY_CORRECTED' then 0.80
    when pattern = 'GOVERNMENT_CORRECTED' then 0.82 when pattern = 'SHORT_FORMAT_CORRECTED' then 0.80
    when pattern = 'STATE_CODE_MATCHED_ONLY' then 0.45 else 0.10 end as double) as conf
 from (select *, case when not usable then null
    when regexp_matches(k, '{P.STANDARD}') then 'STANDARD_STRICT' when regexp_matches(k, '{P.BHARAT}') then 'BHARAT_SERIES_STRICT'
    when regexp_matches(k, '{P.COMMERCIAL}') then 'COMMERCIAL_STRICT' when regexp_matches(k, '{P.TEMPORARY}') then 'TEMPORARY_STRICT'
    when regexp_matches(k, '{P.GOVERNMENT}') then 'GOVERNMENT_STRICT' when regexp_matches(x, '{P.STANDARD}') then 'STANDARD_POSITION_CORRECTED'
    when regexp_matches(x, '{P.BHARAT}') then 'BHARAT_CORRECTED' when regexp_matches(x, '{P.COMMERCIAL}') then 'COMMERCIAL_CORRECTED'
    when regexp_matches(x, '{P.TEMPORARY}') then 'TEMPORARY_CORRECTED' when regexp_matches(x, '{P.GOVERNMENT}') then 'GOVERNMENT_CORRECTED'
    when regexp_matches(x, '{P.SHORT}') and {x} then 'SHORT_FORMAT_CORRECTED'
    when length(k) between 8 and 11 and head in {states} then 'STATE_CODE_MATCHED_ONLY' end as pattern
 from (select *, case when length(k) between 8 and 11 then concat(st, translate(k[3:4], '{d[0]}', '{d[1]}'), translate({mid}, '{l[0]}', '{l[1]}'), translate(k[-4:], '{d[0]}', '{d[1]}')) else k end as x,
    case when length(k) between 8 and 11 then {count('k[1:2]', l[0])} + (case when st <> head then 1 else 0 end) + {count('k[3:4]', d[0])} + {count(mid, l[0])} + {count('k[-4:]', d[0])} else 0 end as cnt
 from (select *, case when head in {states} then head else {_case_fix('head', p.fixes)} end as st
 from (select *, translate(k[1:2], '{l[0]}', '{l[1]}') as head
 from (select *, case when regexp_matches(j, '{p.tails[0]}') then regexp_extract(j, '{p.tails[0]}', 1) when regexp_matches(j, '{p.tails[1]}') then regexp_extract(j, '{p.tails[1]}', 1) else j end as k
 from (select *, length(c) between 4 and 15 as usable, case when c like 'IND%' and length(c) >= 7 then c[4:] when c like 'IN%' and length(c) >= 8 and c[3:4] in {known} then c[3:]
     when length(c) >= 11 and c[1] in {lead} and c[2:3] in {known} then c[2:] else c end as j
 from (select *, regexp_replace(upper({col}), '[^A-Z0-9]', '', 'g') as c from {source})))))))))"""


def _validate_oracle(profile: str) -> str:
    if profile == "browser":
        return f"select read_id, text, is_valid, conf, plate, status, pattern, corrections from {browser_sql('(select * from texts)', 'text')}"
    return f"select read_id, text, is_valid, conf, plate from {validate_sql('(select * from texts)', 'text', P.PROFILES[profile])}"


_PAIRS = "(select regexp_replace(upper(raw_text), '[^A-Z0-9]', '', 'g') as a, true_plate as b, count(*) as n from frames group by 1, 2)"
_SAME = "list_sum(list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: case when substr({a}, i, 1) = substr({b}, i, 1) then 1 else 0 end))"
_POS = f"case when a = '' or b = '' then 0.0 when a = b then 1.0 else cast({_SAME.format(a='a', b='b')} as double) / greatest(length(a), length(b)) end"
_CONF_PAIRS = _list(X.CONFUSION_PAIRS + [c[::-1] for c in X.CONFUSION_PAIRS])
_DIST = f"""(select a, b, n, list_reduce(list_transform(range(1, length(a)+1), lambda i: [cast(i as double)]),
   lambda prev, r: list_reduce(list_transform(range(1, length(b)+1), lambda j: [cast(j as double)]),
     lambda cur, q: list_append(cur, least(prev[cast(q[1] as int)+1] + 1.0, cur[cast(q[1] as int)] + 1.0, prev[cast(q[1] as int)] +
        case when substr(a, cast(r[1] as int), 1) = substr(b, cast(q[1] as int), 1) then 0.0
             when concat(substr(a, cast(r[1] as int), 1), substr(b, cast(q[1] as int), 1)) in {_CONF_PAIRS} then 0.15 else 1.0 end)), r),
   list_transform(range(0, length(b)+1), lambda z: cast(z as double)))[-1] as dist from {_PAIRS})"""

ORACLE = {
    "plate_key": "select read_id, replace(replace(upper(text),' ',''),'-','') as result from texts",
    "plate_clean": "select read_id, regexp_replace(upper(text),'[^A-Z0-9]','','g') as result from texts",
    "normalize_fusion": f"select read_id, text, n as plate from {normalize_sql('(select * from texts)', 'text', P.FUSION)}",
    "validate_fusion": _validate_oracle("fusion"),
    "validate_video": _validate_oracle("video"),
    "validate_service": _validate_oracle("service"),
    "validate_browser": _validate_oracle("browser"),
    "pattern_mix": f"""select coalesce(pattern, 'NONE') as pattern, count(*) as n, cast(sum(coalesce(corrections, 0)) as bigint) as corrections
from {browser_sql('(select * from texts)', 'text')} group by 1""",
    "swap_browser": """
select read_id, translate(c,'OQILZSBG01568','00112586OISGB') as once, translate(translate(c,'OQILZSBG01568','00112586OISGB'),'OQILZSBG01568','00112586OISGB') as twice
from (select read_id, regexp_replace(upper(text),'[^A-Z0-9]','','g') as c from texts)""",
    "detection_consensus": """
select track_id, raw_plate, final_plate, confidence, final_plate <> raw_plate as is_corrected, n_frames,
  case when coalesce(v.is_authorized, true) and confidence >= 0.75 then 'allow' when not coalesce(v.is_authorized, true) then 'deny' else 'manual_review' end as decision
from (select *, replace(replace(replace(raw_plate,'O','0'),'Q','0'),'I','1') as final_plate from
  (select track_id, max(case when frame_number = 1 then regexp_replace(upper(raw_text),'[^A-Z0-9]','','g') end) as raw_plate,
     round(avg(round(0.75 + (frame_number-1)*0.04, 2)), 2) as confidence, count(*) as n_frames from frames group by track_id)) x
left join veh v on v.plate_number = x.final_plate""",
    "folded_key_match": """
select read_id, text, coalesce(plate_number, translate(c,'OQI','001')) as final_plate, plate_number is not null as is_known
from (select read_id, text, regexp_replace(upper(text),'[^A-Z0-9]','','g') as c from texts) t
left join (select translate(plate_number,'OIBQS','01805') as k, arg_min(plate_number, vehicle_id) as plate_number from veh group by 1) v on v.k = translate(t.c,'OIBQS','01805')""",
    "state_mix": """
select case when length(k) >= 2 then k[1:2] else 'IN' end as state, count(*) as n from (select replace(replace(upper(text),' ',''),'-','') as k from texts) group by 1""",
    "frame_best_candidate": f"""
select track_id, raw_text as best_text, ocr_confidence as best_confidence, st as is_strict from (
  select *, row_number() over (partition by track_id order by st desc, ocr_confidence desc, frame_number) as rn
  from (select *, regexp_matches(raw_text, '{P.CLIP_STRICT}') as st from frames where regexp_matches(raw_text, '{P.CLIP_LOOSE}'))) where rn = 1""",
    "frame_quality": f"""
select read_id, round((case when read_id%3<>0 then 0.35 else 0.05 end) + (case when read_id%4<>0 then 0.30 else 0.0 end)
  + (case when regexp_matches(text, '{P.CLIP_LOOSE}') then least(confidence, 1.0)*0.35 else 0.0 end), 6) as quality from texts""",
    "candidate_score": f"""
select crop_id, plate as best_plate, round(case when is_valid then greatest(conf, 0.70) else confidence end, 4) as best_confidence, round(pts, 4) as best_score
from (select *, row_number() over (partition by crop_id order by pts desc, read_id) as rn from (
  select *, (case when plate[1:2] in {_list(P.VIDEO.states)} then 35.0 when plate[1:2] in {_list(P.VIDEO.fix_keys())} then 15.0 else 0.0 end)
   + (case when is_valid then 45.0 when length(plate) in (9,10) then 20.0 else 0.0 end)
   + (case when length(plate) in (9,10) then 15.0 else greatest(0.0, 10.0 - abs(length(plate)-10)*2.0) end) + confidence*15.0 as pts
  from {validate_sql("(select read_id, crop_id, confidence, plate as p1 from " + validate_sql("(select *, cast(floor(read_id/8) as bigint) as crop_id from texts)", "text", P.VIDEO) + " where length(plate) >= 4)", "p1", P.VIDEO)}))
where rn = 1""",
    "service_best_text": f"""
select crop_id, n as best_text, mc as best_confidence from (
  select *, row_number() over (partition by crop_id order by length(n) desc, cnt desc, o) as rn, max(c) over (partition by crop_id) as mc
  from (select crop_id, n, count(*) as cnt, min(read_id) as o, max(confidence) as c
        from {normalize_sql("(select *, cast(floor(read_id/8) as bigint) as crop_id from texts)", "text", P.SERVICE)} where n <> '' group by 1, 2)) where rn = 1""",
    "assemble_tokens": """
select track_id, string_agg(raw_text[1:3], '' order by floor(y1/20), x1, frame_number) as joined_text, round(avg(ocr_confidence), 4) as mean_score
from frames group by track_id""",
    "confidence_gates": """
select read_id, round(case when c < 0.40 then 0.0 else least(1.0, greatest(0.0, c)) end, 6) as gated, c >= 0.25 and length(regexp_replace(upper(text),'[^A-Z0-9]','','g')) >= 4 as in_pool
from (select *, confidence*2 - 0.75 as c from texts)""",
    "confusion_distance": f"select a, b, n, round(dist, 6) as distance from {_DIST}",
    "plate_similarity": f"""
select a, b, case when a = '' or b = '' then 0.0 when a = b then 1.0 else round(greatest(0.0, 1.0 - dist / greatest(length(a), length(b))), 3) end as similarity from {_DIST}""",
    "unit_distance": f"select a, b, cast(levenshtein(a, b) as int) as distance from {_PAIRS}",
    "position_similarity": f"select a, b, round({_POS}, 6) as similarity from {_PAIRS}",
    "near_dup_filter": f"""
with src as (select event_id, epoch_us(ts) as t, cast(event_id%25 as int) as camera_id, event_id%400 as track_id, concat('ZZ99XX', lpad(cast(user_id%40 as varchar), 4, '0')) as p from events),
e as (select *, row_number() over (partition by camera_id order by t, event_id) as rn from src),
w as (
  select camera_id, rn, event_id, p, [{{'t': t, 'k': track_id, 'p': p}}] as recent, false as dup from e where rn = 1
  union all
  select camera_id, rn, event_id, p, case when dup then live else list_append(live, {{'t': t, 'k': track_id, 'p': p}}) end, dup
  from (select camera_id, rn, event_id, p, t, track_id, live,
          len(list_filter(live, lambda r: r.k <> track_id and (r.p = p or
            list_sum(list_transform(range(1, 11), lambda i: case when substr(r.p, i, 1) = substr(p, i, 1) then 1 else 0 end)) / 10.0 >= 0.85))) > 0 as dup
        from (select e.camera_id, e.rn, e.event_id, e.p, e.t, e.track_id, list_filter(w.recent, lambda r: e.t - r.t <= 43200000000) as live
              from w join e on e.camera_id = w.camera_id and e.rn = w.rn + 1)))
select event_id, camera_id, p as plate_number, dup as is_duplicate from w""",
}
ORACLE = {k: with_views(v, recursive=(k == "near_dup_filter")) for k, v in ORACLE.items()}

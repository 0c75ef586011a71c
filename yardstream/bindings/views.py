"""SQL text of the derived gate tables, for the checks that run outside Spark."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "veh": """
select c_custkey as vehicle_id,
       concat(substr('ANAPARASBRCGCHDDDLDNGAGJHPHRJHJKKAKLLALDMHMLMNMPMZ', cast(c_nationkey*2+1 as int), 2),
              lpad(cast(c_custkey%97+1 as string), 2, '0'),
              chr(cast(65+c_custkey%26 as int)), chr(cast(65+cast(floor(c_custkey/26) as bigint)%26 as int)),
              lpad(cast((c_custkey*7919)%10000 as string), 4, '0')) as plate_number,
       case c_custkey%4 when 0 then 'Truck' when 1 then 'Car' when 2 then 'Bus' else 'Two wheeler' end as vehicle_type,
       c_name as owner_name, c_mktsegment as transporter,
       c_custkey%17 <> 0 as is_authorized, c_custkey%3 = 0 as whitelisted, c_custkey%29 = 0 as watchlisted
from customer""",
    "cams": """
select n_nationkey as camera_id, concat('C', lpad(cast(n_nationkey as string),2,'0'), case when n_nationkey%3=0 then '-EXIT' else '-ENTRY' end) as camera_code,
       n_name as camera_name, r_regionkey as gate_id, concat('Gate 0', cast(r_regionkey+1 as string)) as gate_name, concat('G0', cast(r_regionkey+1 as string)) as gate_code,
       case when n_nationkey%3=0 then 'exit' when n_nationkey%7=0 then 'both' else 'entry' end as direction,
       case when n_nationkey%11=0 then 'offline' else 'online' end as status
from nation join region on n_regionkey = r_regionkey""",
    "gate": """
select r_regionkey as gate_id, concat('Gate 0', cast(r_regionkey+1 as string)) as gate_name, concat('G0', cast(r_regionkey+1 as string)) as gate_code
from region""",
    "reads": """
select e.event_id as read_id, e.ts, cast(e.event_id%25 as int) as camera_id, e.user_id as vehicle_id_true,
       case when e.event_id%97=0 then '' when e.event_id%10=0 then concat('ZZ99XX', lpad(cast(e.user_id as string),4,'0'))
            when e.event_id%4=1 then lower(concat(substr(v.plate_number,1,4),' ',substr(v.plate_number,5,2),'-',substr(v.plate_number,7,4))) else v.plate_number end as raw_plate,
       cast(55 + (e.event_id*37)%45 as double)/100 as confidence, e.event_id%23=0 as is_corrected, e.event_type as tag, e.value
from events e join veh v on v.vehicle_id = e.user_id""",
    "payload": """
select r.read_id, r.ts, r.raw_plate as plate_number, case when read_id%5<>0 then 'finalized' end as status, read_id%400 as track_id,
       case when read_id%13=0 then null when read_id%6=0 then confidence*100 else confidence end as final_confidence,
       case read_id%3 when 1 then 'TRUCK' when 2 then 'bus' end as vehicle_type,
       case when read_id%19<>0 then c.camera_code end as camera_id,
       case when read_id%17=0 then null when read_id%7=0 then c.gate_code else c.gate_name end as gate_id,
       is_corrected, cast(read_id%4 as int) as frame_count, cast(read_id%3 as int) as n_frames, confidence
from reads r join cams c on c.camera_id = r.camera_id""",
    "parsed": """
select read_id, ts, plate_number as raw_plate, regexp_replace(upper(plate_number), '[^A-Z0-9]', '', 'g') as plate,
       coalesce(status, 'finalized') as status, track_id,
       case when coalesce(final_confidence, 0.90) > 1.0 then final_confidence / 100.0 else coalesce(final_confidence, 0.90) end as confidence,
       case vehicle_type when 'TRUCK' then 'Truck' when 'bus' then 'Bus' else 'Car' end as vehicle_type,
       coalesce(camera_id, 'G01-ENTRY') as camera_code, coalesce(gate_id, 'Gate 01') as gate_ref, is_corrected,
       cast(1 as int) as frame_number, frame_count as given_frame_count,
       case when read_id%8=0 then 0.0 else cast(read_id%640 as double) end as bbox_x1,
       case when read_id%8=0 then 0.0 else cast(read_id%360 as double) end as bbox_y1,
       case when read_id%8=0 then 0.0 else cast(read_id%640+80 as double) end as bbox_x2,
       case when read_id%8=0 then 0.0 else cast(read_id%360+60 as double) end as bbox_y2,
       n_frames, confidence as read_confidence
from payload""",
    "ev": """
select r.read_id as event_id, r.ts, case when r.plate = '' then 'UNKNOWN' else r.plate end as plate_number,
       case when c.direction = 'exit' or c.camera_code like '%EXIT%' then 'exit' else 'entry' end as event_type,
       case when r.confidence < 0.75 then 'manual_review' when v.watchlisted or not v.is_authorized then 'deny'
            when v.vehicle_id is not null then 'allow' else 'manual_review' end as decision,
       case when r.confidence < 0.75 then concat('Low OCR recognition confidence (', cast(cast(floor(r.confidence*100) as int) as varchar), '% < 75%)')
            when v.watchlisted then 'Security watchlist' when not v.is_authorized then 'Vehicle marked as Flagged/Unauthorized'
            when v.whitelisted then 'Vehicle matched valid Whitelist registration'
            when v.vehicle_id is not null then 'Registered authorized vehicle' else 'Unregistered vehicle not found in database' end as reason,
       case when r.confidence < 0.75 then 'low_confidence_threshold' when v.watchlisted or not v.is_authorized then 'watchlist_blacklist_enforcement'
            when v.whitelisted then 'whitelist_preapproved' when v.vehicle_id is not null then 'master_vehicle_registry'
            else 'unknown_vehicle_review' end as rule_matched,
       r.confidence, coalesce(v.vehicle_type, 'Car') as vehicle_type, coalesce(v.transporter, 'Unregistered') as transporter,
       c.gate_id, c.gate_name, c.camera_code as camera_name, r.is_corrected, v.vehicle_id, v.is_authorized,
       coalesce(v.watchlisted, false) as watchlist_match, coalesce(v.whitelisted, false) as whitelist_match
from (select *, regexp_replace(upper(raw_plate), '[^A-Z0-9]', '', 'g') as plate from reads) r
join cams c on c.camera_id = r.camera_id left join veh v on v.plate_number = r.plate""",
    "preds": """
select r.read_id as prediction_id, r.raw_plate as raw_text, p as clean_text, case when p = '' then 'UNKNOWN' else p end as fused_text,
       confidence, case when confidence < 0.75 then 'manual_review' else 'finalized' end as status, c.gate_name, r.ts as created_at
from (select *, regexp_replace(upper(raw_plate), '[^A-Z0-9]', '', 'g') as p from reads) r join cams c on c.camera_id = r.camera_id""",
    "trips": """
select o.o_orderkey as trip_id, concat('TRIP-', cast(o.o_orderkey as string)) as trip_number, o.o_custkey as vehicle_id, v.plate_number, v.transporter,
       concat('Gate 0', cast(o.o_orderkey%5+1 as string)) as gate_name, o.o_orderpriority as purpose,
       o.o_orderdate as expected_arrival, o.o_orderdate + (o.o_orderkey%6+1) * interval '1' hour as expected_departure,
       case when o.o_orderstatus <> 'P' then o.o_orderdate + (o.o_orderkey%90) * interval '1' minute end as actual_entry_time,
       case when o.o_orderstatus = 'F' then o.o_orderdate + (o.o_orderkey%90 + (o.o_orderkey*13)%240+1) * interval '1' minute end as actual_exit_time,
       case when o.o_orderstatus = 'F' then cast((o.o_orderkey*13)%240+1 as int) end as dwell_minutes,
       case o.o_orderstatus when 'F' then 'completed' when 'P' then 'scheduled' else case o.o_orderkey%4 when 0 then 'arrived' when 1 then 'entry_approved' when 2 then 'inside_plant' else 'at_destination' end end as status
from orders o join veh v on v.vehicle_id = o.o_custkey""",
    "frames": """
select l.l_orderkey as track_id, cast(row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) as int) as frame_number,
       v.plate_number as true_plate, case when l.l_returnflag='N' then 'Night' else 'Day' end as condition,
       case when l.l_partkey%11=0 then w.plate_number when l.l_partkey%4=0 then concat(substr(v.plate_number,1,6), translate(substr(v.plate_number,7,4),'0158','OISB'))
            when l.l_partkey%9=0 then concat('IND', v.plate_number) else v.plate_number end as raw_text,
       round(0.5 + l.l_discount*4, 2) as ocr_confidence, round(0.6 + l.l_tax*4, 2) as plate_confidence,
       case cast(l.l_quantity as int)%4 when 0 then 'truck' when 1 then 'car' when 2 then 'bus' else 'motorcycle' end as vehicle_class,
       cast(l.l_partkey%1000 as double) as x1, cast(l.l_suppkey%500 as double) as y1, cast(l.l_partkey%1000 as double)+50+l.l_quantity*4 as x2, cast(l.l_suppkey%500 as double)+40+l.l_quantity*3 as y2
from lineitem l join orders o on o.o_orderkey=l.l_orderkey join veh v on v.vehicle_id=o.o_custkey join veh w on w.vehicle_id=l.l_suppkey""",
    "boxes": """
select cast(floor(l_orderkey/10) as bigint) as frame_id,
       cast(row_number() over (partition by cast(floor(l_orderkey/10) as bigint) order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as box_id,
       cast((l_partkey*31)%640 as double) as x1, cast((l_suppkey*17+l_partkey)%360 as double) as y1,
       cast((l_partkey*31)%640 as double)+60+l_quantity*2 as x2, cast((l_suppkey*17+l_partkey)%360 as double)+50+l_quantity as y2,
       round(0.3 + l_discount*5, 2) as confidence
from lineitem""",
    "crops": """
select l_orderkey*100+l_linenumber as crop_id, cast(10+l_quantity*4 as int) as w, cast(4+(l_partkey%40) as int) as h,
       cast(l_partkey%260 as double) as brightness, l_discount*200 as contrast, l_quantity/2 as sharpness
from lineitem""",
    "drivers": """
select s_suppkey as driver_id, s_name as name, concat('LIC-', lpad(cast(s_suppkey as string),6,'0')) as license_number, s_suppkey as assigned_vehicle_id, s_suppkey%13<>0 as is_active from supplier""",
    "health": """
select event_id as sample_id, cast(event_id%25 as int) as camera_id, event_type <> 'error' as is_online, ts as last_check_at, value as response_time_ms from events""",
    "alerts": """
select event_id as alert_id, case event_id%3 when 0 then 'Watchlist Alert' when 1 then 'Unknown Vehicle' else 'Low Confidence Read' end as alert_type,
       case event_id%3 when 2 then 'medium' else 'high' end as severity, event_id%25%5+1 as gate_id, ts as created_at, event_id%4=0 as is_read from events where event_type='error'""",
    "texts": """
select event_id as read_id, ts, case event_id%16 when 0 then lower(concat(substr(p,1,4),' ',substr(p,5,6))) when 1 then concat('IND', p)
       when 2 then concat('IN', p) when 3 then concat('1', p) when 4 then concat('E', p) when 5 then concat('XX', p)
       when 6 then concat(p, '1') when 7 then concat(p, 'I') when 8 then concat(substr(p,1,5), substr(p,7,4))
       when 9 then concat(substr(p,1,4), substr(p,7,4)) when 10 then concat('0L', substr(p,3,8))
       when 11 then concat(substr(p,7,2), 'BH', substr(p,7,4), substr(p,5,1))
       when 12 then concat(substr(p,1,4), 'ABC', substr(p,7,4)) when 13 then translate(p, '0158', 'OISB')
       when 14 then concat(substr(p,1,4), '-T', substr(p,5,6)) else substr(p, 1, cast(event_id%9 as int)) end as text,
       cast(55 + (event_id*37)%45 as double)/100 as confidence, user_id
from (select e.event_id, e.ts, e.user_id, v.plate_number as p from events e join veh v on v.vehicle_id = e.user_id)""",
    "history": """
select trip_id, 1 as seq, 'scheduled' as to_status, expected_arrival as ts from trips
union all select trip_id, 2, 'inside_plant', actual_entry_time from trips where actual_entry_time is not null
union all select trip_id, 3, 'completed', actual_exit_time from trips where actual_exit_time is not null""",
}


def _uses(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b(from|join)\s+{v}\b", text, re.IGNORECASE)]


def with_views(sql: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with the views it reads, directly or through other views.

    ``sql`` may itself start with ``with``.
    """
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _uses(text):
            if name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    body = sql.strip()
    texts = [body, *(VIEWS[name] for name in order)]
    # A view that is read more than once is computed once.
    often = {name for name in order if sum(len(re.findall(rf"\b{name}\b", t)) for t in texts) > 1}
    head = ", ".join(f"{name} as {'materialized ' if name in often else ''}({VIEWS[name].strip()})" for name in order)
    own = re.match(r"with\s+", body, re.IGNORECASE)
    word = "with recursive" if recursive else "with"
    if own and head:
        return f"{word} {head}, {body[own.end():]}"
    if own:
        return f"{word} {body[own.end():]}"
    return f"{word} {head} {body}" if head else body

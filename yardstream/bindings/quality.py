"""Quality, latency and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardstream.bindings.fusion import _PLAIN, _fused, _fusion_sql
from yardstream.bindings.views import with_views
from yardstream.operators import quality as Q
from yardstream.sources import derived as D
from yardstream.sources.tables import scratch_dir


def _quality(s, d):
    truth = D.frames(s, d).groupBy("track_id").agg(F.first("true_plate").alias("truth"), F.min("condition").alias("condition"))
    fused = _fused(s, d).select("track_id", F.col("display_plate").alias("plate"), F.col("final_confidence").alias("confidence"))
    return Q.recognition_quality(fused.join(truth, "track_id"))


def _latency(s, d):
    h = D.health(s, d).withColumn("stage", F.element_at(F.lit(["vehicle", "plate", "ocr", "fusion", "store"]), (F.col("camera_id") % 5 + 1).cast("int")))
    return Q.latency_profile(h, ["stage"], "response_time_ms")


def _stages(s, d):
    e = D.table(s, d, "events")
    return Q.stage_breakdown(e.select(
        (F.col("event_id") % 50).alias("video_id"), F.col("value").alias("vehicle_ms"), (F.col("value") * 0.5).alias("plate_ms"),
        F.when(F.col("event_id") % 3 == 0, F.col("value") * 2).alias("ocr_ms"), F.lit(4).alias("frame_step")), ["video_id"])


def _log(s, d):
    """A log of JSON lines written from the JSON column of the events, some of them once more cut short, read back from its files."""
    e = D.table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    line = F.to_json(F.struct(
        F.when(k % 6 != 0, F.concat(F.lit("v"), (k % 5).cast("string"))).alias("variant"), (k % 4 != 0).alias("success"), (k / 100).alias("confidence"),
        F.col("value").alias("time_ms"), F.lit("").alias("error")))
    cut = F.when(F.col("event_id") % 17 == 0, line.substr(F.lit(1), F.length(line) - 3))
    path = scratch_dir(s, "log")
    e.select(F.explode(F.array_compact(F.array(line, cut))).alias("value")).write.text(path)
    return Q.read_ocr_log(s, path)


QUERIES = {"ocr_log_summary": lambda s, d: Q.ocr_log_summary(_log(s, d)), "ocr_log_state": lambda s, d: Q.ocr_log_state(_log(s, d)), "recognition_quality": _quality, "latency_profile": _latency, "stage_breakdown": _stages}

ORACLE = {
    "ocr_log_summary": """
select case when k%6<>0 then concat('v', cast(k%5 as varchar)) else 'main' end as variant, count(*) as reads, round(avg(case when k%4<>0 then 1 else 0 end),4) as success_rate,
 round(avg(value),4) as mean_ms, round(avg(k/100.0::double),4) as mean_confidence from (select *, cast(json_extract(props, '$.k') as int) as k from events) group by 1""",
    "ocr_log_state": "select count(*) + count(*) filter (event_id % 17 = 0) as lines, count(*) filter (event_id % 17 = 0) as broken_lines from events",
    "recognition_quality": _fusion_sql(*_PLAIN, """, q as (
 select t.truth, t.condition, d.confidence, case when status='finalized' then plate else 'Requires Manual Review' end as p from decided d
 join (select track_id, min(true_plate) as truth, min(condition) as condition from frames group by 1) t on t.track_id = d.track_id)
select count(*) as samples, round(sum(list_sum(list_transform(range(1, least(length(truth), length(p))+1), lambda i: case when substr(truth,i,1)=substr(p,i,1) then 1 else 0 end)))::double / sum(greatest(length(truth), length(p))) * 100, 4) as char_accuracy,
 round(avg(case when truth=p then 1 else 0 end)*100, 4) as exact_accuracy, round(avg(case when condition='Day' then case when truth=p then 1 else 0 end end)*100, 4) as day_accuracy,
 round(avg(case when condition='Night' then case when truth=p then 1 else 0 end end)*100, 4) as night_accuracy, round(avg(case when confidence<0.75 or truth<>p then 1 else 0 end)*100, 4) as manual_rate from q"""),
    "latency_profile": """
select ['vehicle','plate','ocr','fusion','store'][camera_id%5+1] as stage, count(*) as iterations, round(avg(response_time_ms),4) as mean_ms, round(quantile_cont(response_time_ms,0.5),4) as median_ms,
 round(min(response_time_ms),2) as min_ms, round(max(response_time_ms),2) as max_ms, round(quantile_cont(response_time_ms,0.95),4) as p95_ms, round(quantile_cont(response_time_ms,0.99),4) as p99_ms,
 round(1000.0/avg(response_time_ms),2) as fps from health group by 1""",
    "stage_breakdown": """
select event_id%50 as video_id, count(*) as frames_processed, 3*count(*) as frames_skipped, count(*) filter (event_id%3=0) as ocr_calls, round(avg(value),6) as avg_vehicle_ms, round(avg(value*0.5),6) as avg_plate_ms,
 coalesce(round(avg(case when event_id%3=0 then value*2 end),6),0.0) as avg_ocr_ms, round(sum(value*1.5 + case when event_id%3=0 then value*2 else 0.0 end)/count(*),6) as avg_frame_ms,
 round(count(*)/greatest(0.001, sum(value*1.5 + case when event_id%3=0 then value*2 else 0.0 end)/1000),6) as fps from events group by 1""",
}
ORACLE = {k: with_views(v, recursive="walk as (" in v) for k, v in ORACLE.items()}

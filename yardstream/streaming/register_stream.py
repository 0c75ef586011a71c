"""Stream of read messages to the register tables, those of the batch register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstream.operators import register as R
from yardstream.plans import register_plan as P
from yardstream.sources.tables import append_register, read_register, scratch_dir
from yardstream.streaming.running import run_batches
from yardstream.streaming.trip_stream import moved_history, moved_trips, trip_moves

#: Columns of the parsed message that the decision adds to or renames.
_PASSED = (
    "read_id", "ts", "message", "raw_plate", "plate", "fused_plate", "event_type", "confidence", "vehicle_type", "track_id", "frame_number",
    "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "camera_code", "camera_id", "gate_ref", "gate_id", "is_corrected", "is_fused", "frame_count", "prediction_status",
)


def decided_reads(
    messages: DataFrame, cameras: DataFrame, gates: DataFrame, vehicles: DataFrame, whitelist: DataFrame, watchlist: DataFrame, policy: str = "confidence_first",
) -> DataFrame:
    """Parsed messages (read_id, ts, payload) with gate, camera, registry, lists and decision; ``message`` is the payload as sent."""
    base = R.prediction_columns(R.parse_payloads(messages.withColumn("message", F.col("payload"))))
    base = R.resolve_camera(R.resolve_gate(base, gates), cameras).select(*_PASSED)
    return P.decided(base, vehicles, whitelist, watchlist, policy)


def run_register(
    messages: DataFrame, cameras: DataFrame, gates: DataFrame, vehicles: DataFrame, whitelist: DataFrame, watchlist: DataFrame,
    dedup_seconds: int = 15, policy: str = "confidence_first", trips: DataFrame | None = None,
) -> str:
    """Write every message's rows to the register tables, micro-batch by micro-batch, and return their folder.

    Duplicates keep their detection, prediction and frame rows but add no
    event, as in the batch.  ``trips`` are the trips at the start.  The rows of
    a micro-batch appear together (``append_register``); one that is repeated
    changes nothing.  ``live_register`` reads the result.
    """
    spark = messages.sparkSession
    root = scratch_dir(spark, "live-register")
    reads = decided_reads(messages, cameras, gates, vehicles, whitelist, watchlist, policy)
    moves = trip_moves(reads, P.no_trips(spark) if trips is None else trips, dedup_seconds)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # ten outputs of one batch
        base = batch.withColumnsRenamed({"event_id": "read_id", "plate_number": "fused_plate", "gate_name": "gate_ref"})
        passages = batch.filter("accepted_id = event_id")
        alerts = R.alert_rows(passages)
        append_register({
            "detections": P.detection_rows(base),
            "predictions": P.prediction_rows(base),
            "prediction_frames": R.explode_frames(R.parse_payloads(base.select("read_id", F.col("message").alias("payload")))),
            "events": P.event_rows(passages),
            "decisions": P.decision_rows(passages),
            "alerts": alerts,
            "deliveries": R.alert_deliveries(alerts),
            "trip_moves": passages.filter("trip_ref is not null").select(
                "event_id", "ts", "plate_number", "trip_ref", "is_auto", "given_status", "from_status", "to_status", "entry_us", "exit_us", "created_us", "dwell_minutes"),
            "vehicle_status": R.latest_vehicle_status(passages),
        }, root, batch_id)
        batch.unpersist()

    run_batches(moves, "register", write)
    return root


def live_register(spark: SparkSession, root: str) -> P.RegisterTables:
    """The ten register tables under ``root`` as they stand, equal to those of ``register_batch`` over the same messages.

    Trips and vehicles have a row per micro-batch that changed them; the newest counts.
    """
    table = {n: read_register(spark, root, n) for n in ("detections", "predictions", "prediction_frames", "events", "decisions", "alerts", "deliveries", "trip_moves")}
    moves = table.pop("trip_moves")
    changed = read_register(spark, root, "vehicle_status", batches=True)
    newest = F.max_by("status", F.struct("last_event_at", F.col("batch").cast("long")))
    status = changed.groupBy("vehicle_id").agg(newest.alias("status"), F.max("last_event_at").alias("last_event_at"))
    return P.RegisterTables(**table, trips=moved_trips(moves), trip_history=moved_history(moves), vehicle_status=status)

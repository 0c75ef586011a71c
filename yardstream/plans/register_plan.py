"""The batch register: reads in, the rows of the register tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstream.functions.plate_rules import plate_clean
from yardstream.operators import register as R
from yardstream.operators import trips as T
from yardstream.operators.dedup import dedup_passages
from yardstream.sources.tables import staged


def decided_events(
    reads: DataFrame,
    cameras: DataFrame,
    vehicles: DataFrame,
    whitelist: DataFrame,
    watchlist: DataFrame,
    policy: str = "confidence_first",
) -> DataFrame:
    """Reads with camera, gate, registry and list matches, and the decision.

    No de-duplication; one output row per read.
    """
    cam = cameras.select("camera_id", "camera_code", "gate_id", "gate_name", "direction")
    df = reads.join(cam, "camera_id")
    df = df.withColumn("plate", plate_clean(F.col("raw_plate")))
    df = df.withColumn("event_type", R.event_direction(F.col("direction"), F.col("camera_code")))
    df = R.join_registry(df, vehicles)
    df = R.join_list(df, whitelist, "whitelist")
    df = R.join_list(df, watchlist, "watchlist")
    df = R.gate_decisions(df, policy)
    return df.select(
        F.col("read_id").alias("event_id"),
        "ts",
        F.when(F.col("plate") == "", F.lit("UNKNOWN")).otherwise(F.col("plate")).alias("plate_number"),
        "event_type",
        "decision",
        "reason",
        "rule_matched",
        "confidence",
        F.coalesce("registered_type", F.lit("Car")).alias("vehicle_type"),
        "transporter",
        "gate_id",
        "gate_name",
        F.col("camera_code").alias("camera_name"),
        "is_corrected",
        "vehicle_id",
        "is_authorized",
        "watchlist_match",
        "whitelist_match",
    )


@dataclass(frozen=True)
class RegisterTables:
    """The rows one batch adds to the register."""

    detections: DataFrame
    predictions: DataFrame
    prediction_frames: DataFrame
    events: DataFrame
    decisions: DataFrame
    alerts: DataFrame
    deliveries: DataFrame
    trips: DataFrame
    trip_history: DataFrame
    vehicle_status: DataFrame

    def items(self):
        return vars(self).items()


def detection_rows(base: DataFrame) -> DataFrame:
    return base.select(
        "read_id", "camera_id", "gate_id", F.col("track_id").alias("tracking_id"), "frame_number",
        "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "vehicle_type", "confidence", F.col("ts").alias("detection_timestamp"),
    )


def prediction_rows(base: DataFrame) -> DataFrame:
    return base.select(
        "read_id", "track_id", F.col("raw_plate").alias("raw_plate_text"), F.col("plate").alias("clean_plate_text"),
        F.col("fused_plate").alias("fused_plate_text"), "confidence", "is_fused", "frame_count",
        F.col("prediction_status").alias("status"), "camera_code", F.col("gate_ref").alias("gate_name"),
        F.col("ts").alias("created_at"),
    )


def decided(reads: DataFrame, vehicles: DataFrame, whitelist: DataFrame, watchlist: DataFrame, policy: str) -> DataFrame:
    """Parsed reads with registry and list matches and the decision, under the names of the register."""
    df = R.join_registry(reads, vehicles)
    df = R.join_list(df, whitelist, "whitelist")
    df = R.join_list(df, watchlist, "watchlist")
    return R.gate_decisions(df, policy).withColumnsRenamed(
        {"read_id": "event_id", "fused_plate": "plate_number", "gate_ref": "gate_name"}
    )


def event_rows(passages: DataFrame) -> DataFrame:
    return passages.select(
        "event_id", "vehicle_id", "gate_id", "camera_id", "event_type", "plate_number", "vehicle_type", "transporter",
        "gate_name", F.col("camera_code").alias("camera_name"), "confidence", "decision", "is_corrected", "dwell_minutes", "ts",
    )


def decision_rows(passages: DataFrame) -> DataFrame:
    return passages.select("event_id", "gate_id", "decision", "reason", "rule_matched", "ts")


def no_trips(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "trip_id long, plate_number string, status string, actual_entry_time timestamp_ntz")


def register_batch(
    messages: DataFrame,
    cameras: DataFrame,
    gates: DataFrame,
    vehicles: DataFrame,
    whitelist: DataFrame,
    watchlist: DataFrame,
    dedup_seconds: int = 15,
    policy: str = "confidence_first",
    trips: DataFrame | None = None,
) -> RegisterTables:
    """JSON read messages (read_id, ts, payload) to register rows.

    Duplicates keep their detection, prediction and frame rows but add no event.
    Passages move the open ``trips`` (trip_id, plate_number, status,
    actual_entry_time; none given: none open) and make automatic ones; exits get
    their dwell minutes, vehicles their latest status.  The
    parsed reads and the decided passages feed several outputs each, so both are
    written once to the shared folder and read back.
    """
    base = R.prediction_columns(R.parse_payloads(messages))
    base = staged(R.resolve_camera(R.resolve_gate(base, gates), cameras), "reads")
    passages = dedup_passages(
        base.drop("supporting_predictions", "frame_predictions"),
        dedup_seconds, keys=("fused_plate", "event_type"), event_id="read_id",
    ).filter(F.col("accepted_id") == F.col("read_id"))
    df = staged(decided(passages, vehicles, whitelist, watchlist, policy), "passages")
    if trips is None:
        trips = no_trips(messages.sparkSession)
    dwell = T.exit_dwells(df, trips).select(F.col("event_id").alias("_exit"), "dwell_minutes")
    events = event_rows(df.join(dwell, F.col("event_id") == F.col("_exit"), "left"))
    alerts = R.alert_rows(df)
    return RegisterTables(
        detection_rows(base), prediction_rows(base), R.explode_frames(base), events, decision_rows(df), alerts, R.alert_deliveries(alerts),
        T.progress_trips(df, trips), T.trip_history(df, trips), R.latest_vehicle_status(df),
    )

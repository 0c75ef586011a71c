"""From finalised reads to register rows: defaults, lookups, decisions, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstream.functions.plate_rules import plate_clean, plate_key

PAYLOAD_SCHEMA = """
    plate_number string, status string, track_id long, final_confidence double, vehicle_type string,
    camera_id string, gate_id string, is_corrected boolean, frame_number int, frame_count int,
    vehicle_bbox array<double>,
    supporting_predictions array<struct<plate:string,confidence:double,frame:int,is_valid:boolean>>,
    frame_predictions array<struct<frame_number:int,plate:string,text:string,confidence:double,engine:string>>
"""
REVIEW_THRESHOLD = 0.75
OPEN_EXCLUDES = ("completed", "cancelled")


def rescale_confidence(confidence: Column) -> Column:
    """Percentages become fractions."""
    return F.when(confidence > 1.0, confidence / 100.0).otherwise(confidence)


def parse_payloads(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Parse JSON messages and fill every absent field with its default."""
    p = F.from_json(F.col(payload), PAYLOAD_SCHEMA)
    df = messages.withColumn("_p", p).drop(payload)
    box = [F.coalesce(F.get("_p.vehicle_bbox", F.lit(i)), F.lit(0.0)).alias(f"bbox_{n}")
           for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    word = F.coalesce(F.nullif(F.col("_p.vehicle_type"), F.lit("")), F.lit("Car"))
    return df.select(
        *[c for c in df.columns if c != "_p"],
        F.coalesce("_p.plate_number", F.lit("")).alias("raw_plate"),
        plate_clean(F.col("_p.plate_number")).alias("plate"),
        F.coalesce("_p.status", F.lit("finalized")).alias("status"),
        F.coalesce("_p.track_id", F.lit(0).cast("long")).alias("track_id"),
        rescale_confidence(F.coalesce("_p.final_confidence", F.lit(0.90))).alias("confidence"),
        F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.expr("substr(coalesce(nullif(_p.vehicle_type,''),'Car'), 2)")))
        .alias("vehicle_type"),
        F.coalesce("_p.camera_id", F.lit("G01-ENTRY")).alias("camera_code"),
        F.coalesce("_p.gate_id", F.lit("Gate 01")).alias("gate_ref"),
        F.coalesce("_p.is_corrected", F.lit(False)).alias("is_corrected"),
        F.coalesce("_p.frame_number", F.lit(1)).alias("frame_number"),
        F.coalesce("_p.frame_count", F.lit(1)).alias("given_frame_count"),
        *box,
        F.coalesce("_p.supporting_predictions", F.from_json(F.lit("[]"), "array<struct<plate:string,confidence:double,frame:int,is_valid:boolean>>"))
        .alias("supporting_predictions"),
        F.coalesce("_p.frame_predictions", F.from_json(F.lit("[]"), "array<struct<frame_number:int,plate:string,text:string,confidence:double,engine:string>>"))
        .alias("frame_predictions"),
    )


def prediction_columns(df: DataFrame) -> DataFrame:
    """Stored prediction columns: fused text, fused flag, frame count, status."""
    return (
        df.withColumn("fused_plate", F.when(F.col("plate") == "", F.lit("UNKNOWN")).otherwise(F.col("plate")))
        .withColumn("is_fused", (F.size("supporting_predictions") > 1) | (F.size("frame_predictions") > 1))
        .withColumn("frame_count", F.greatest(F.size("frame_predictions"), F.col("given_frame_count")))
        .withColumn(
            "prediction_status",
            F.when(F.col("confidence") >= REVIEW_THRESHOLD, F.col("status")).otherwise(F.lit("manual_review")),
        )
    )


def explode_frames(df: DataFrame, read_id: str = "read_id") -> DataFrame:
    """One row per stored frame; a plated read without frames gets one synthetic row."""
    f = F.col("frame")
    rows = df.select(
        read_id, "plate", "confidence", F.posexplode_outer("frame_predictions").alias("pos", "frame")
    ).filter(f.isNotNull() | (F.col("plate") != ""))
    given = f.isNotNull()
    return rows.select(
        read_id,
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.when(given, F.coalesce(f["frame_number"], F.lit(0))).otherwise(F.lit(1)).alias("frame_number"),
        F.when(given, F.coalesce(f["plate"], f["text"], F.lit(""))).otherwise(F.col("plate")).alias("ocr_text"),
        F.when(given, F.coalesce(f["confidence"], F.lit(0.0))).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce(f["engine"], F.lit("PaddleOCR")).alias("engine"),
    )


# --- reference lookups ----------------------------------------------------------
def resolve_gate(df: DataFrame, gates: DataFrame, ref: str = "gate_ref") -> DataFrame:
    """Add ``gate_id``: the gate of that name, else the gate of that code."""
    by_name = gates.select(F.col("gate_name").alias("_name"), F.col("gate_id").alias("_by_name"))
    by_code = gates.select(F.col("gate_code").alias("_code"), F.col("gate_id").alias("_by_code"))
    return (
        df.join(by_name, F.col(ref) == F.col("_name"), "left")
        .join(by_code, F.col(ref) == F.col("_code"), "left")
        .withColumn("gate_id", F.coalesce("_by_name", "_by_code"))
        .drop("_name", "_by_name", "_code", "_by_code")
    )


def event_direction(direction: Column, camera_code: Column) -> Column:
    """``exit`` for exit cameras and codes containing EXIT, otherwise ``entry``."""
    return F.when((direction == "exit") | F.upper(camera_code).contains("EXIT"), F.lit("exit")).otherwise(F.lit("entry"))


def resolve_camera(df: DataFrame, cameras: DataFrame, ref: str = "camera_code") -> DataFrame:
    """Add ``camera_id`` and ``event_type``; by code first, then by name."""
    by_code = cameras.select(
        F.col("camera_code").alias("_code"), F.col("camera_id").alias("_id1"), F.col("direction").alias("_d1")
    )
    by_name = cameras.select(
        F.col("camera_name").alias("_name"), F.col("camera_id").alias("_id2"), F.col("direction").alias("_d2")
    )
    direction = F.when(F.col("_id1").isNotNull(), F.col("_d1")).otherwise(F.col("_d2"))
    return (
        df.join(by_code, F.col(ref) == F.col("_code"), "left")
        .join(by_name, F.col(ref) == F.col("_name"), "left")
        .withColumn("camera_id", F.coalesce("_id1", "_id2"))
        .withColumn("event_type", event_direction(F.coalesce(direction, F.lit("")), F.col(ref)))
        .drop("_code", "_id1", "_d1", "_name", "_id2", "_d2")
    )


def _scattered(plate: Column, row_id: Column) -> Column:
    """Join key in which unreadable plates do not share one value.

    They match nothing, so a key of their own spreads them over all tasks.
    """
    return F.when(plate.isNull() | plate.isin("", "UNKNOWN"), F.concat(F.lit("#"), row_id.cast("string"))).otherwise(plate)


def join_registry(
    df: DataFrame, vehicles: DataFrame, plate: str = "plate", row_id: str = "read_id", active_only: bool = False
) -> DataFrame:
    """Left-join the vehicle master on the normalised plate of both sides.

    Spellings that normalise to one plate are one vehicle, the one with the
    smallest ``vehicle_id``: a read stays one row.
    """
    if active_only and "is_active" in vehicles.columns:
        vehicles = vehicles.filter("is_active")
    v = vehicles.select(
        plate_key(F.col("plate_number")).alias("_vkey"),
        F.col("vehicle_id"),
        F.col("vehicle_type").alias("registered_type"),
        F.col("owner_name"),
        F.col("transporter").alias("registered_transporter"),
        F.col("is_authorized"),
    )
    first = F.min_by(F.struct(*[c for c in v.columns if c != "_vkey"]), F.struct("vehicle_id", "owner_name"))
    v = v.groupBy("_vkey").agg(first.alias("_v")).select("_vkey", "_v.*")
    return (
        df.withColumn("_key", _scattered(plate_key(F.col(plate)), F.col(row_id)))
        .join(v, F.col("_key") == F.col("_vkey"), "left")
        .withColumn("transporter", F.coalesce("registered_transporter", F.lit("Unregistered")))
        .drop("_key", "_vkey", "registered_transporter")
    )


def join_list(
    df: DataFrame,
    entries: DataFrame,
    name: str,
    plate: str = "plate",
    row_id: str = "read_id",
    valid_at: str | None = None,
) -> DataFrame:
    """Add ``{name}_match`` and ``{name}_reason`` from the active list entries.

    Of several entries for a plate the first that applies counts: without a
    ``valid_from`` first, then the earliest, then by reason; a read stays one
    row.  ``valid_at`` names a time column and restricts to entries valid then
    (null limits are open).
    """
    limits = [F.col(c) if c in entries.columns else F.lit(None).cast("timestamp_ntz").alias(c) for c in ("valid_from", "valid_until")]
    e = entries.filter("is_active").select(plate_key(F.col("plate_number")).alias("_lkey"), *limits, "reason")
    e = e.groupBy("_lkey").agg(F.sort_array(F.collect_list(F.struct("valid_from", "reason", "valid_until"))).alias("_entries"))
    applies = lambda x: F.lit(True)
    if valid_at:
        t = F.col(valid_at)
        applies = lambda x: (x["valid_from"].isNull() | (t >= x["valid_from"])) & (x["valid_until"].isNull() | (t <= x["valid_until"]))
    hit = F.get(F.filter("_entries", applies), F.lit(0))
    return (
        df.withColumn("_key", _scattered(plate_key(F.col(plate)), F.col(row_id)))
        .join(e, F.col("_key") == F.col("_lkey"), "left")
        .withColumn("_hit", hit)
        .withColumn(f"{name}_match", F.col("_hit").isNotNull())
        .withColumn(f"{name}_reason", F.col("_hit.reason"))
        .drop("_key", "_lkey", "_entries", "_hit")
    )


def unknown_vehicles(df: DataFrame, vehicles: DataFrame, plate: str = "plate") -> DataFrame:
    """Plated reads without a registered vehicle."""
    keys = vehicles.select(plate_key(F.col("plate_number")).alias("_vkey"))
    return (
        df.filter((F.col(plate) != "") & (F.col(plate) != "UNKNOWN"))
        .withColumn("_key", plate_key(F.col(plate)))
        .join(keys, F.col("_key") == F.col("_vkey"), "left_anti")
        .drop("_key")
    )


# --- decision -------------------------------------------------------------------
def gate_decisions(df: DataFrame, policy: str = "confidence_first", review_threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Add ``decision``, ``reason`` and ``rule_matched``.

    Needs ``confidence``, ``vehicle_id``, ``is_authorized``, ``whitelist_match``,
    ``watchlist_match`` and ``watchlist_reason``; the policies
    ``trip_required`` and ``watchlist_first`` also need ``has_open_trip``.
    """
    known = F.col("vehicle_id").isNotNull()
    barred = known & ~F.col("is_authorized")
    watch, white = F.col("watchlist_match"), F.col("whitelist_match")
    percent = F.floor(F.col("confidence") * 100).cast("int").cast("string")
    low_text = F.concat(F.lit("Low OCR recognition confidence ("), percent, F.lit("% < 75%)"))
    deny_text = F.when(watch, F.col("watchlist_reason")).otherwise(F.lit("Vehicle marked as Flagged/Unauthorized"))
    low = (F.col("confidence") < review_threshold, "manual_review", low_text, "low_confidence_threshold")
    deny = (watch | barred, "deny", deny_text, "watchlist_blacklist_enforcement")
    allow_white = (white, "allow", F.lit("Vehicle matched valid Whitelist registration"), "whitelist_preapproved")
    allow_known = (known, "allow", F.lit("Registered authorized vehicle"), "master_vehicle_registry")
    review = ("manual_review", F.lit("Unregistered vehicle not found in database"), "unknown_vehicle_review")
    if policy == "confidence_first":
        rules, otherwise = [low, deny, allow_white, allow_known], review
    elif policy == "watchlist_first":
        trip = F.col("has_open_trip")
        rules = [deny, allow_white, low, (trip, "allow", F.lit("Open trip for this vehicle"), "scheduled_trip_valid")]
        otherwise = ("manual_review", F.lit("No open trip for this vehicle"), "no_open_trip_review")
    elif policy == "trip_required":
        rules = [
            (barred, "deny", F.lit("Unauthorized vehicle"), "unauthorized_vehicle"),
            (~known | ~F.col("has_open_trip"), "manual_review", F.lit("No vehicle or open trip"), "trip_missing"),
        ]
        otherwise = ("allow", F.lit("Open trip for this vehicle"), "scheduled_trip_valid")
    else:
        raise ValueError(f"unknown policy {policy!r}")
    out = []
    for i in (1, 2, 3):
        chain = None
        for rule in rules:
            value = rule[i] if isinstance(rule[i], Column) else F.lit(rule[i])
            chain = F.when(rule[0], value) if chain is None else chain.when(rule[0], value)
        last = otherwise[i - 1]
        out.append(chain.otherwise(last if isinstance(last, Column) else F.lit(last)))
    return df.withColumns({"decision": out[0], "reason": out[1], "rule_matched": out[2]})


# --- alerts ---------------------------------------------------------------------
def alert_rows(events: DataFrame, review_threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Alerts of decided events; independent of the decision taken."""
    plated = ~F.col("plate_number").isin("", "UNKNOWN")
    known = F.col("vehicle_id").isNotNull()
    barred = F.col("watchlist_match") | (known & ~F.col("is_authorized"))
    low = (F.col("confidence") < review_threshold) & plated
    kind = (
        F.when(barred, F.lit("Watchlist Alert"))
        .when(~known & plated, F.lit("Unknown Vehicle"))
        .when(low, F.lit("Low Confidence Read"))
    )
    percent = F.floor(F.col("confidence") * 100).cast("int").cast("string")
    message = (
        F.when(
            F.col("alert_type") == "Watchlist Alert",
            F.concat(F.lit("Watchlist vehicle "), "plate_number", F.lit(" detected at "), "gate_name"),
        )
        .when(F.col("alert_type") == "Unknown Vehicle", F.lit("Unregistered vehicle"))
        .otherwise(F.concat(F.lit("Low confidence read of "), "plate_number", F.lit(" ("), percent, F.lit("%) at "), "gate_name"))
    )
    return (
        events.withColumn("alert_type", kind)
        .filter("alert_type is not null")
        .withColumn("severity", F.when(F.col("alert_type") == "Low Confidence Read", F.lit("medium")).otherwise(F.lit("high")))
        .withColumn("message", message)
        .select("event_id", "alert_type", "severity", "message", "plate_number", "vehicle_id", "gate_name", "ts")
    )


def alert_deliveries(alerts: DataFrame) -> DataFrame:
    """Delivery rows; low-confidence alerts are not delivered."""
    recipient = F.when(F.col("alert_type") == "Watchlist Alert", F.lit("security_guard_console")).otherwise(F.lit("guard_console"))
    return alerts.filter("severity = 'high'").select(
        "event_id", F.lit("websocket").alias("channel"), recipient.alias("recipient"), F.lit("delivered").alias("status"), "ts"
    )


def latest_vehicle_status(events: DataFrame) -> DataFrame:
    """Inside after any entry, Exited after any exit - the latest event counts."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return events.filter("vehicle_id is not null").groupBy("vehicle_id").agg(
        F.when(last == "entry", F.lit("Inside")).otherwise(F.lit("Exited")).alias("status"),
        F.max("ts").alias("last_event_at"),
    )

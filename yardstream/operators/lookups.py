"""Searches, lists and newest-first views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_events(
    events: DataFrame, search: str | None = None, decision: str | None = None, event_type: str | None = None, limit: int = 100
) -> DataFrame:
    """Newest events whose plate, gate or transporter contains ``search`` (any case)."""
    if search:
        needle = search.strip().upper()
        hit = [F.upper(c).contains(needle) for c in ("plate_number", "gate_name", "transporter")]
        events = events.filter(hit[0] | hit[1] | hit[2])
    if decision:
        events = events.filter(F.col("decision") == decision)
    if event_type:
        events = events.filter(F.col("event_type") == event_type)
    top = events.orderBy(F.desc("event_id")).limit(limit)
    return top.select(
        "event_id", "plate_number", "event_type", "gate_name", "camera_name", "decision",
        F.round("confidence", 2).alias("confidence"), "ts", "vehicle_type", "transporter", "is_corrected",
    )


def activity_feed(events: DataFrame, limit: int = 10, name_transporter: bool = True) -> DataFrame:
    """Newest events as feed entries; the newest one is accented."""
    top = events.orderBy(F.desc("event_id")).limit(limit)
    newest = top.agg(F.max("event_id")).scalar()
    denied = F.concat(F.lit("Access denied ("), "transporter", F.lit(")")) if name_transporter else F.lit("Access denied")
    waiting = "Awaiting manual review" if name_transporter else "Awaiting review"
    detail = (
        F.when(F.col("decision") == "allow", F.lit("Authorized movement"))
        .when(F.col("decision") == "deny", denied)
        .otherwise(F.lit(waiting))
    )
    tone = (
        F.when(F.col("decision") == "deny", F.lit("danger"))
        .when(F.col("decision") == "manual_review", F.lit("warning"))
        .when(F.col("event_id") == newest, F.lit("accent"))
        .otherwise(F.lit("muted"))
    )
    verb = F.when(F.col("event_type") == "entry", F.lit(" entered")).otherwise(F.lit(" exited"))
    return top.select(
        "event_id", F.when(F.col("decision") == "deny", F.lit("alert")).otherwise(F.col("event_type")).alias("kind"),
        F.concat("plate_number", verb).alias("title"), F.concat("gate_name", F.lit(" · "), detail).alias("detail"),
        "ts", tone.alias("tone"),
    )


def alert_inbox(alerts: DataFrame, limit: int = 50, severity: str | None = None, alert_type: str | None = None) -> DataFrame:
    if severity:
        alerts = alerts.filter(F.col("severity") == severity)
    if alert_type:
        alerts = alerts.filter(F.col("alert_type") == alert_type)
    return alerts.orderBy(F.desc("alert_id")).limit(limit)


def unread_count(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.col("is_read")).agg(F.count("*").alias("unread"))


def review_queue(predictions: DataFrame, limit: int = 30) -> DataFrame:
    """Newest predictions waiting for an operator, with the reason."""
    percent = (F.col("confidence") * 100).cast("int").cast("string")
    low = F.concat(F.lit("Low OCR confidence ("), percent, F.lit("% < 75%) requires operator confirmation"))
    top = predictions.filter(F.col("status") == "manual_review").orderBy(F.desc("prediction_id")).limit(limit)
    return top.select(
        "prediction_id", F.col("fused_text").alias("plate"),
        F.coalesce(F.nullif("raw_text", F.lit("")), "fused_text").alias("raw_text"),
        F.round("confidence", 2).alias("confidence"), F.coalesce("gate_name", F.lit("Gate 01")).alias("gate_name"), "created_at",
        F.when(F.col("confidence") < 0.75, low).otherwise(F.lit("Character ambiguity / unverified vehicle passage")).alias("reason"),
        F.lit("Pending").alias("status"),
    )


def primary_plates(plates: DataFrame) -> DataFrame:
    """The primary active plate of each vehicle, else its first one."""
    rank = F.struct(F.col("is_primary") & F.col("is_active"), -F.col("plate_id"))
    return plates.groupBy("vehicle_id").agg(F.max_by("plate_number", rank).alias("plate"))


def vehicle_list(vehicles: DataFrame, plates: DataFrame) -> DataFrame:
    return vehicles.join(primary_plates(plates), "vehicle_id", "left").select(
        "vehicle_id", F.coalesce("plate", F.lit("UNKNOWN")).alias("plate"), "vehicle_type",
        F.coalesce("owner_name", F.lit("Unknown Owner")).alias("owner_name"),
        F.coalesce("transporter", F.lit("Unregistered")).alias("transporter"), "is_authorized",
    )


def driver_list(drivers: DataFrame, plates: DataFrame) -> DataFrame:
    plate = primary_plates(plates).withColumnRenamed("vehicle_id", "assigned_vehicle_id")
    return drivers.filter("is_active").join(plate, "assigned_vehicle_id", "left").select(
        "driver_id", "name", "license_number", F.coalesce("plate", F.lit("Unassigned")).alias("plate")
    )


def camera_list(cameras: DataFrame, gates: DataFrame) -> DataFrame:
    g = gates.select("gate_id", F.col("gate_name").alias("_gate"))
    return cameras.drop("gate_name").join(g, "gate_id", "left").select(
        "camera_id", "camera_name", F.coalesce("_gate", F.lit("Gate 01")).alias("gate_name"), "direction", "status",
        F.when(F.col("status") == "online", F.lit("just now")).otherwise(F.lit("offline")).alias("last_seen"),
    )


def search_plate(sources: dict[str, DataFrame], fragment: str) -> DataFrame:
    """Rows of all sources whose plate contains ``fragment``.

    Each source has the columns (id, plate, detail, ts).
    """
    clean = "".join(c for c in fragment.upper() if c.isalnum())
    parts = [
        df.filter(F.upper("plate").contains(clean)).select(F.lit(name).alias("source"), F.col("id").cast("long").alias("id"), "plate", "detail", "ts")
        for name, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def latest_rows(df: DataFrame, order: str, limit: int = 5) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(limit)


def text_filter(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows whose space-joined columns contain ``needle`` (any case)."""
    return df.filter(F.lower(F.concat_ws(" ", *columns)).contains(needle.lower()))


def confidence_band(confidence: Column) -> Column:
    percent = F.round(F.when(confidence <= 1.0, confidence * 100).otherwise(confidence))
    return F.when(percent >= 90, F.lit("high")).when(percent >= 75, F.lit("medium")).otherwise(F.lit("low"))

"""Operational reports over the register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstream.operators.trips import overstays

DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def one_row(*parts: DataFrame) -> DataFrame:
    """Put the columns of one-row frames side by side (a union and a maximum, no join)."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.agg(*[F.max(c).alias(c) for c in union.columns])


def dashboard_summary(
    trips: DataFrame, events: DataFrame, alerts: DataFrame, cameras: DataFrame, gates: DataFrame, as_of: Column
) -> DataFrame:
    """The key-figure row at ``as_of``."""
    today = events.filter(F.col("ts") >= F.date_trunc("day", as_of.cast("timestamp")).cast("timestamp_ntz"))
    inside = F.col("status").isin("inside_plant", "at_destination", "entry_approved")
    mean_dwell = F.avg(F.when(F.col("dwell_minutes") > 0, F.col("dwell_minutes")))
    return one_row(
        trips.agg(
            F.count_if(inside).alias("vehicles_inside"),
            F.coalesce(F.round(mean_dwell, 1), F.lit(45.0)).alias("avg_dwell_minutes"),
        ),
        today.agg(
            F.count_if(F.col("event_type") == "entry").alias("entries_today"),
            F.count_if(F.col("event_type") == "exit").alias("exits_today"),
        ),
        events.agg(F.coalesce(F.round(F.avg("confidence"), 2), F.lit(0.94)).alias("recognition_accuracy")),
        alerts.agg(F.count_if(~F.col("is_read")).alias("active_alerts")),
        cameras.agg(F.coalesce(F.nullif(F.count_if(F.col("status") == "online"), F.lit(0)), F.lit(3)).alias("gates_online")),
        gates.agg(F.coalesce(F.nullif(F.count("*"), F.lit(0)), F.lit(3)).alias("total_gates")),
    )


def decision_counts(events: DataFrame) -> DataFrame:
    """Counts of the three decisions in report order."""
    decision = F.coalesce("decision", F.lit("allow"))
    counted = events.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))
    row = counted.agg(*[F.coalesce(F.sum(F.when(F.col("decision") == d, F.col("n"))), F.lit(0)).alias(d) for d in ("allow", "manual_review", "deny")])
    labelled = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(d).alias("value"))
          for i, (label, d) in enumerate((("Allow", "allow"), ("Review", "manual_review"), ("Deny", "deny")))]
    )
    total = F.col("allow") + F.col("manual_review") + F.col("deny")
    return row.select(F.inline(labelled), F.when(total > 0, F.round(F.col("allow") / total * 100)).otherwise(F.lit(0.0)).alias("approval_rate"))


def gate_volume(events: DataFrame, gates: DataFrame) -> DataFrame:
    """Events and exits per gate; an event counts when its gate id or gate name fits.

    Events are first counted per (id, name), so the two joins see a few rows; a
    name match is skipped where the id already matched the same gate.
    """
    counts = events.groupBy("gate_id", "gate_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "exit").alias("x")
    ).withColumnsRenamed({"gate_id": "_id", "gate_name": "_name"})
    by_id = gates.join(counts, F.col("gate_id") == F.col("_id"))
    by_name = gates.join(counts, F.col("gate_name") == F.col("_name")).filter(~F.col("gate_id").eqNullSafe(F.col("_id")))
    hits = by_id.unionByName(by_name).groupBy("gate_id").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    zero = F.lit(0).cast("long")
    return gates.join(hits, "gate_id", "left").select(
        F.replace("gate_name", F.lit("Gate "), F.lit("G")).alias("label"),
        F.coalesce("n", zero).alias("value"), F.coalesce("x", zero).alias("secondary"),
    )


def top_transporters(events: DataFrame, limit: int = 6) -> DataFrame:
    """Most frequent transporters by first word; ties go to the first seen."""
    return (
        events.filter(F.col("transporter").isNotNull() & (F.col("transporter") != ""))
        .groupBy("transporter")
        .agg(F.count("*").alias("value"), F.min("event_id").alias("_first"))
        .orderBy(F.desc("value"), "_first")
        .limit(limit)
        .select(F.split("transporter", " ").getItem(0).alias("label"), "value")
    )


def dwell_trend(events: DataFrame, trips: DataFrame) -> DataFrame:
    """Weekday series: mean dwell of all trips plus two minutes per event of the day, at least 10."""
    mean = trips.agg(F.coalesce(F.avg("dwell_minutes").cast("int"), F.lit(28))).scalar()
    counts = events.groupBy(F.weekday("ts").alias("day")).agg(F.count("*").alias("n"))
    days = events.sparkSession.range(7).select(F.col("id").cast("int").alias("day"))
    value = F.greatest(F.lit(10), mean + F.coalesce("n", F.lit(0)) * 2)
    return days.join(counts, "day", "left").select(
        F.element_at(F.lit(list(DAYS)), F.col("day") + 1).alias("label"), value.alias("value"),
        (value * 1.25).cast("long").alias("secondary"),
    )


def dwell_by_weekday(trips: DataFrame) -> DataFrame:
    return (
        trips.filter("actual_exit_time is not null and dwell_minutes is not null")
        .groupBy(F.weekday("actual_exit_time").alias("day"))
        .agg(F.round(F.avg("dwell_minutes"), 4).alias("mean_dwell"), F.count("*").alias("n"))
        .select(F.element_at(F.lit(list(DAYS)), F.col("day") + 1).alias("label"), "mean_dwell", "n")
    )


def repeat_visitors(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("plate_number").isNotNull() & ~F.col("plate_number").isin("", "UNKNOWN"))
        .groupBy("plate_number")
        .count()
        .agg(F.count_if(F.col("count") > 1).alias("repeat_visitors"))
    )


def overstay_count(trips: DataFrame, as_of: Column, overstay_minutes: int = 60) -> DataFrame:
    return overstays(trips, as_of, overstay_minutes).agg(F.count("*").alias("overstays"))


def corrected_reads(corrections: DataFrame, events: DataFrame) -> DataFrame:
    """Manual corrections plus events marked corrected (both count), and all reads."""
    parts = one_row(
        corrections.agg(F.count("*").alias("_corrections")),
        events.agg(F.count_if(F.col("is_corrected")).alias("_marked"), F.count("*").alias("total_reads")),
    )
    return parts.select((F.col("_corrections") + F.col("_marked")).alias("corrected_reads"), "total_reads")


def daily_gate_summary(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Entries, exits, denials, reviews, alerts and mean dwell per gate and day."""
    day = events.groupBy("gate_id", F.to_date("ts").alias("summary_date")).agg(
        F.count_if(F.col("event_type") == "entry").alias("total_entries"),
        F.count_if(F.col("event_type") == "exit").alias("total_exits"),
        F.count_if(F.col("decision") == "deny").alias("total_denied"),
        F.count_if(F.col("decision") == "manual_review").alias("total_reviews"),
        F.coalesce(F.round(F.avg("dwell_minutes"), 4), F.lit(0.0)).alias("avg_dwell_minutes"),
    )
    raised = alerts.groupBy("gate_id", F.to_date("created_at").alias("summary_date")).agg(F.count("*").alias("_alerts"))
    return (
        day.join(raised, ["gate_id", "summary_date"], "left")
        .withColumn("total_alerts", F.coalesce("_alerts", F.lit(0).cast("long")))
        .drop("_alerts")
    )


def camera_health_latest(samples: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("is_online", "response_time_ms"), F.struct("last_check_at", "sample_id"))
    return (
        samples.groupBy("camera_id")
        .agg(
            last.alias("_last"), F.max("last_check_at").alias("last_check_at"), F.count("*").alias("samples"),
            F.round(F.avg(F.col("is_online").cast("int")), 4).alias("online_share"),
            F.round(F.avg("response_time_ms"), 4).alias("mean_response_ms"),
        )
        .select("camera_id", F.col("_last.is_online").alias("is_online"), F.col("_last.response_time_ms").alias("response_time_ms"),
                "last_check_at", "samples", "online_share", "mean_response_ms")
    )


def hourly_traffic(events: DataFrame) -> DataFrame:
    return events.groupBy("gate_name", F.hour("ts").alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "exit").alias("exits")
    )


def hourly_heat_map(events: DataFrame) -> DataFrame:
    """One row per gate, one column per hour."""
    return events.groupBy("gate_name").agg(*[F.count_if(F.hour("ts") == h).alias(f"h{h:02d}") for h in range(24)])

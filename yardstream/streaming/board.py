"""Live views: newest detection per track, counts per gate, overstay timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from yardstream.functions.windows import micros
from yardstream.sources.tables import scratch_dir
from yardstream.streaming.buckets import KeyBucket, bucket_of
from yardstream.streaming.running import run_batches, use_rocksdb


def latest_view(stream: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Newest row and cumulative count per key; for update or complete mode."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"), F.count("*").alias("detections")).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in columns], "detections"
    )


def run_latest_view(stream: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Keep the view current: each micro-batch writes only the keys it changed.

    The view is the newest row per key over the changes.
    """
    spark = stream.sparkSession
    out = scratch_dir(spark, "latest")
    run_batches(latest_view(stream, key, order, columns), "latest", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch_id={n}"), mode="update")
    changes = spark.read.parquet(out)
    rows = [c for c in changes.columns if c != "batch_id"]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rows), "batch_id").alias("_r")).select("_r.*")


def gate_counts(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Entries and exits per gate and tumbling window; windows appear once complete."""
    timed = stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", width).alias("w"), "gate_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "exit").alias("exits")
    ).select("gate_name", F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n", "exits")


class _Overstay(KeyBucket):
    """Per open trip its expected departure in milliseconds."""

    def due(self, value: int) -> int:
        return value - 1  # a departure at the watermark itself is due

    def change(self, keys: dict, rows: Iterator[Row]) -> Iterator[Row]:
        opened, closed = {}, set()
        for r in rows:
            trip, due = r["trip_id"], r["due_us"]
            if r["is_closed"]:
                closed.add(trip)
            elif due is not None:
                opened[trip] = max(due // 1000, opened.get(trip, due // 1000))
        keys.update(opened)
        for trip in closed:
            keys.pop(trip, None)
        return iter(())

    def expire(self, keys: dict, key) -> Iterator[Row]:
        yield Row(trip_id=key, due_ms=keys.pop(key))


def overstay_timers(changes: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Alerts for trips not closed by their expected departure.

    ``changes``: trip_id, ts, expected_departure, is_closed.
    """
    use_rocksdb(changes.sparkSession)
    timed = changes.withColumns({"event_time": F.col("ts").cast("timestamp"), "due_us": micros(F.col("expected_departure"))})
    timed = timed.select("trip_id", "event_time", "due_us", "is_closed", bucket_of(F.col("trip_id")).alias("bucket")).withWatermark("event_time", delay)
    fired = timed.groupBy("bucket").transformWithState(
        statefulProcessor=_Overstay(), outputStructType="trip_id long, due_ms long", outputMode="Append", timeMode="EventTime"
    )
    return fired.select("trip_id", F.timestamp_millis("due_ms").cast("timestamp_ntz").alias("due_at"), F.lit("Overstay").alias("alert_type"), F.lit("high").alias("severity"))

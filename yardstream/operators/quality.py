"""Recognition quality, latency and stage statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstream.functions.windows import running_sum

OCR_LOG_SCHEMA = "timestamp string, variant string, success boolean, plate string, confidence double, time_ms double, error string"


def read_ocr_log(spark, path: str) -> DataFrame:
    """Scan the JSON-lines reading log with its declared schema.

    A line that is not whole JSON of that schema comes back in ``broken`` as it
    stands, with null fields; ``broken`` is null for the others.  Blank lines
    are no lines.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", OCR_LOG_SCHEMA + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    fields = [f.strip().split(" ")[0] for f in OCR_LOG_SCHEMA.split(",")]
    rows = lines.select(parsed.alias("r")).select("r.*")
    return rows.select(*[F.when(F.col("broken").isNull(), F.col(c)).alias(c) for c in fields], "broken")


def ocr_log_state(log: DataFrame) -> DataFrame:
    """One row: lines of the log, and how many of them are broken."""
    return log.agg(F.count("*").alias("lines"), F.count("broken").alias("broken_lines"))


def ocr_log_summary(log: DataFrame) -> DataFrame:
    """Reads, success rate, mean time and confidence per variant; broken lines are set apart."""
    whole = log.filter("broken is null") if "broken" in log.columns else log
    return whole.groupBy(F.coalesce("variant", F.lit("main")).alias("variant")).agg(
        F.count("*").alias("reads"), F.round(F.avg(F.col("success").cast("int")), 4).alias("success_rate"),
        F.round(F.avg("time_ms"), 4).alias("mean_ms"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )


def recognition_quality(results: DataFrame) -> DataFrame:
    """One row of accuracy figures from (truth, plate, confidence, condition)."""
    shorter = F.least(F.length("truth"), F.length("plate"))
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), F.lit(0),
        lambda n, i: n + F.when((i <= shorter) & (F.col("truth").substr(i, F.lit(1)) == F.col("plate").substr(i, F.lit(1))), 1).otherwise(0),
    )
    exact = F.col("truth") == F.col("plate")
    share = lambda c: F.round(F.avg(c.cast("int")) * 100, 4)
    return results.agg(
        F.count("*").alias("samples"),
        F.round(F.sum(same) / F.sum(F.greatest(F.length("truth"), F.length("plate"))) * 100, 4).alias("char_accuracy"),
        share(exact).alias("exact_accuracy"),
        share(F.when(F.col("condition") == "Day", exact)).alias("day_accuracy"),
        share(F.when(F.col("condition") == "Night", exact)).alias("night_accuracy"),
        share((F.col("confidence") < 0.75) | ~exact).alias("manual_rate"),
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], slices: int = 64) -> DataFrame:
    """(keys, share, result): exact percentiles with linear interpolation.

    A sketch cuts the values of a key into slices of about equal size; counts
    per slice tell which slices hold the wanted ranks, and only their values
    are ordered.  No task holds all values of a key.
    """
    keys = list(keys)
    df = df.filter(F.col(value).isNotNull()).select(*keys, value)
    cuts = [i / slices for i in range(1, slices)]
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, cuts, 1000).alias("_edges"), F.count("*").alias("_n"))
    rows = df.join(edges, keys).withColumn("_slice", F.size(F.filter("_edges", lambda e: e < F.col(value))))
    counts = rows.groupBy(*keys, "_slice", "_n").agg(F.count("*").alias("_c"))
    counts = running_sum(counts, keys, ["_slice"], F.col("_c"), F.lit(0), "_upto")
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("share"), ((F.col("_n") - 1) * p).alias("at")) for p in shares])).alias("w")
    ranks = F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("rank")
    targets = edges.select(*keys, "_n", wanted).select(*keys, "w.share", "w.at", ranks)
    held = counts.select(*keys, "_slice", (F.col("_upto") - F.col("_c")).alias("_base"), "_upto").join(targets, keys)
    held = held.filter((F.col("rank") >= F.col("_base")) & (F.col("rank") < F.col("_upto")))
    need = held.select(*keys, "_slice", "_base").distinct()
    values = rows.join(need, [*keys, "_slice"]).groupBy(*keys, "_slice", "_base", value).agg(F.count("*").alias("_k"))
    values = running_sum(values, [*keys, "_slice"], [value], F.col("_k"), F.lit(0), "_in")
    values = values.select(*keys, "_slice", F.col(value).alias("_v"), (F.col("_base") + F.col("_in") - F.col("_k")).alias("_lo"), (F.col("_base") + F.col("_in")).alias("_hi"))
    picked = held.drop("_base", "_upto").join(values, [*keys, "_slice"]).filter((F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")))
    low, high = F.min_by("_v", "rank"), F.max_by("_v", "rank")
    return picked.groupBy(*keys, "share", "at").agg((low + (high - low) * (F.col("at") - F.floor("at"))).alias("result")).drop("at")


def latency_profile(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, extremes, p95, p99 and frames per second per stage."""
    keys = list(keys)
    basic = samples.groupBy(*keys).agg(
        F.count("*").alias("iterations"), F.avg(value).alias("_mean"), F.round(F.min(value), 2).alias("min_ms"), F.round(F.max(value), 2).alias("max_ms")
    )
    p = exact_percentiles(samples, keys, value, (0.5, 0.95, 0.99)).groupBy(*keys).agg(
        *[F.round(F.max(F.when(F.col("share") == s, F.col("result"))), 4).alias(n) for s, n in ((0.5, "median_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))]
    )
    return basic.join(p, keys).select(
        *keys, "iterations", F.round("_mean", 4).alias("mean_ms"), "median_ms", "min_ms", "max_ms", "p95_ms", "p99_ms",
        F.when(F.col("_mean") > 0, F.round(1000.0 / F.col("_mean"), 2)).otherwise(F.lit(0.0)).alias("fps"),
    )


def stage_breakdown(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean milliseconds per frame and per reading call.

    Input per processed frame: ``vehicle_ms, plate_ms, ocr_ms`` (null without
    call) and ``frame_step``.
    """
    total = F.sum(F.col("vehicle_ms") + F.col("plate_ms") + F.coalesce("ocr_ms", F.lit(0.0)))
    n, calls = F.count("*"), F.count("ocr_ms")
    return frames.groupBy(*keys).agg(
        n.alias("frames_processed"), (F.sum("frame_step") - n).alias("frames_skipped"), calls.alias("ocr_calls"),
        F.round(F.avg("vehicle_ms"), 6).alias("avg_vehicle_ms"), F.round(F.avg("plate_ms"), 6).alias("avg_plate_ms"),
        F.coalesce(F.round(F.avg("ocr_ms"), 6), F.lit(0.0)).alias("avg_ocr_ms"), F.round(total / n, 6).alias("avg_frame_ms"),
        F.round(n / F.greatest(F.lit(0.001), total / 1000), 6).alias("fps"),
    )

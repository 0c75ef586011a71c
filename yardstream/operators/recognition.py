"""Choosing and scoring recognised texts: candidates, tokens, near duplicates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstream.functions.plate_rules import (
    CLIP_LOOSE, CLIP_STRICT, SERVICE, VIDEO, folded_key, is_state, minimal_fix, normalize_plates, plate_clean, validate_plates,
)
from yardstream.functions.windows import busy_spells, micros, sorted_scan


def best_candidate(df: DataFrame, keys: Sequence[str], text: str, confidence: str, order: str) -> DataFrame:
    """Most confident text per key, complete-format texts before loosely matching ones."""
    strict = F.col(text).rlike(CLIP_STRICT)
    rank = F.struct(strict, F.col(confidence), -F.col(order))
    best = F.max_by(F.struct(F.col(text), F.col(confidence), strict.alias("is_strict")), rank)
    return (
        df.filter(strict | F.col(text).rlike(CLIP_LOOSE))
        .groupBy(*keys)
        .agg(best.alias("_best"))
        .select(*keys, F.col(f"_best.{text}").alias("best_text"), F.col(f"_best.{confidence}").alias("best_confidence"), "_best.is_strict")
    )


def frame_quality(has_vehicle: Column, has_plate: Column, best_confidence: Column) -> Column:
    """0.35 (0.05 without vehicle) + 0.30 for a plate box + 0.35 of the text confidence."""
    return (
        F.when(has_vehicle, F.lit(0.35)).otherwise(F.lit(0.05))
        + F.when(has_plate, F.lit(0.30)).otherwise(F.lit(0.0))
        + F.when(best_confidence.isNotNull(), F.least(best_confidence, F.lit(1.0)) * 0.35).otherwise(F.lit(0.0))
    )


def score_candidates(df: DataFrame, keys: Sequence[str], text: str, confidence: str, order: str) -> DataFrame:
    """Best plate per key by state, syntax, length and confidence points."""
    df = validate_plates(df, text, "_once", VIDEO)
    df = validate_plates(df, "_once_plate", "_v", VIDEO)
    plate, n = F.col("_v_plate"), F.length("_v_plate")
    usual = n.isin(9, 10)
    points = (
        F.when(is_state("_v_plate", VIDEO.states), 35.0).when(is_state("_v_plate", VIDEO.fix_keys()), 15.0).otherwise(0.0)
        + F.when(F.col("_v_valid"), 45.0).when(usual, 20.0).otherwise(0.0)
        + F.when(usual, 15.0).otherwise(F.greatest(F.lit(0.0), 10.0 - F.abs(n - 10) * 2.0))
        + F.col(confidence) * 15.0
    )
    conf = F.when(F.col("_v_valid"), F.greatest(F.col("_v_conf"), F.lit(0.70))).otherwise(F.col(confidence))
    # unusable texts get no rank instead of a filter, which would be pushed below
    # and repeat the whole rule expression
    rank = F.when(F.length("_once_plate") >= 4, F.struct(points, -F.col(order)))
    best = F.max_by(F.struct(plate.alias("p"), conf.alias("c"), points.alias("s")), rank)
    return df.groupBy(*keys).agg(best.alias("_b")).filter(F.col("_b").isNotNull()).select(
        *keys, F.col("_b.p").alias("best_plate"), F.round("_b.c", 4).alias("best_confidence"), F.round("_b.s", 4).alias("best_score")
    )


def service_best_text(df: DataFrame, keys: Sequence[str], text: str, confidence: str, order: str) -> DataFrame:
    """Longest, then most frequent normalised text; confidence is the maximum of all texts."""
    df = normalize_plates(df, text, "_t", SERVICE)
    per_text = df.groupBy(*keys, "_t").agg(
        F.count("*").alias("_n"), F.max(confidence).alias("_c"), F.min(order).alias("_o")
    )
    rank = F.when(F.col("_t") != "", F.struct(F.length("_t"), F.col("_n"), -F.col("_o")))
    return (
        per_text.groupBy(*keys)
        .agg(F.max_by("_t", rank).alias("best_text"), F.max(F.when(F.col("_t") != "", F.col("_c"))).alias("best_confidence"))
        .filter("best_text is not null")
    )


def assemble_tokens(
    df: DataFrame, keys: Sequence[str], text: str, score: str, x: str, y: str, order: str, band: float = 20.0
) -> DataFrame:
    """Join the tokens of one crop in reading order; rows of ``band`` pixels, then left to right.

    The list per crop is the value being built: the text itself.
    """
    token = F.struct(F.floor(F.col(y) / band).alias("b"), F.col(x).alias("x"), F.col(order).alias("o"), F.col(text).alias("t"))
    return df.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(token)), lambda v: v["t"]), "").alias("joined_text"),
        F.round(F.avg(score), 4).alias("mean_score"),
    )


def detection_consensus(df: DataFrame, keys: Sequence[str], text: str, confidence: str, order: str) -> DataFrame:
    """Multi-frame submission: first text, minimally corrected, with the mean confidence."""
    from yardstream.functions.plate_rules import minimal_fix, plate_clean

    raw = F.min_by(plate_clean(F.col(text)), F.col(order))
    return (
        df.groupBy(*keys)
        .agg(raw.alias("raw_plate"), F.round(F.avg(confidence), 2).alias("confidence"), F.count("*").alias("n_frames"))
        .withColumn("final_plate", minimal_fix(F.col("raw_plate")))
        .withColumn("is_corrected", F.col("final_plate") != F.col("raw_plate"))
    )


def submission_decision(is_authorized: Column, confidence: Column) -> Column:
    """Decision of a submission: barred vehicles are denied, doubtful ones reviewed."""
    authorized = F.coalesce(is_authorized, F.lit(True))
    return (
        F.when(authorized & (confidence >= 0.75), F.lit("allow"))
        .when(~authorized, F.lit("deny"))
        .otherwise(F.lit("manual_review"))
    )


def _similar(a: str, b: str, threshold: float) -> bool:
    if a == b:
        return bool(a)
    if not a or not b:
        return False
    return sum(p == q for p, q in zip(a, b)) / max(len(a), len(b)) >= threshold


def near_duplicates(
    df: DataFrame,
    camera: str = "camera_id",
    track: str = "track_id",
    plate: str = "plate_number",
    ts: str = "ts",
    event_id: str = "event_id",
    window_seconds: float = 5.0,
    threshold: float = 0.85,
) -> DataFrame:
    """Add ``is_duplicate``: another track with a similar plate was recorded on the
    camera within the window; a duplicate is not recorded itself.

    A pause longer than the window empties the memory, so each busy spell of a
    camera is an independent unit of work.
    """
    window = int(window_seconds * 1_000_000)
    names = [camera, track, plate, event_id]
    rows = df.select(*names, micros(F.col(ts)).alias("_t"))
    rows = busy_spells(rows, [camera], "_t", window, max(window * 64, 3_600_000_000), "_spell")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, []
        for pdf in batches:
            flags = []
            cols = (pdf[camera], pdf["_spell"], pdf["_t"], pdf[track], pdf[plate])
            for cam, spell, t, who, text in zip(*(c.to_list() for c in cols)):
                if (cam, spell) != current:
                    current, recent = (cam, spell), []
                text = text or ""
                recent = [r for r in recent if t - r[0] <= window]
                same = bool(text) and any(r[1] != who and _similar(text, r[2], threshold) for r in recent)
                if text and not same:
                    recent.append((t, who, text))
                flags.append(same)
            yield pd.DataFrame({event_id: pdf[event_id], "is_duplicate": flags})

    kind = df.schema[event_id].dataType.simpleString()
    flagged = sorted_scan(rows, [camera, "_spell"], ["_t", event_id], scan, f"{event_id} {kind}, is_duplicate boolean")
    return df.join(flagged, event_id)


def match_known_plates(reads: DataFrame, known: DataFrame, text: str, order: str) -> DataFrame:
    """Add ``final_plate`` and ``is_known``: the known plate that looks the same when confusable characters are folded.

    Folding makes different plates collide; the first one in ``order`` counts,
    so every read stays one row.  Other texts get the minimal syntax fix.
    """
    first = known.groupBy(folded_key(F.col("plate_number")).alias("_k")).agg(F.min_by("plate_number", order).alias("_known"))
    joined = reads.withColumn("_t", folded_key(F.col(text))).join(first, F.col("_t") == F.col("_k"), "left")
    return joined.select(*reads.columns, F.coalesce("_known", minimal_fix(plate_clean(F.col(text)))).alias("final_plate"), F.col("_known").isNotNull().alias("is_known"))

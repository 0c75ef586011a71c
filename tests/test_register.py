"""Register scenarios: decisions, duplicates, trips, corrections."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from yardstream.operators import master as M
from yardstream.operators import trips as T
from yardstream.operators.dedup import dedup_passages
from yardstream.plans.register_plan import register_batch
from yardstream.sources.tables import read_table
from yardstream.schema import TABLES

T0 = dt.datetime(2024, 5, 1, 8, 0, 0)


@pytest.fixture(scope="module")
def masters(spark):
    cams = spark.createDataFrame([(1, "G01-ENTRY", "Front", "entry"), (2, "G03-EXIT", "Back", "exit")], "camera_id int, camera_code string, camera_name string, direction string")
    gates = spark.createDataFrame([(1, "Gate 01", "G01"), (3, "Gate 03", "G03")], "gate_id int, gate_name string, gate_code string")
    veh = spark.createDataFrame([(1, "TN 37-AB 1234", "Truck", "A", "BlueDart", True), (2, "GJ18BR2290", "Car", "B", "Rana", False)],
                                "vehicle_id long, plate_number string, vehicle_type string, owner_name string, transporter string, is_authorized boolean")
    entry = "vehicle_id long, plate_number string, reason string, is_active boolean"
    return cams, gates, veh, spark.createDataFrame([(1, "TN37AB1234", "ok", True)], entry), spark.createDataFrame([(2, "GJ18BR2290", "stolen", True)], entry)


def test_scenario(spark, masters):
    sent = [("TN37AB1234", 0.92, 0), ("TN37AB1234", 0.92, 5), ("GJ18BR2290", 0.90, 60), ("KA01ZZ0001", 0.88, 120), ("MH12QX9O31", 0.68, 180), ("", 0.9, 181), ("", 0.9, 182)]
    rows = [(i, T0 + dt.timedelta(seconds=s), json.dumps({"plate_number": p, "final_confidence": c, "camera_id": "G01-ENTRY", "gate_id": "Gate 01"})) for i, (p, c, s) in enumerate(sent)]
    msgs = spark.createDataFrame(rows, "read_id long, ts timestamp_ntz, payload string")
    out = register_batch(msgs, *masters)
    decided = {r.event_id: (r.decision, r.rule_matched) for r in out.decisions.collect()}
    assert decided == {
        0: ("allow", "whitelist_preapproved"), 2: ("deny", "watchlist_blacklist_enforcement"), 3: ("manual_review", "unknown_vehicle_review"),
        4: ("manual_review", "low_confidence_threshold"), 5: ("manual_review", "unknown_vehicle_review"), 6: ("manual_review", "unknown_vehicle_review"),
    }
    assert {r.event_id: r.alert_type for r in out.alerts.collect()} == {2: "Watchlist Alert", 3: "Unknown Vehicle", 4: "Unknown Vehicle"}
    assert {r.event_id for r in out.deliveries.collect()} == {2, 3, 4}
    assert out.detections.count() == out.predictions.count() == 7
    assert out.events.filter("event_id = 5").first().plate_number == "UNKNOWN"


def test_whole_flow_with_trips(spark, masters, tmp_path):
    """Entry, 48 minutes inside, exit - from the message to every table, written and read back."""
    from yardstream.sources.tables import append_register, read_register

    sent = [(1, 0, "G01-ENTRY"), (2, 5, "G01-ENTRY"), (3, 48 * 60, "G03-EXIT"), (4, 3 * 3600, "G01-ENTRY"), (5, 4 * 3600, "G03-EXIT")]
    rows = [(i, T0 + dt.timedelta(seconds=s), json.dumps({"plate_number": "TN37AB1234", "final_confidence": 0.92, "camera_id": c, "gate_id": "Gate 01"})) for i, s, c in sent]
    msgs = spark.createDataFrame(rows, "read_id long, ts timestamp_ntz, payload string")
    trips = spark.createDataFrame([(10, "TN37AB1234", "scheduled", None)], "trip_id long, plate_number string, status string, actual_entry_time timestamp_ntz")
    out = register_batch(msgs, *masters, trips=trips)
    append_register(out, str(tmp_path))
    got = {name: read_register(spark, str(tmp_path), name).collect() for name, _ in out.items()}
    assert {r.event_id: (r.event_type, r.decision, r.dwell_minutes) for r in got["events"]} == {
        1: ("entry", "allow", None), 3: ("exit", "allow", 48), 4: ("entry", "allow", None), 5: ("exit", "allow", 60)}
    assert sorted((r.trip_ref, r.status, r.dwell_minutes) for r in got["trips"]) == [(-4, "completed", 60), (10, "completed", 48)]
    assert sorted((r.trip_ref, r.from_status, r.to_status, r.trigger_event_id) for r in got["trip_history"]) == [
        (-4, "inside_plant", "completed", 5), (-4, "scheduled", "inside_plant", 4), (10, "inside_plant", "completed", 3), (10, "scheduled", "inside_plant", 1)]
    assert [(r.vehicle_id, r.status) for r in got["vehicle_status"]] == [(1, "Exited")]
    assert len(got["detections"]) == len(got["predictions"]) == len(got["prediction_frames"]) == 5
    assert register_batch(msgs, *masters).trips.count() == 2


def test_trip_scenario(spark):
    trips = spark.createDataFrame([(10, "TN37AB1234", "scheduled", None), (11, "TN37AB1234", "completed", None)],
                                  "trip_id long, plate_number string, status string, actual_entry_time timestamp_ntz")
    ev = spark.createDataFrame([
        (1, T0, "TN37AB1234", "entry", "allow"), (2, T0 + dt.timedelta(minutes=48), "TN37AB1234", "exit", "allow"),
        (3, T0 + dt.timedelta(hours=2), "TN37AB1234", "entry", "allow"), (4, T0, "XX", "exit", "deny"), (5, T0, "YY", "entry", "deny"),
    ], "event_id long, ts timestamp_ntz, plate_number string, event_type string, decision string")
    got = {r.trip_ref: r for r in T.progress_trips(ev, trips).collect()}
    assert set(got) == {10, -3}
    assert (got[10].status, got[10].dwell_minutes, got[10].is_auto, got[10].from_status) == ("completed", 48, False, "scheduled")
    assert (got[-3].status, got[-3].is_auto, got[-3].auto_expected_departure) == ("inside_plant", True, T0 + dt.timedelta(hours=4))
    assert {r.event_id: r.dwell_minutes for r in T.exit_dwells(ev, trips).collect()} == {2: 48, 4: 30}
    assert {r.event_id: r.dwell_minutes for r in T.exit_dwells(ev, trips, impute_dwell=False).collect()} == {2: 48, 4: None}


@pytest.mark.parametrize("seed,window,span,slice_s", [(1, 15, 3000, 60), (2, 60, 2000, 121), (3, 7, 300, 14), (4, 15, 90, 30)])
def test_dense_key_equals_greedy(spark, seed, window, span, slice_s):
    """One key holds most rows without a pause, so every slice depends on the one before."""
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        key = "HOT" if rng.random() < 0.7 else f"P{rng.randrange(20)}"
        rows.append((i, T0 + dt.timedelta(milliseconds=rng.randrange(span * 1000)), key, rng.choice(["entry", "exit"])))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, plate_number string, event_type string")
    got = {r.event_id: r.accepted_id for r in dedup_passages(df, window, slice_micros=slice_s * 1_000_000).collect()}
    want, last = {}, {}
    for i, ts, plate, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        at, who = last.get((plate, kind), (None, None))
        if at is None or (ts - at).total_seconds() > window:
            last[plate, kind] = at, who = ts, i
        want[i] = who
    assert got == want


def test_window_is_inclusive_and_unknown_exempt(spark):
    rows = [(1, T0, "AB12", "entry"), (2, T0 + dt.timedelta(seconds=15), "AB12", "entry"), (3, T0 + dt.timedelta(seconds=15, microseconds=1), "AB12", "entry"),
            (4, T0, "UNKNOWN", "entry"), (5, T0, "UNKNOWN", "entry"), (6, T0, "AB12", "exit")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, plate_number string, event_type string")
    assert {r.event_id: r.accepted_id for r in dedup_passages(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_correction(spark):
    preds = spark.createDataFrame([(1, "MH12QX9O31", "manual_review", 0.68)], "prediction_id long, fused_text string, status string, confidence double")
    ev = spark.createDataFrame([(7, 1, "MH12QX9O31", "manual_review", False)], "event_id long, prediction_id long, plate_number string, decision string, is_corrected boolean")
    fix = spark.createDataFrame([(1, " mh12 qx-9031 ", T0)], "prediction_id long, corrected_plate string, corrected_at timestamp_ntz")
    out = M.apply_corrections(preds, ev, fix)
    p, e = out.predictions.first(), out.events.first()
    assert (p.fused_text, p.status, p.confidence) == ("MH12QX9031", "finalized", 0.98)
    assert (e.plate_number, e.decision, e.is_corrected) == ("MH12QX9031", "allow", True)
    assert out.audit.first().details == "Plate corrected from 'MH12QX9O31' to 'MH12QX9031'"


def test_seed_twice(spark):
    old = spark.createDataFrame([("admin", 1)], "name string, rank int")
    new = spark.createDataFrame([("admin", 9), ("guard", 2), ("guard", 3)], "name string, rank int")
    once = M.insert_missing(old, new, "name")
    twice = M.insert_missing(once, new, "name")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("admin", 1), ("guard", 2)]


def test_list_validity(spark):
    from yardstream.operators.register import join_list

    reads = spark.createDataFrame([(1, "A1", T0), (2, "A1", T0 + dt.timedelta(days=9))], "read_id long, plate string, ts timestamp_ntz")
    entries = spark.createDataFrame([("A1", "x", True, T0, T0 + dt.timedelta(days=1))], "plate_number string, reason string, is_active boolean, valid_from timestamp_ntz, valid_until timestamp_ntz")
    assert [r.w_match for r in join_list(reads, entries, "w").orderBy("read_id").collect()] == [True, True]
    assert [r.w_match for r in join_list(reads, entries, "w", valid_at="ts").orderBy("read_id").collect()] == [True, False]


def test_all_tables_round_trip(spark, tmp_path):
    assert len(TABLES) == 24
    for name in ("entry_exit_events", "scheduled_trips", "daily_gate_summary"):
        spark.createDataFrame([], TABLES[name]).write.parquet(f"{tmp_path}/{name}")
        assert read_table(spark, str(tmp_path), name).count() == 0
    assert read_table(spark, str(tmp_path), "entry_exit_events").schema["timestamp"].dataType.simpleString() == "timestamp_ntz"


def test_reads_without_plate_do_not_share_a_join_key(spark):
    from yardstream.operators.register import _scattered

    df = spark.range(100).select(_scattered(F.lit(""), F.col("id")).alias("k"))
    assert df.distinct().count() == 100

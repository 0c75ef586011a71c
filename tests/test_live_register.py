"""The live register against the batch register, trips on a stream, and batches that end early."""

import datetime as dt
import json
import random
from collections import Counter

import pytest

from yardstream.operators import trips as T
from yardstream.plans.register_plan import register_batch
from yardstream.sources.tables import append_register, read_register
from yardstream.streaming.register_stream import live_register, run_register
from yardstream.streaming.running import read_stream, run_to_table
from yardstream.streaming.trip_stream import moved_history, moved_trips, trip_moves
from test_register import masters  # noqa: F401

T0 = dt.datetime(2024, 5, 1, 8, 0, 0)
TRIPS = "trip_id long, plate_number string, status string, actual_entry_time timestamp_ntz"
EVENTS = "event_id long, ts timestamp_ntz, plate_number string, event_type string, decision string"


def bag(df):
    names = sorted(df.columns)
    return Counter(tuple(str(r[n]) for n in names) for r in df.collect())


def slices(spark, rows, schema, path, n):
    """``rows`` in order of time as ``n`` files, one to a micro-batch."""
    rows = sorted(rows, key=lambda r: (r[1] or T0, r[0]))
    cut = -(-len(rows) // n)
    for i in range(0, len(rows), cut):
        spark.createDataFrame(rows[i:i + cut], schema).coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, path, spark.createDataFrame([], schema).schema, max_files=1)


@pytest.mark.parametrize("n", [1, 4])
def test_live_tables_equal_batch_tables(spark, masters, tmp_path, n):  # noqa: F811
    rng = random.Random(n)
    plates = ["TN37AB1234", "GJ18BR2290", "KA01ZZ0001", "MH12QX9O31", "", None]
    rows = []
    for i in range(400):
        frames = [{"frame_number": f, "text": "X", "confidence": 0.5} for f in range(rng.randrange(3))]
        body = {"plate_number": rng.choice(plates), "final_confidence": rng.choice([0.6, 0.92]), "gate_id": "Gate 01",
                "camera_id": rng.choice(["G01-ENTRY", "G03-EXIT"]), "frame_predictions": frames}
        rows.append((i, T0 + dt.timedelta(seconds=rng.randrange(2400)), json.dumps(body)))
    schema = "read_id long, ts timestamp_ntz, payload string"
    trips = spark.createDataFrame([(10, "TN37AB1234", "scheduled", None), (11, "TN37AB1234", "inside_plant", T0 - dt.timedelta(minutes=7)), (12, "KA01ZZ0001", "arrived", None),
                                   (13, "KA01ZZ0001", "completed", None), (14, "XX00", "scheduled", None)], TRIPS)
    want = register_batch(spark.createDataFrame(rows, schema), *masters, trips=trips)
    root = run_register(slices(spark, rows, schema, f"{tmp_path}/in", n), *masters, trips=trips)
    got = dict(live_register(spark, root).items())
    for name, df in want.items():
        assert bag(got[name]) == bag(df), name
    assert got["trips"].filter("is_auto").count() > 0 and got["events"].filter("dwell_minutes is not null").count() > 0


@pytest.mark.parametrize("impute", [True, False])
def test_moves_equal_batch_trips(spark, tmp_path, impute):
    rng = random.Random(5)
    rows = [(i, T0 + dt.timedelta(seconds=rng.randrange(900) * 30), rng.choice(["A", "B", "C", "UNKNOWN", "", None]), rng.choice(["entry", "exit"]), rng.choice(["allow", "deny"])) for i in range(300)]
    trips = spark.createDataFrame([(t, p, "arrived", e) for t, (p, e) in enumerate([("A", None), ("A", T0), ("B", T0), ("A", None), ("UNKNOWN", T0)])], TRIPS)
    events = spark.createDataFrame(rows, EVENTS)
    moves = run_to_table(trip_moves(slices(spark, rows, EVENTS, f"{tmp_path}/in", 5), trips, impute_dwell=impute), "moves")
    assert moves.count() == len(rows)
    assert bag(moved_trips(moves)) == bag(T.progress_trips(events, trips, impute))
    assert bag(moved_history(moves)) == bag(T.trip_history(events, trips))
    dwells = T.exit_dwells(events, trips, impute).select("event_id", "dwell_minutes", "trip_ref")
    assert bag(moves.filter("event_type = 'exit' and plate_number not in ('', 'UNKNOWN')").select("event_id", "dwell_minutes", "trip_ref")) == bag(dwells)


def test_events_without_time_move_nothing(spark, tmp_path):
    rows = [(1, None, "A", "entry", "allow"), (2, T0, "A", "exit", "allow"), (3, None, "A", "exit", "allow")]
    moves = run_to_table(trip_moves(slices(spark, rows, EVENTS, f"{tmp_path}/in", 1), spark.createDataFrame([], TRIPS), 15), "moves")
    assert {r.event_id: (r.accepted_id, r.trip_ref, r.dwell_minutes) for r in moves.collect()}[2] == (2, None, 30)
    assert moves.filter("trip_ref is not null").count() == 0


def test_batch_that_ends_between_two_tables_is_not_seen(spark, tmp_path):
    root, one = str(tmp_path), spark.range(3).toDF("id")

    class Broken:
        def __getattr__(self, name):
            raise RuntimeError("lost")

    append_register({"a": one, "b": one}, root, 0)
    with pytest.raises(RuntimeError):
        append_register({"a": one, "b": Broken()}, root, 1)
    assert [read_register(spark, root, t).count() for t in "ab"] == [3, 3]
    assert append_register({"a": one, "b": one}, root, 1)
    assert not append_register({"a": one, "b": one}, root, 1)
    assert [read_register(spark, root, t).count() for t in "ab"] == [6, 6]
    assert read_register(spark, root, "a", batches=True).select("batch").distinct().count() == 2
    # two attempts at one batch at the same time: both are published, one counts
    append_register({"a": one, "b": one}, root, 2)
    spark.createDataFrame([("2", "try-2-zzzz")], "batch string, attempt string").write.mode("append").parquet(f"{root}/commits")
    one.write.parquet(f"{root}/a/attempt=try-2-zzzz")
    assert read_register(spark, root, "a").count() == 9


def test_late_rows_are_counted(spark, tmp_path):
    from yardstream.streaming.passages import dedup_stream
    from yardstream.streaming.running import run_counted

    path, hours = str(tmp_path / "in"), lambda h: T0 + dt.timedelta(hours=h)
    for rows in ([(1, hours(0), "A"), (2, hours(5), "B")], [(3, hours(6), "A")], [(4, hours(1), "A"), (5, hours(7), "A"), (6, hours(2), "C")]):
        spark.createDataFrame([(*r, "entry", "allow") for r in rows], EVENTS).coalesce(1).write.mode("append").parquet(path)
    stream = read_stream(spark, path, spark.createDataFrame([], EVENTS).schema, max_files=1)
    out, late = run_counted(dedup_stream(stream, 15), "late")
    assert (sorted(r.event_id for r in out.collect()), late) == ([1, 2, 3, 5], 2)
    again, none = run_counted(dedup_stream(read_stream(spark, path, stream.schema), 15), "on-time")
    assert (again.count(), none) == (6, 0)

"""Cases in which rows or evidence could get lost: null keys, long tracks, crowded frames, colliding keys."""

import pytest
from pyspark.sql import functions as F

from yardstream.functions import windows as W
from yardstream.operators import boxes, fusion, recognition, register, tracking
from yardstream.sources import tables

ROWS = [("a", 1, 5), ("a", None, 7), (None, 1, 2), (None, 3, 4), (None, None, 1), ("a", 2, 1)]


@pytest.fixture
def keyed(spark):
    return spark.createDataFrame(ROWS, "k string, t long, v long")


def test_running_sum_keeps_null_keys_and_orders(keyed):
    got = {(r.k, r.t): r.s for r in W.running_sum(keyed, ["k"], ["t"], F.col("v"), F.floor(F.col("t") / 2), "s").collect()}
    assert got == {("a", None): 7, ("a", 1): 12, ("a", 2): 13, (None, None): 1, (None, 1): 3, (None, 3): 7}


def test_neighbours_keep_null_keys_and_orders(keyed):
    got = {(r.k, r.t): r.p for r in W.previous_value(keyed, ["k"], "t", F.floor(F.col("t") / 2), "p").collect()}
    assert got == {("a", None): None, ("a", 1): None, ("a", 2): 1, (None, None): None, (None, 1): None, (None, 3): 1}
    got = {(r.k, r.t): r.n and r.n.v for r in W.neighbour_row(keyed, ["k"], ["t"], F.floor(F.col("t") / 2), ["v"], "n", 1).collect()}
    assert got == {("a", None): 5, ("a", 1): 1, ("a", 2): None, (None, None): 2, (None, 1): 4, (None, 3): None}


def test_spells_keep_null_keys_and_orders(keyed):
    assert W.busy_spells(keyed, ["k"], "t", 1, 2, "s").count() == len(ROWS)


def test_reading_budget_counts_unknown_texts_as_nothing(spark):
    rows = [(1, i, i * 500, None if i == 0 else i == 10, i == 10) for i in range(0, 40, 2)] + [(None, 0, 0, True, True), (None, 3, 900, True, True)]
    df = spark.createDataFrame(rows, "track_id long, frame_number long, t_ms long, has_text boolean, confirms boolean")
    got = {}
    for r in tracking.reading_budget(df).collect():
        got.setdefault(r.track_id, {})[r.frame_number] = r.run_ocr
    assert [f for f, run in sorted(got[1].items()) if run] == [0, 2, 4, 6] and len(got[1]) == 20
    assert got[None] == {0: True, 3: False}


@pytest.mark.parametrize("head", [1, 2, 256])
def test_suppression_is_the_same_for_every_head(spark, head):
    rows = [(1, i, i * 3.0, 0.0, i * 3.0 + 10, 10.0, None if i % 7 == 3 else round((i * 37 % 50) / 50, 2)) for i in range(60)]
    rows += [(None, 100 + i, i * 100.0, 0.0, i * 100.0 + 10, 10.0, 0.5) for i in range(5)]
    df = spark.createDataFrame(rows, "frame_id long, box_id long, x1 double, y1 double, x2 double, y2 double, confidence double")
    kept, want = [], []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[6] is None, -(r[6] or 0), r[1])):
        area = lambda b: (b[4] - b[2]) * (b[5] - b[3])
        inter = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        if not any(k[0] == r[0] and ((i := inter(k, r)) / (area(k) + area(r) - i) >= 0.35 or i / min(area(k), area(r)) >= 0.5) for k in kept):
            kept.append(r)
            want.append(r[1])
    assert sorted(r.box_id for r in boxes.suppress_boxes(df, head=head).collect()) == sorted(want)


def _reads(n_good, n_bad, late):
    good = [(1, i, "MH12AB1234", 0.9, 0.9, "car") for i in range(n_good)]
    bad = [(1, 1000 + i, "??", 0.1, 0.1, late) for i in range(n_bad)]
    return [*good, *bad]


FIELDS = "track_id long, frame_number int, raw_text string, ocr_confidence double, plate_confidence double, vehicle_class string"


def test_class_is_taken_from_all_reads(spark):
    r = fusion.fuse_tracks(spark.createDataFrame(_reads(30, 1, "truck"), FIELDS)).first()
    assert (r.plate_number, r.vehicle_type, r.frame_count) == ("MH12AB1234", "truck", 30)
    r = fusion.fuse_tracks(spark.createDataFrame(_reads(100, 40, "vehicle"), FIELDS)).first()
    assert (r.plate_number, r.vehicle_type, r.frame_count) == ("MH12AB1234", "car", 30)


def test_stream_keeps_usable_reads(spark):
    from yardstream.streaming.observations import fuse_stream
    from yardstream.streaming.running import read_stream

    timed = lambda df: df.withColumn("ts", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("frame_number") * F.lit(0.01))).cast("timestamp_ntz"))
    rows = timed(spark.createDataFrame(_reads(3, 30, "truck") + [(2, 60_000, "KA01AB1234", 0.9, 0.9, "bus")], FIELDS))
    path = tables.scratch_dir(spark, "reads")
    rows.repartition(2).write.parquet(path)
    got = {r.track_id: r for r in fuse_stream(read_stream(spark, path, rows.schema), min_observations=3).collect()}
    assert (got[1].plate_number, got[1].status, got[1].vehicle_type) == ("MH12AB1234", "finalized", "truck")


def test_lookups_give_one_row_per_read(spark):
    reads = spark.createDataFrame([(1, "AB12CD3456"), (2, "zz"), (3, None)], "read_id long, plate string")
    master = spark.createDataFrame(
        [(7, "AB 12 CD-3456", "Car", "second", "T2", True), (5, "AB12CD3456", "Bus", "first", "T1", False)],
        "vehicle_id long, plate_number string, vehicle_type string, owner_name string, transporter string, is_authorized boolean")
    got = {r.read_id: (r.vehicle_id, r.owner_name, r.transporter) for r in register.join_registry(reads, master).collect()}
    assert got == {1: (5, "first", "T1"), 2: (None, None, "Unregistered"), 3: (None, None, "Unregistered")}
    assert register.join_registry(reads, master).count() == 3
    entries = spark.sql("""select * from values ('AB12CD3456', 'old', timestamp_ntz'2020-01-01', timestamp_ntz'2021-01-01', true), ('AB-12-CD-3456', 'new', timestamp_ntz'2023-01-01', null, true),
      ('AB12CD3456', 'off', null, null, false) as t(plate_number, reason, valid_from, valid_until, is_active)""")
    timed = reads.withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {r.read_id: r.white_reason for r in register.join_list(timed, entries, "white", valid_at="at").collect()} == {1: "new", 2: None, 3: None}
    assert {r.read_id: r.white_reason for r in register.join_list(timed, entries, "white").collect()} == {1: "old", 2: None, 3: None}


def test_folded_plates_collide_without_multiplying(spark):
    known = spark.createDataFrame([(2, "KA01AB0001"), (1, "KAO1AB0001")], "vehicle_id long, plate_number string")
    reads = spark.createDataFrame([(1, "KA01ABOOO1"), (2, "XX"), (3, None)], "read_id long, text string")
    got = {r.read_id: (r.final_plate, r.is_known) for r in recognition.match_known_plates(reads, known, "text", "vehicle_id").collect()}
    assert got[1] == ("KAO1AB0001", True) and len(got) == 3 and not got[2][1]


def test_local_scratch_only_on_a_local_master():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        tables.scratch_dir(Session(), "x")

"""Track fusion on literal cases."""

import pytest
from pyspark.sql import functions as F

from yardstream.operators import fusion as X
from yardstream.operators import quality as Q

SCHEMA = "track_id long, frame_number int, raw_text string, ocr_confidence double, plate_confidence double, vehicle_class string"


def fuse(spark, reads, force=False, **kw):
    rows = [(t, i + 1, text, conf, 0.85, "car") for t, items in reads.items() for i, (text, conf) in enumerate(items)]
    limits = dict(window_size=10, min_observations=3, min_confidence=0.60, min_agreement=0.60)
    df = X.fuse_tracks(spark.createDataFrame(rows, SCHEMA), **limits, force=force, **kw)
    return {r.track_id: r for r in df.collect()}


def test_weighted(spark):
    r = fuse(spark, {1: [("WB12AB1234", 0.78), ("WB12AB1234", 0.91), ("WB12A81234", 0.66), ("WB12AB1234", 0.94)]})[1]
    assert (r.status, r.plate_number, r.frame_count, r.evidence_count) == ("finalized", "WB12AB1234", 4, 4)
    assert r.final_confidence >= 0.80
    assert [p.frame for p in r.supporting_predictions] == [1, 2, 3, 4]


def test_tracks_do_not_mix(spark):
    got = fuse(spark, {1: [("WB12AB1234", c) for c in (0.78, 0.91, 0.94)], 2: [("TN38AB1234", c) for c in (0.88, 0.92, 0.95)]})
    assert [(got[t].plate_number, got[t].evidence_count) for t in (1, 2)] == [("WB12AB1234", 3), ("TN38AB1234", 3)]


def test_single_weak_read(spark):
    reads = {1: [("WB12AB1234", 0.55)]}
    assert fuse(spark, reads)[1].status == "finalized"
    assert fuse(spark, reads, strict_evidence=True)[1].status == "pending"


def test_conflict_needs_review(spark):
    reads = {1: [("TN38AB1234", 0.62), ("MH12XY9999", 0.61), ("KA05ZZ1111", 0.60), ("DL01AA0000", 0.58), ("GJ18BB2222", 0.59)]}
    r = fuse(spark, reads, force=True)[1]
    assert (r.status, r.plate_number, r.display_plate) == ("manual_review", "", "Requires Manual Review")
    assert len(r.all_candidates) == 5


def test_hundred_reads(spark):
    reads = {1: [("WB12A81234" if n == 50 else "WB12AB1234", 0.90 if n % 2 == 0 else 0.80) for n in range(1, 101)]}
    r = fuse(spark, reads)[1]
    assert (r.plate_number, r.frame_count) == ("WB12AB1234", 30)


def test_track_without_usable_read(spark):
    r = fuse(spark, {1: [("", 0.9), ("A1", 0.9)]}, force=True)[1]
    assert (r.status, r.frame_count, r.final_confidence, r.supporting_predictions) == ("pending", 0, 0.0, [])


@pytest.fixture(scope="module")
def truth():
    # fixed values: the eight published cases
    return [
        ("WB12AB1234", "Day", ["WB12AB1234", "WB12AB1234", "WB12A81234", "WB12AB1234"], [0.78, 0.91, 0.66, 0.94]),
        ("TN37AB1234", "Day", ["TN37AB1234", "TN37AB1234", "TN37A81234"], [0.95, 0.98, 0.70]),
        ("KA05MZ5678", "Day", ["KA05MZ5678", "KA05MZ5678", "KAO5MZ5678"], [0.92, 0.94, 0.72]),
        ("AP09TC4412", "Night", ["AP09TC4412", "AP09TC4412", "APO9TC4412"], [0.85, 0.89, 0.60]),
        ("MH12QX9031", "Night", ["MH12QX9031", "MH12QX9O31", "MH12QX9031"], [0.88, 0.65, 0.91]),
        ("TS08HN1922", "Day", ["TS08HN1922", "T508HN1922", "TS08HN1922"], [0.93, 0.68, 0.97]),
        ("DL01LK8402", "Day", ["DL01LK8402", "DLO1LK8402", "DL01LK8402"], [0.91, 0.74, 0.96]),
        ("GJ18BR2290", "Night", ["GJ18BR2290", "GJ18BR2290", "G1188R2290"], [0.82, 0.89, 0.58]),
    ]


def test_published_cases_are_all_exact(spark, truth):
    rows = [(n, f, p, c, 0.90, "car") for n, (_, _, ps, cs) in enumerate(truth) for f, (p, c) in enumerate(zip(ps, cs))]
    fused = X.fuse_tracks(spark.createDataFrame(rows, SCHEMA))
    known = spark.createDataFrame([(n, t, cond) for n, (t, cond, _, _) in enumerate(truth)], "track_id long, truth string, condition string")
    result = fused.join(known, "track_id").select("truth", "condition", F.col("display_plate").alias("plate"), F.col("final_confidence").alias("confidence"))
    row = Q.recognition_quality(result).first()
    assert (row.samples, row.char_accuracy, row.exact_accuracy, row.day_accuracy, row.night_accuracy) == (8, 100.0, 100.0, 100.0, 100.0)


def test_vote_forms_agree(spark, small):
    """The grouped vote and the array vote give the same texts."""
    from yardstream.functions.plate_rules import plate_clean
    from yardstream.sources import derived as D

    f = D.frames(spark, small).withColumn("plate", plate_clean(F.col("raw_text")))
    spelled = f.groupBy("track_id", "plate").agg(F.count("*").alias("n"), F.sum("ocr_confidence").alias("weight"), F.min("frame_number").alias("seen"))
    grouped = {r.track_id: r.voted for r in X.vote_positions(spelled, ["track_id"]).collect()}
    arrays = spelled.groupBy("track_id").agg(F.collect_list(F.struct("plate", "n", "weight", "seen")).alias("s")).select("track_id", X._vote(F.col("s")).alias("voted"))
    assert grouped == {r.track_id: r.voted for r in arrays.collect() if r.voted is not None}


def test_reads_are_shuffled_once(spark):
    rows = [(n % 3, n, "MH12AB1234", 0.9, 0.9, "car") for n in range(9)]
    df = spark.createDataFrame(rows, "track_id long, frame_number int, raw_text string, ocr_confidence double, plate_confidence double, vehicle_class string")
    plan = X.fuse_tracks(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4  # reads, classes, and both where the results meet


def test_without_detail_the_rest_is_the_same(spark):
    rows = [(t, f, p, c, 0.8, k) for t in (1, 2, None) for f, (p, c, k) in enumerate([("MH12AB1234", 0.9, "car"), ("MH12A81234", 0.7, "bus"), ("KA05ZZ1111", 0.6, ""), ("x", 0.5, "truck"), ("MH12AB1234", None, None)])]
    rows += [(4, 1, "x", 0.9, 0.9, "bus"), (4, 2, None, None, None, None)]
    df = spark.createDataFrame(rows, "track_id long, frame_number int, raw_text string, ocr_confidence double, plate_confidence double, vehicle_class string")
    whole, short = X.fuse_tracks(df), X.fuse_tracks(df, detail=False)
    assert [c for c in whole.columns if c not in short.columns] == ["supporting_predictions", "frame_predictions"]
    assert sorted(map(str, whole.select(*short.columns).collect())) == sorted(map(str, short.collect()))
    got = {r.track_id: r for r in whole.collect()}
    assert sorted(got, key=str) == [1, 2, 4, None]
    assert (got[None].frame_count, got[None].vehicle_type, len(got[None].frame_predictions)) == (4, "truck", 4)
    assert (got[4].frame_count, got[4].status, got[4].vehicle_type, got[4].supporting_predictions, got[4].all_candidates) == (0, "pending", "bus", [], [])


def test_clip_groups(spark):
    rows = [(1, 1, "MH12AB1234", 0.6, "car"), (1, 2, "MH12AB1Z34", 0.9, "truck"), (1, 3, None, 0.3, "truck"), (1, 4, "KA05ZZ1111", 0.7, "car"), (1, 5, "MH12AB1234", 0.8, None),
            (2, 1, None, 0.3, None)]
    df = spark.createDataFrame(rows, "clip_id long, frame_number int, text string, quality double, vehicle_class string")
    got = {r.clip_id: r for r in X.fuse_clips(df).collect()}
    assert (got[1].plate, got[1].confidence, got[1].frame_agreement, got[1].vehicle_type) == ("MH12AB1234", round(2.3 / 3, 6), 0.6, "car")
    assert got[1].is_certain
    assert (got[2].plate, got[2].confidence, got[2].is_certain) == ("PLATE_UNCERTAIN", 0.0, False)


def test_vote_needs_no_shuffle_of_its_own(spark, small):
    """char_vote reads the lineitems once, and shuffles them by vehicle and by track only."""
    from yardstream.bindings.fusion import QUERIES

    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set(key, "-1")
        plan = QUERIES["char_vote"](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("lineitem.parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 6  # lineitems and orders twice, vehicles for each


def test_vote_takes_the_most_common_length(spark):
    rows = [(1, "MH12AB1234", 1, 0.9, 1), (1, "MH12A81234", 1, 0.5, 2), (1, "INDMH12AB1234", 1, 0.9, 3), (2, "KA05ZZ11", 1, 0.9, 1), (2, "KA05ZZ1111", 1, 0.9, 2),
            (3, "AB12", 9, 0.9, 1), (3, None, 9, 0.9, 2), (3, "DL01AA00", 1, 0.1, 3), (4, "AB12", 2, 0.9, 1), (None, "MH12AB1234", 1, 0.2, 1), (None, "MH12JB1234", 1, 0.2, 2)]
    df = spark.createDataFrame(rows, "track_id long, plate string, n long, weight double, seen int")
    got = {r.track_id: r.voted for r in X.vote_positions(df, ["track_id"]).collect()}
    assert got == {1: "MH12AB1234", 2: "KA05ZZ11", 3: "DL01AA00", None: "MH12AB1234"}

"""Plate rules and distances on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from yardstream.functions import distance as X
from yardstream.functions import plate_rules as P


def normalized(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return [r.plate for r in P.normalize_plates(df, "text", "plate", **kw).orderBy("id").collect()]


def validated(spark, texts, profile, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return P.validate_plates(df, "text", "v", profile, **kw).orderBy("id").collect()


def test_normalize(spark):
    cases = {"wb 12 ab 1234": "WB12AB1234", "INDTN38AB1234": "TN38AB1234", "TN-38-AB-1234": "TN38AB1234", "tn 38 ab 1234": "TN38AB1234",
             "": "", "abc": "", "DL01ABC1234": "DL01ABC123"}
    assert normalized(spark, list(cases)) == list(cases.values())


def test_repaired_rules_keep_long_and_bharat_plates(spark):
    assert normalized(spark, ["DL01ABC1234"], faithful=False) == ["DL01ABC1234"]
    row = validated(spark, ["22BH1234A"], "fusion", faithful=False)[0]
    assert (row.v_plate, row.v_valid) == ("22BH1234A", True)
    assert validated(spark, ["22BH1234A"], "fusion")[0].v_plate != "22BH1234A"


@pytest.mark.parametrize("text,plate,conf", [
    ("WB12AB1234", "WB12AB1234", 0.98), ("W812A81234", "WB12AB1234", 0.98), ("TS09BS1234", "TS09JS1234", 0.98),
    ("MH02D1365", "MH02D1365", 0.96), ("XX12AB1234", "XX12AB1234", 0.88), ("ARI2AB1234", "AR12AB1234", 0.98), ("AR011234", "AP011234", 0.92),
])
def test_validate_fusion(spark, text, plate, conf):
    row = validated(spark, [text], "fusion")[0]
    assert (row.v_plate, row.v_conf, row.v_valid) == (plate, conf, True)


def test_validate_browser(spark):
    rows = validated(spark, ["TN38AB1234", "22BH1234A", "TN38AB12B4", "T538AB1234", "??", "ABCD"], "browser")
    got = [(r.v_pattern, r.v_plate, r.v_status, r.v_corrections) for r in rows]
    assert got[0] == ("STANDARD_STRICT", "TN38AB1234", "VALID", 0)
    assert got[1] == ("BHARAT_SERIES_STRICT", "22BH1234A", "VALID", 0)
    assert got[2] == ("STANDARD_POSITION_CORRECTED", "TN38AB1284", "VALID", 1)
    assert got[3][1:] == ("TS38AB1234", "VALID", 1)
    assert got[4] == (None, "", "LOW_CONFIDENCE", None)
    assert got[5][2] == "INVALID"


def weighted(a, b):
    """Plain recursive form of the weighted distance."""
    pairs = {frozenset(p) for p in X.CONFUSION_PAIRS}
    best = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = [best[i, j]] if (i, j) == (0, 0) else []
            if i:
                options.append(best[i - 1, j] + 1)
            if j:
                options.append(best[i, j - 1] + 1)
            if i and j:
                same = 0 if a[i - 1] == b[j - 1] else 0.15 if frozenset((a[i - 1], b[j - 1])) in pairs else 1
                options.append(best[i - 1, j - 1] + same)
            best[i, j] = min(options)
    return best[len(a), len(b)]


def test_distances(spark):
    rng = random.Random(5)
    pairs = [("WB12AB1234", "WB12A81234"), ("DL01AB1234", "DLO1AB1234"), ("", "AB"), ("AB", "AB"), ("J", "8")]
    for _ in range(400):
        a = "".join(rng.choice("AB8O0JI1T7Z2S5") for _ in range(rng.randint(1, 11)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = rng.choice("AB8O0JI1T7Z2S5")
        pairs.append((a, "".join(b)[: rng.randint(1, 11)]))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.withColumn("d", X.confusion_distance(F.col("a"), F.col("b"))).withColumn("back", X.confusion_distance(F.col("b"), F.col("a")))
    df = df.withColumn("sim", X.similarity_from_distance(F.col("a"), F.col("b"), F.col("d")))
    df = df.withColumn("unit", X.unit_distance(F.col("a"), F.col("b"))).withColumn("same", X.same_plate(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r.d == pytest.approx(weighted(r.a, r.b)) == pytest.approx(r.back)
        assert r.d <= r.unit + 1e-9
        if r.a and r.b:
            assert r.same == (r.sim >= 0.75 or r.d <= 1.5 + 1e-9), (r.a, r.b)
    first, second = df.limit(2).collect()
    assert first.d < 0.5 and first.sim >= 0.90 and second.sim >= 0.90

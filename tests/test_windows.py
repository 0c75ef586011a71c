"""Sliced windows equal plain ones; exact percentiles equal numpy."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from yardstream.functions import windows as W
from yardstream.operators.quality import exact_percentiles


def data(spark, n=600):
    rng = random.Random(2)
    rows = [(("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}"), rng.randrange(4000), i, rng.randrange(-3, 4)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, id long, v long")


def test_running_sum(spark):
    df = data(spark)
    got = W.running_sum(df, ["k"], ["t", "id"], F.col("v"), F.floor(F.col("t") / 100), "total")
    plain = df.withColumn("total", F.sum("v").over(Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(tuple, got.select("id", "total").collect())) == sorted(map(tuple, plain.select("id", "total").collect()))


def test_neighbours(spark):
    df = data(spark)
    got = W.neighbour_row(df, ["k"], ["t", "id"], F.floor(F.col("t") / 100), ["id"], "before", -1)
    got = W.neighbour_row(got, ["k"], ["t", "id"], F.floor(F.col("t") / 100), ["id"], "after", 1)
    w = Window.partitionBy("k").orderBy("t", "id")
    plain = df.select("id", F.lag("id").over(w), F.lead("id").over(w))
    assert sorted(map(tuple, got.select("id", "before.id", "after.id").collect())) == sorted(map(tuple, plain.collect()))


def test_spells(spark):
    df = data(spark)
    got = {r.id: r.s for r in W.busy_spells(df, ["k"], "t", 20, 100, "s").collect()}
    rows = sorted(df.collect(), key=lambda r: (r.k, r.t))
    want, key, last, start = {}, None, None, None
    for r in rows:
        if r.k != key or r.t - last > 20:
            start = r.t
        key, last = r.k, r.t
        want[r.id] = start
    assert got == want


def test_percentiles(spark):
    rng = random.Random(4)
    rows = [("a", round(rng.expovariate(0.1), 2)) for _ in range(777)] + [("b", float(rng.randrange(3))) for _ in range(50)] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.share): r.result for r in exact_percentiles(df, ["k"], "v", (0.0, 0.5, 0.95, 0.99, 1.0), slices=8).collect()}
    assert len(got) == 15
    for (k, p), value in got.items():
        assert abs(value - np.percentile([v for key, v in rows if key == k], p * 100)) < 1e-9

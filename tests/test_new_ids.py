"""Ids without gaps, in batch order."""

import random

import pytest

from yardstream.operators.master import with_new_ids


@pytest.mark.parametrize("parts,n", [("1", 50), ("7", 5000), ("8", 0)])
def test_ids_are_gapless_and_in_order(spark, parts, n):
    rng = random.Random(n)
    keys = rng.sample(range(10**9), n)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.createDataFrame([(k, str(k)) for k in keys], "key long, name string")
        got = with_new_ids(rows, spark.createDataFrame([(3,), (41,), (None,)], "id long"), "id", ["key"])
        assert got.columns == ["key", "name", "id"]
        assert [r.key for r in got.orderBy("id").collect()] == sorted(keys)
        assert sorted(r.id for r in got.collect()) == list(range(42, 42 + n))
        first = with_new_ids(rows, spark.createDataFrame([], "id long"), "id", ["key"])
        assert sorted(r.id for r in first.collect()) == list(range(1, 1 + n))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)

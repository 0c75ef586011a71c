import __spark_entry__ as E


def test_shuffles_of_queries_are_cut_by_size(spark):
    """Two shuffle partitions in the session, and still no task takes half of a table."""
    new = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        assert E.queries()["detection_consensus"](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_share_of_a_task_is_bounded(spark):
    """16 MB of a shuffle and 8 MB of a file at most; a smaller bound of the session stays."""
    from yardstream.session import TASK_BYTES, fine_shuffles

    before = {k: spark.conf.get(k) for k in (*TASK_BYTES, "spark.sql.codegen.hugeMethodLimit")}
    try:
        for given, want in (("64MB", TASK_BYTES.values()), ("32k", [32 << 10, 32 << 10])):
            for k in TASK_BYTES:
                spark.conf.set(k, given)
            fine_shuffles(spark)
            assert [int(spark.conf.get(k)[:-1]) for k in TASK_BYTES] == list(want)
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

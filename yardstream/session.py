"""Spark session settings shared by tests, benchmark and applications."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

#: Partitions a shuffle starts with.  AQE joins small ones up to its advisory size, but splits none of an
#: aggregation or window: with few of them a task's share, and its memory, grows with the input.
SHUFFLE_START = 2000
#: Bytes of a shuffle that AQE gives to one task, and of a file that one task reads: a task holds some ten to twenty times as much.
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20, "spark.sql.files.maxPartitionBytes": 8 << 20}
#: The JVM never compiles a method of more bytecode than this; Spark then runs the step in smaller methods.
METHOD_LIMIT = 8000


def fine_shuffles(spark: SparkSession) -> None:
    """Let shuffles start with many partitions that AQE joins by size; a larger number of the session stays.

    The share of a task is bounded whatever the input (a smaller bound of the
    session stays), and no step is one method too large for the JVM's compiler.
    """
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    given = max(int(spark.conf.get(k, None) or 0) for k in (key, "spark.sql.shuffle.partitions"))
    spark.conf.set(key, str(max(SHUFFLE_START, given)))
    for name, most in TASK_BYTES.items():
        now = re.fullmatch(r"(\d+)([kmg]?)b?", (spark.conf.get(name, None) or "").lower())
        spark.conf.set(name, f"{min(most, int(now[1]) << ' kmg'.index(now[2] or ' ') * 10) if now else most}b")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_LIMIT))


def build_session(app_name: str = "yardstream", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    Nothing here fixes the cluster size: partition counts come from AQE, which
    coalesces small shuffles and splits skewed ones.  ``master`` is only given
    by tests and the benchmark.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": os.environ.get("YARDSTREAM_UI", "false"),
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

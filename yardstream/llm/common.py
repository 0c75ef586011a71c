"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder of the cluster (``spark.checkpoint.dir``).

    Only a session that names none gets a folder of its own; outside a local
    master that is an error, because executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "spark-" + uuid.uuid4().hex)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, computes once."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def ended_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a step go when it ends, not when the driver next collects its garbage; for steps that are written and read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield batch.slice(low, high - low)


def map_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with Arrow batches of BATCH_BYTES at most, so that long texts don't pile up in a worker.

    The bound is a setting of the session and stays; a smaller one is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name)
    if int(re.sub(r"\D", "", now)) > BATCH_BYTES or not re.fullmatch(r"\d+b?", now):
        df.sparkSession.conf.set(name, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def own_prefix(columns: list[str]) -> str:
    """Underscores that no name in ``columns`` begins with: names made of it clash with none of them."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in columns), default=0))


def crc_mod(key: str, n: int) -> Column:
    """crc32 of a key written as text, modulo ``n`` (null keys: null)."""
    return F.crc32(F.col(key).cast("string")) % n


def arrow_schema(schema: str | StructType) -> pa.Schema:
    """The Arrow schema of a DDL string or a StructType (on the driver)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


#: Bits of a membership filter; as rows of 64 it stays below 2**18 rows whatever the input.
FILTER_BITS = 1 << 24


def _word_and_bit(columns: list[str]) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    return F.shiftright(place, 6), place % 64


def membership(keys: DataFrame, columns: list[str]) -> DataFrame:
    """A filter over the keys in ``columns``: rows (word, 64 bits), FILTER_BITS / 64 of them at most."""
    word, bit = _word_and_bit(columns)
    return keys.select(word.alias("filter_word"), bit.alias("filter_bit")).groupBy("filter_word").agg(F.bit_or(F.expr("shiftleft(1L, cast(filter_bit as int))")).alias("filter_bits"))


def with_membership(df: DataFrame, columns: list[str], words: DataFrame, flag: str) -> DataFrame:
    """``df`` with ``flag``: false where no key of the filter equals the row's, true for every equal one and a few others.

    A broadcast of bounded size in place of a shuffle: where the filter fills up
    (very many keys), more rows are flagged, and none is lost.
    """
    word, bit = _word_and_bit(columns)
    hit = F.coalesce(F.expr("getbit(filter_bits, cast(filter_bit as int))") == 1, F.lit(False))
    rows = df.withColumns({"own_word": word, "filter_bit": bit}).join(F.broadcast(words), F.col("own_word") == F.col("filter_word"), "left")
    return rows.withColumn(flag, hit).drop("own_word", "filter_bit", "filter_word", "filter_bits")

"""Ordered computations that stay parallel inside one hot key.

A window over ``partitionBy(key)`` sends a key to one task.  The two helpers
here work on (key, bucket) instead - the bucket being a slice of the ordering
column - and carry the little that crosses bucket borders through a summary
with one row per (key, bucket).  Null keys are keys like others and null order
values have a bucket of their own: no row is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same names in which null meets null; ``right`` keeps only its other columns."""
    right = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(right, condition, how).drop(*[f"_on_{c}" for c in on])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def micros(ts: Column) -> Column:
    """Microseconds of a zone-less or zoned timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def time_bucket(ts: Column, width_micros: int = DAY_MICROS) -> Column:
    return F.floor(micros(ts) / F.lit(width_micros)).cast("long")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, bucket: Column, out: str
) -> DataFrame:
    """Add ``out``: the inclusive running sum of ``value`` per key in ``order``.

    ``bucket`` must be non-decreasing along ``order``.
    """
    b, v = f"_{out}_bucket", f"_{out}_value"
    df = df.withColumn(b, bucket).withColumn(v, value)
    inner = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offset = (
        df.groupBy(*keys, b)
        .agg(F.sum(v).alias("_total"))
        .select(*keys, b, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        meet(df.withColumn(out, F.sum(v).over(inner)), offset, [*keys, b])
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop(b, v, "_offset")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, out: str
) -> DataFrame:
    """Add ``out``: the preceding value of the ordering column ``order`` per key."""
    b = f"_{out}_bucket"
    df = df.withColumn(b, bucket)
    inner = Window.partitionBy(*keys, b).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(b)
    carried = (
        df.groupBy(*keys, b)
        .agg(F.max(order).alias("_last"))
        .select(*keys, b, F.lag("_last").over(across).alias("_carried"))
    )
    return (
        meet(df.withColumn(out, F.lag(order).over(inner)), carried, [*keys, b])
        .withColumn(out, F.coalesce(F.col(out), F.col("_carried")))
        .drop(b, "_carried")
    )


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition by ``keys`` into the session's shuffle partitions, not coalesced by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sorted_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], scan, schema: str) -> DataFrame:
    """Run ``scan`` over rows hash-partitioned by ``keys`` and sorted within them.

    ``scan`` receives the Arrow batches of a partition as pandas frames.  It
    keeps only its own small state between batches: no group is ever held whole,
    and the sort is Spark's external sort.  The partition count is given
    explicitly because these stages are bound by work per row, not by bytes.
    """
    return spread(df, keys).sortWithinPartitions(*keys, *order).mapInPandas(scan, schema)


def neighbour_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, columns: Sequence[str], out: str, step: int = -1
) -> DataFrame:
    """Add struct ``out`` with ``columns`` of the preceding (``step=-1``) or following row per key.

    ``bucket`` must be non-decreasing along ``order``.
    """
    b = f"_{out}_bucket"
    row, rank = F.struct(*columns), F.struct(*order)
    shift = F.lag if step < 0 else F.lead
    edge = F.max_by(row, rank) if step < 0 else F.min_by(row, rank)
    df = df.withColumn(b, bucket)
    carried = (
        df.groupBy(*keys, b)
        .agg(edge.alias("_edge"))
        .select(*keys, b, shift("_edge").over(Window.partitionBy(*keys).orderBy(b)).alias("_carried"))
    )
    return (
        meet(df.withColumn(out, shift(row).over(Window.partitionBy(*keys, b).orderBy(*order))), carried, [*keys, b])
        .withColumn(out, F.coalesce(out, "_carried"))
        .drop(b, "_carried")
    )


def busy_spells(df: DataFrame, keys: Sequence[str], order: str, gap: int, width: int, out: str) -> DataFrame:
    """Add ``out``: the first ``order`` value of the spell a row belongs to.

    A spell ends where the next distinct value of ``order`` of the key is more
    than ``gap`` away.  State that fades within ``gap`` never crosses spells,
    so they are independent units of work.  Slices of ``width`` keep a hot key
    parallel.
    """
    keys = list(keys)
    slice_ = F.floor(F.col(order) / width)
    points = previous_value(df.select(*keys, order).distinct(), keys, order, slice_, "_prev")
    opens = F.col("_prev").isNull() | (F.col(order) - F.col("_prev") > gap)
    points = points.select(*keys, order, slice_.alias("_slice"), F.when(opens, F.col(order)).alias("_open"))
    inner = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        points.groupBy(*keys, "_slice")
        .agg(F.max("_open").alias("_last"))
        .select(*keys, "_slice", F.max("_last").over(before).alias("_before"))
    )
    spells = (
        meet(points.withColumn("_in", F.max("_open").over(inner)), carried, [*keys, "_slice"])
        .select(*keys, order, F.coalesce("_in", "_before").alias(out))
    )
    return meet(df, spells, [*keys, order])

"""Typed table access, append sink and row-count profile."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstream.schema import TABLES


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan one register table with its declared schema (no inference)."""
    return spark.read.schema(TABLES[name]).parquet(f"{directory}/{name}")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared checkpoint folder of the cluster.

    Only a session on a local master that names none gets a folder of its own,
    recorded in the session; on a cluster that is an error, because executors
    would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, computes once."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A published batch and the write attempt that counts for it.
_COMMIT = "batch string, attempt string"


def _commits(spark: SparkSession, root: str) -> DataFrame:
    """The published batches under ``root``, one row each; the log is made where it is missing."""
    spark.createDataFrame([], _COMMIT).write.mode("ignore").parquet(f"{root}/commits")
    return spark.read.schema(_COMMIT).parquet(f"{root}/commits").groupBy("batch").agg(F.min("attempt").alias("attempt"))


def append_register(tables, root: str, batch_id: int | None = None) -> bool:
    """Append the rows of one batch to the register tables under ``root``: all of them, or none.

    Every table's rows go to a folder of this attempt.  Only when all are
    written, one record in the log ``commits`` publishes them together, and
    ``read_register`` shows published rows only.  An attempt that ends early
    leaves nothing that readers see; a repeated ``batch_id`` (streaming) is
    not written again, and of two attempts at once one counts.  Without a
    ``batch_id`` every call is a batch of its own.  Returns whether rows were added.
    """
    items = list(tables.items())
    spark = items[0][1].sparkSession
    batch = uuid.uuid4().hex if batch_id is None else str(batch_id)
    if not _commits(spark, root).filter(F.col("batch") == batch).isEmpty():
        return False
    attempt = f"try-{batch}-{uuid.uuid4().hex}"
    for name, df in items:
        df.write.parquet(f"{root}/{name}/attempt={attempt}")
    spark.createDataFrame([(batch, attempt)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return True


def read_register(spark: SparkSession, root: str, name: str, batches: bool = False) -> DataFrame:
    """The published rows of one register table; ``batches`` adds ``batch``, the batch they came with."""
    published = _commits(spark, root)
    rows = spark.read.parquet(f"{root}/{name}").join(published, "attempt").drop("attempt")
    return rows if batches else rows.drop("batch")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, as (table_name, row_count)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table plus the grand total."""
    counts = table_counts(tables)
    total = counts.agg(F.sum("row_count").alias("row_count")).select(F.lit("TOTAL").alias("table_name"), "row_count")
    return counts.unionByName(total)

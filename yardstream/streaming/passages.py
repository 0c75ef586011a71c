"""Passage de-duplication on a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from yardstream.functions.windows import micros
from yardstream.streaming.buckets import KeyBucket, bucket_of
from yardstream.streaming.running import use_rocksdb


class _LastAccepted(KeyBucket):
    """Per key the last accepted passage; forgotten once the window has passed."""

    def __init__(self, window: int, keys: list[str], event_id: str, columns: list[str]) -> None:
        self.window, self.keys, self.event_id, self.columns = window, keys, event_id, columns

    def due(self, value: tuple[int, int]) -> int:
        return (value[0] + self.window) // 1000 + 1

    def change(self, keys: dict, rows: Iterator[Row]) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r["t_us"] is not None, r["t_us"], r[self.event_id])):
            at, who = r["t_us"], r[self.event_id]
            if at is not None and not r["is_free"]:
                key = tuple(r[k] for k in self.keys)
                last = keys.get(key)
                if last is None or at - last[0] > self.window:
                    keys[key] = at, who
                else:
                    who = last[1]
            yield Row(**{c: r[c] for c in self.columns}, accepted_id=who)


def dedup_stream(
    events: DataFrame,
    window_seconds: int = 15,
    keys: Sequence[str] = ("plate_number", "event_type"),
    ts: str = "ts",
    event_id: str = "event_id",
    delay: str = "10 minutes",
    exempt: Sequence[str] = ("", "UNKNOWN"),
) -> DataFrame:
    """The streaming form of :func:`yardstream.operators.dedup.dedup_passages`.

    Adds ``accepted_id``.  Rows later than ``delay`` behind the newest are
    dropped and counted in the query progress (numRowsDroppedByWatermark).
    Unreadable plates have no duplicates and are spread by their id.
    A micro-batch should stay within memory per key: bound it at the source.
    """
    use_rocksdb(events.sparkSession)
    free = F.col(keys[0]).isNull() | F.col(keys[0]).isin(*exempt)
    shared = [F.when(~free, F.col(k)) for k in keys]
    timed = events.withColumns({
        "event_time": F.col(ts).cast("timestamp"), "t_us": micros(F.col(ts)), "is_free": free,
        "bucket": bucket_of(*shared, F.when(free, F.col(event_id))),
    }).withWatermark("event_time", delay)
    out = StructType([*events.schema.fields, StructField("accepted_id", LongType())])
    return timed.groupBy("bucket").transformWithState(
        statefulProcessor=_LastAccepted(window_seconds * 1_000_000, list(keys), event_id, events.columns),
        outputStructType=out, outputMode="Append", timeMode="EventTime",
    )

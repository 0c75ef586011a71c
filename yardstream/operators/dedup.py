"""Passage de-duplication: greedy against the last accepted passage.

A passage is a duplicate when the same key was *accepted* at most ``window``
seconds before.  The rule is sequential per key, but a day of passages only
needs one number from the day before: the last accepted time, and only if it
lies within the window of midnight.  Rows are therefore processed per
(key, slice of time):

1. slices whose first passage lies within the window of the previous slice's
   last passage are *linked* (found from the few rows near slice borders);
2. for linked slices only, a scan yields the border function "first passage
   accepted -> last passage accepted";
3. chaining these few rows per key gives each linked slice its starting state;
4. one scan over all rows marks the accepted ones.

A key with a third of all rows is spread over its slices, nothing is collected,
and keys without passages around a border cost nothing extra.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from yardstream.functions.windows import DAY_MICROS, micros, spread

_NONE = -(2**62)


def _group_starts(batch: pa.RecordBatch, keys: Sequence[str], last: list | None) -> tuple[np.ndarray, list]:
    """Flags of rows that open a new key, and the key of the last row."""
    starts = np.zeros(batch.num_rows, dtype=bool)
    for name in keys:
        column = batch.column(name)
        change = pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1))
        starts[1:] |= pc.fill_null(change, True).to_numpy(zero_copy_only=False)
    first = [batch.column(k)[0].as_py() for k in keys]
    starts[0] = first != last
    return starts, [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]


def _accept_scan(keys: list[str], window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, accepted_at, accepted_id = None, _NONE, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, last_key = _group_starts(batch, keys, last_key)
            times, ids = batch.column("_t").to_pylist(), batch.column("_id").to_pylist()
            entry, entry_id = batch.column("_entry").to_pylist(), batch.column("_entry_id").to_pylist()
            owner = [0] * batch.num_rows
            for i, opens in enumerate(starts.tolist()):
                if opens:
                    accepted_at = _NONE if entry[i] is None else entry[i]
                    accepted_id = entry_id[i]
                if times[i] - accepted_at > window:
                    accepted_at, accepted_id = times[i], ids[i]
                owner[i] = accepted_id
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(owner, pa.int64())], [*batch.schema.names, "accepted_id"]
            )

    return scan


def _border_scan(keys: list[str], window: int, width: int):
    """Per slice: (first accepted, last accepted) for every possible first one.

    Chains that meet are merged, so only passages of the last ``window`` are live.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = state = None
        live: deque = deque()
        open_entry = True

        def rows(key: list) -> list[list]:
            pairs = sorted((e, at, who) for at, who, entries in live for e in entries)
            kept = [p for i, p in enumerate(pairs) if i + 1 == len(pairs) or pairs[i + 1][1] != p[1]]
            return [[*key, *p] for p in kept]

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema(
                [batch.schema.field(k) for k in keys]
                + [pa.field(n, pa.int64()) for n in ("_first", "_last", "_last_id")]
            )
            out: list[list] = []
            starts, last_key = _group_starts(batch, keys, state)
            times, ids = batch.column("_t").to_pylist(), batch.column("_id").to_pylist()
            slices = batch.column("_slice").to_pylist()
            key = state
            for i, opens in enumerate(starts.tolist()):
                if opens:
                    if key is not None:
                        out += rows(key)
                    key = [batch.column(k)[i].as_py() for k in keys]
                    live.clear()
                    open_entry = True
                t, who, entries = times[i], ids[i], []
                while live and t - live[0][0] > window:
                    entries += live.popleft()[2]
                if open_entry:
                    entries.append(t)
                    open_entry = t <= slices[i] * width + window
                if entries:
                    if live and live[-1][0] == t:
                        live[-1][2].extend(entries)
                    else:
                        live.append((t, who, entries))
            state = last_key
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if state is not None and live:
            out = rows(state)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return scan


def _chain_scan(keys: list[str], window: int):
    """Walk the border rows of a key in time order; give each slice its start."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, slice_no, at, who, taken = None, None, _NONE, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, last_key = _group_starts(batch, keys, last_key)
            slices, linked = batch.column("_slice").to_pylist(), batch.column("_linked").to_pylist()
            first, last = batch.column("_first").to_pylist(), batch.column("_last").to_pylist()
            last_id = batch.column("_last_id").to_pylist()
            picked, entry, entry_id = [], [], []
            for i, opens in enumerate(starts.tolist()):
                if opens or slices[i] != slice_no:
                    if opens or not linked[i]:
                        at, who = _NONE, None
                    slice_no, taken = slices[i], False
                    if at != _NONE:
                        picked.append(i)
                        entry.append(at)
                        entry_id.append(who)
                if not taken and first[i] - at > window:
                    at, who, taken = last[i], last_id[i], True
            rows = batch.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(k) for k in [*keys, "_slice"]), pa.array(entry, pa.int64()), pa.array(entry_id, pa.int64())],
                [*keys, "_slice", "_entry", "_entry_id"],
            )

    return scan


def dedup_passages(
    events: DataFrame,
    window_seconds: int = 15,
    keys: Sequence[str] = ("plate_number", "event_type"),
    ts: str = "ts",
    event_id: str = "event_id",
    exempt: Sequence[str] = ("", "UNKNOWN"),
    slice_micros: int | None = None,
) -> DataFrame:
    """Add ``accepted_id``: the event that stands for this one (itself when accepted).

    Rows whose first key is empty or in ``exempt`` are always accepted.
    """
    keys, window = list(keys), window_seconds * 1_000_000
    width = max(slice_micros or DAY_MICROS, 2 * window)
    columns = events.columns
    rows = (
        events.withColumn("_t", micros(F.col(ts)))
        .withColumn("_id", F.col(event_id).cast("long"))
        .withColumn("_slice", F.floor(F.col("_t") / width).cast("long"))
    )
    free = F.col(keys[0]).isNull() | F.col(keys[0]).isin(*exempt)
    passed = rows.filter(free).withColumn("accepted_id", F.col("_id"))
    rows = rows.filter(~free)
    narrow = rows.select(*keys, "_slice", "_t", "_id")

    # 1. borders with passages on both sides at most one window apart
    into = F.col("_t") - F.col("_slice") * width
    border = F.explode(
        F.array_compact(
            F.array(
                F.when(into < window, F.struct(F.col("_slice").alias("_slice"), F.lit(None).cast("long").alias("l"), F.col("_t").alias("r"))),
                F.when(into >= width - window, F.struct((F.col("_slice") + 1).alias("_slice"), F.col("_t").alias("l"), F.lit(None).cast("long").alias("r"))),
            )
        )
    ).alias("b")
    linked = (
        narrow.filter((into < window) | (into >= width - window))
        .select(*keys, border)
        .groupBy(*keys, F.col("b._slice").alias("_slice"))
        .agg(F.max("b.l").alias("l"), F.min("b.r").alias("r"))
        .filter(F.col("r") - F.col("l") <= window)
        .select(*keys, "_slice")
    )
    # 2. border functions of the slices in a linked run
    member = (
        linked.select(*keys, F.explode(F.array(
            F.struct(F.col("_slice").alias("_slice"), F.lit(True).alias("_linked")),
            F.struct((F.col("_slice") - 1).alias("_slice"), F.lit(False).alias("_linked")),
        )).alias("m"))
        .groupBy(*keys, F.col("m._slice").alias("_slice"))
        .agg(F.max("m._linked").alias("_linked"))
    )
    chunk = [*keys, "_slice"]
    slot = [f for f in rows.select(*chunk).schema]
    longs = lambda *names: [StructField(n, LongType()) for n in names]
    borders = (
        narrow.join(member.select(*chunk), chunk, "left_semi")
        .repartition(*chunk)
        .sortWithinPartitions(*chunk, "_t", "_id")
        .mapInArrow(_border_scan(chunk, window, width), StructType(slot + longs("_first", "_last", "_last_id")))
    )
    # 3. starting state of every linked slice
    entries = (
        borders.join(member, chunk)
        .repartition(*keys)
        .sortWithinPartitions(*chunk, "_first")
        .mapInArrow(_chain_scan(keys, window), StructType(slot + longs("_entry", "_entry_id")))
    )
    # 4. mark
    marked = rows.join(entries, chunk, "left")
    marked = spread(marked, chunk).sortWithinPartitions(*chunk, "_t", "_id")
    schema = StructType([*marked.schema.fields, *longs("accepted_id")])
    marked = marked.mapInArrow(_accept_scan(chunk, window), schema)
    return marked.select(*columns, "accepted_id").unionByName(passed.select(*columns, "accepted_id"))

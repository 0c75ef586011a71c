"""Passages and trips on a stream: a state per plate, kept in buckets of plates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from yardstream.functions.windows import micros
from yardstream.operators.trips import CLOSED, progress_columns
from yardstream.streaming.buckets import KeyBucket, bucket_of
from yardstream.streaming.packed import packed, unpacked
from yardstream.streaming.running import use_rocksdb

#: What a passage does to a trip, beside the columns of the event; times in microseconds.
_MOVE = (
    "accepted_id long, trip_ref long, is_auto boolean, given_status string, from_status string, to_status string, "
    "entry_us long, exit_us long, created_us long, dwell_minutes int"
)
_NO_MOVE = (None,) * 9


def _dwell(entry: int, left: int) -> int:
    """Whole minutes, half to even, at least one, as ``operators.trips.dwell_minutes``."""
    return max(1, round((left - entry) / 60_000_000))


class _Plates(KeyBucket):
    """Per plate the last accepted passage of each direction, the stack of open trips, and the trip that the vehicle is on.

    The trip on top of the stack has the highest id.  It leaves the stack with
    the first event that touches it and is kept apart until the exit.
    """

    def __init__(self, window: int | None, impute: bool) -> None:
        self.window, self.impute = window, impute

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._save({p["plate"]: ({}, [(t["trip_id"], t["status"], t["entry_us"]) for t in p["waiting"]], None) for p in initialState["plates"]}, None)

    def due(self, value: tuple) -> int | None:
        seen = value[0]
        return (max(at for at, _ in seen.values()) + self.window) // 1000 + 1 if seen else None

    def expire(self, keys: dict, key) -> Iterator[Row]:
        _, stack, trip = keys.pop(key)
        if stack or trip:
            keys[key] = {}, stack, trip
        return iter(())

    def _accept(self, seen: dict, kind: str, at: int, event: int) -> int:
        """The passage that the event belongs to: itself, or an accepted one of the same direction not long before."""
        if self.window is None:
            return event
        before, who = seen.get(kind, (None, None))
        if before is None or at - before > self.window:
            seen[kind] = at, event
            return event
        return who

    def change(self, keys: dict, rows: Iterator[Row]) -> Iterator[Row]:
        for _, at, _, event, has_plate, enters, kind, plate, passed in sorted(map(_step, rows), key=lambda r: r[:4]):
            move = _NO_MOVE
            accepted = event
            if has_plate and at is not None:
                seen, stack, trip = keys.get(plate, ({}, [], None))
                accepted = self._accept(seen, kind, at, event)
                if accepted == event:
                    if trip is None and stack and (enters or kind == "exit"):
                        ref, status, entry = stack.pop()
                        trip = (ref, False, status, entry, None, False)
                    if enters:
                        ref, auto, status, _, created, entered = trip or (-event, True, "scheduled", None, at, False)
                        trip = (ref, auto, status, at, created, True)
                        move = (ref, auto, status, status if not entered else None, "inside_plant", at, None, created, None)
                    elif kind == "exit" and trip:
                        ref, auto, status, entry, created, entered = trip
                        dwell = _dwell(entry, at) if entry is not None else 25 if self.impute else None
                        move = (ref, auto, status, "inside_plant" if entered else status, "completed", entry, at, created, dwell)
                        trip = None
                    elif kind == "exit":
                        move = (*_NO_MOVE[:8], 30 if self.impute else None)
                if seen or stack or trip:
                    keys[plate] = seen, stack, trip
                else:
                    keys.pop(plate, None)
            yield _MOVED(passed, accepted, *move)


_MOVE_NAMES = [f.split()[0] for f in _MOVE.split(", ")]
_MOVED = Row("passed", *_MOVE_NAMES)


def _step(r: Row) -> tuple:
    """What the state needs of an event (``step``, see ``trip_moves``), with its plate and packed columns; times and ids that are null come first."""
    flags, at, event, *kind = r["step"].split(" ", 3)
    return bool(at), int(at) if at else None, bool(event), int(event) if event else None, flags[0] == "1", flags[1] == "1", *(kind or [None]), r["plate"], r["passed"]


def trip_moves(
    events: DataFrame, trips: DataFrame, dedup_seconds: int | None = None, impute_dwell: bool = True, delay: str = "10 minutes",
) -> DataFrame:
    """Decided events (event_id long, ts, plate_number, event_type, decision, more) with what each does to a trip.

    The streaming form of passage de-duplication (none where ``dedup_seconds``
    is None) and of ``progress_trips``, ``trip_history`` and ``exit_dwells``,
    which the functions below read off the result.  ``trips`` is a table: its
    open trips are the state that the stream starts with, a stack per plate.

    Adds ``accepted_id``; ``trip_ref``, ``is_auto``, ``given_status``,
    ``to_status``, ``entry_us``, ``exit_us``, ``created_us`` for passages that
    move a trip, with ``from_status`` where its status changes;
    ``dwell_minutes`` for exits.  Plates that are null, '' or UNKNOWN have
    neither duplicates nor trips and are spread by their id; events without a
    time have none either.

    Events of a plate count in the order (ts, event_id) inside a micro-batch
    and in the order of arrival between them.  A micro-batch should stay within
    memory per plate: bound it at the source.
    """
    use_rocksdb(events.sparkSession)
    plate, columns = F.col("plate_number"), events.columns
    free = plate.isNull() | plate.isin("", "UNKNOWN")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    flag = lambda c: F.when(c, "1").otherwise("0")
    enters = (F.col("event_type") == "entry") & (F.col("decision") == "allow")
    step = F.concat(flag(~free), flag(enters), F.lit(" "), text(micros(F.col("ts"))), F.lit(" "), text(F.col("event_id")), F.coalesce(F.concat(F.lit(" "), F.col("event_type")), F.lit("")))
    timed = events.select(
        bucket_of(F.when(~free, plate), F.when(free, F.col("event_id"))).alias("bucket"), F.col("ts").cast("timestamp").alias("event_time"),
        step.alias("step"), plate.alias("plate"), packed(columns).alias("passed"),
    ).withWatermark("event_time", delay)
    no_event = F.lit(None).cast(events.schema["event_id"].dataType)
    opened = trips.filter(~F.col("status").isin(*CLOSED) & plate.isNotNull() & ~plate.isin("", "UNKNOWN")).groupBy(plate.alias("plate")).agg(
        F.sort_array(F.collect_list(F.struct("trip_id", "status", micros(F.col("actual_entry_time")).alias("entry_us")))).alias("waiting"))
    opened = opened.groupBy(bucket_of(F.col("plate"), no_event).alias("bucket")).agg(F.collect_list(F.struct("plate", "waiting")).alias("plates"))
    window = None if dedup_seconds is None else dedup_seconds * 1_000_000
    moves = timed.groupBy("bucket").transformWithState(
        statefulProcessor=_Plates(window, impute_dwell), outputStructType=StructType.fromDDL(f"passed string, {_MOVE}"),
        outputMode="Append", timeMode="EventTime", initialState=opened.groupBy("bucket"),
    )
    return moves.select(unpacked(F.col("passed"), events.schema).alias("passed"), *_MOVE_NAMES).select("passed.*", *_MOVE_NAMES)


def _time(us: str) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def moved_trips(moves: DataFrame) -> DataFrame:
    """The trips that ``moves`` touched, as ``progress_trips`` gives them: the last move of a trip counts."""
    last = F.max_by(F.struct(*[c for c in _MOVE_NAMES if c not in ("accepted_id", "trip_ref")]), F.struct("ts", "event_id"))
    rows = moves.filter("trip_ref is not null").groupBy("trip_ref", "plate_number").agg(last.alias("m")).select("trip_ref", "plate_number", "m.*")
    return progress_columns(
        rows, F.col("trip_ref"), F.col("is_auto"), F.col("given_status"), F.col("to_status"), _time("entry_us"), _time("exit_us"),
        F.col("dwell_minutes"), F.when(F.col("is_auto"), _time("created_us")),
    )


def moved_history(moves: DataFrame) -> DataFrame:
    """The status changes among ``moves``, as ``trip_history`` gives them."""
    return moves.filter("trip_ref is not null and from_status is not null").select(
        "trip_ref", "plate_number", "from_status", "to_status", F.col("event_id").alias("trigger_event_id"), "ts")

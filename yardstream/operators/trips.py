"""Trips: open-trip lookup, progression by gate events, lifecycle checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstream.functions.plate_rules import plate_key
from yardstream.functions.windows import DAY_MICROS, micros, neighbour_row, running_sum, time_bucket
from yardstream.operators.master import with_new_ids

ACTIVE = ("arrived", "entry_approved", "inside_plant", "at_destination")
CLOSED = ("completed", "cancelled")
INSIDE = ("inside_plant", "at_destination")
# fixed values: order of the trip lifecycle
LIFECYCLE = ("scheduled", "arrived", "entry_approved", "inside_plant", "at_destination", "exit_detected", "completed")


def open_trip_per_plate(trips: DataFrame) -> DataFrame:
    """The open trip with the highest id of every plate.

    Plates that differ in case, spaces and hyphens only are one;
    ``plate_number`` is their lookup key.  Trips without a plate have none.
    """
    detail = F.struct("trip_id", "trip_number", "status", "purpose", "gate_name")
    return (
        trips.filter(~F.col("status").isin(*CLOSED))
        .groupBy(plate_key(F.col("plate_number")).alias("plate_number"))
        .agg(F.max_by(detail, F.col("trip_id")).alias("t"))
        .filter("plate_number <> ''")
        .select("plate_number", "t.*")
    )


def last_event_per_plate(events: DataFrame) -> DataFrame:
    return events.groupBy("plate_number").agg(F.max_by("ts", "event_id").alias("last_event"))


def trips_with_last_event(trips: DataFrame, vehicles: DataFrame, events: DataFrame) -> DataFrame:
    """Every trip with its vehicle type and the time of the newest event of its plate."""
    v = vehicles.select("vehicle_id", "vehicle_type")
    return (
        trips.join(v, "vehicle_id", "left")
        .join(last_event_per_plate(events), "plate_number", "left")
        .select(
            "trip_id", "plate_number", F.coalesce("transporter", F.lit("Unregistered")).alias("transporter"),
            F.coalesce("gate_name", F.lit("Gate 01")).alias("gate_name"), "purpose", "expected_arrival", "expected_departure",
            "status", F.col("actual_entry_time").alias("entry_time"), "dwell_minutes",
            F.coalesce("vehicle_type", F.lit("Truck")).alias("vehicle_type"), "last_event",
        )
    )


def active_trips(trips: DataFrame, vehicles: DataFrame, events: DataFrame) -> DataFrame:
    """Trips on the way or on site; without event the entry time stands in."""
    df = trips_with_last_event(trips.filter(F.col("status").isin(*ACTIVE)), vehicles, events)
    return df.withColumn("last_event", F.coalesce("last_event", "entry_time"))


def dwell_minutes(entry: Column, exit_: Column, rounding: str = "round") -> Column:
    """Whole minutes, at least one; ``round`` is half-even, ``floor`` cuts."""
    minutes = (micros(exit_) - micros(entry)) / 60_000_000
    whole = F.bround(minutes, 0) if rounding == "round" else F.floor(minutes)
    return F.greatest(F.lit(1), whole.cast("int"))


def _segments(events: DataFrame, trips: DataFrame) -> DataFrame:
    """One row per (plate, number of exits so far): everything that can touch one trip.

    Open trips of a plate are used up from the highest id down, one per exit,
    and a new trip is only made when none is left.  So the exits seen before an
    event alone decide which trip the event belongs to: the n-th exit closes
    the n-th open trip, later ones the trip made since the previous exit.
    """
    ev = events.filter(~F.col("plate_number").isin("", "UNKNOWN")).select(
        "plate_number", "ts", "event_id",
        (F.col("event_type") == "exit").alias("is_exit"),
        ((F.col("event_type") == "entry") & (F.col("decision") == "allow")).alias("is_entry"),
    )
    one = F.col("is_exit").cast("int")
    ev = running_sum(ev, ["plate_number"], ["ts", "event_id"], one, time_bucket(F.col("ts"), 30 * DAY_MICROS), "_exits")
    ev = ev.withColumn("segment", (F.col("_exits") - one).cast("long"))
    seg = ev.groupBy("plate_number", "segment").agg(
        F.min(F.when(F.col("is_entry"), F.struct("ts", "event_id"))).alias("first_entry"),
        F.max(F.when(F.col("is_entry"), F.col("ts"))).alias("last_entry"),
        F.max(F.when(F.col("is_exit"), F.struct("ts", "event_id"))).alias("leave"),
    )
    waiting = trips.filter(~F.col("status").isin(*CLOSED)).select(
        "plate_number", "trip_id", F.col("status").alias("from_status"), F.col("actual_entry_time").alias("given_entry"),
        (-F.col("trip_id")).alias("_down"),
    )
    waiting = running_sum(waiting, ["plate_number"], ["_down"], F.lit(1), F.floor(F.col("_down") / 1_000_000), "_rank")
    waiting = waiting.select("plate_number", (F.col("_rank") - 1).cast("long").alias("segment"), "trip_id", "from_status", "given_entry")
    return seg.join(waiting, ["plate_number", "segment"], "left")


def progress_trips(events: DataFrame, trips: DataFrame, impute_dwell: bool = True) -> DataFrame:
    """Trips after the events: scheduled ones moved on, automatic ones added.

    ``trip_ref`` is the trip id, or minus the id of the entry event that made
    an automatic trip.  Untouched trips are not returned.  An exit closes the
    trip whatever its decision.
    """
    seg = _segments(events, trips)
    scheduled, entered, left = F.col("trip_id").isNotNull(), F.col("last_entry").isNotNull(), F.col("leave").isNotNull()
    entry = F.coalesce("last_entry", "given_entry")
    missing = F.lit(25) if impute_dwell else F.lit(None).cast("int")
    dwell = F.when(left, F.when(entry.isNotNull(), dwell_minutes(entry, F.col("leave.ts"))).otherwise(missing))
    return progress_columns(
        seg.filter(entered | (scheduled & left)), F.coalesce("trip_id", -F.col("first_entry.event_id")), ~scheduled,
        F.when(scheduled, F.col("from_status")).otherwise(F.lit("scheduled")), F.when(left, F.lit("completed")).otherwise(F.lit("inside_plant")),
        entry, F.col("leave.ts"), dwell, F.when(~scheduled, F.col("first_entry.ts")),
    )


def progress_columns(
    df: DataFrame, ref: Column, auto: Column, before: Column, after: Column, entry: Column, left: Column, dwell: Column, created: Column
) -> DataFrame:
    """The columns of a moved trip; an automatic one is expected to leave two hours after it was made."""
    return df.select(
        ref.alias("trip_ref"), "plate_number", auto.alias("is_auto"), before.alias("from_status"), after.alias("status"), entry.alias("entry_time"),
        left.alias("exit_time"), dwell.alias("dwell_minutes"), created.alias("auto_created_at"), (created + F.expr("interval 2 hours")).alias("auto_expected_departure"),
    )


def number_new_trips(moved: DataFrame, trips: DataFrame) -> DataFrame:
    """The automatic trips among ``moved`` (``progress_trips``) with a ``trip_id`` after the largest of ``trips``, in order of their making."""
    made = moved.filter("is_auto").withColumn("event_id", -F.col("trip_ref"))
    return with_new_ids(made, trips, "trip_id", ["auto_created_at", "event_id"])


def trip_history(events: DataFrame, trips: DataFrame) -> DataFrame:
    """The status changes that ``progress_trips`` makes: one row for the entry and one for the exit of a trip.

    ``trip_ref`` as there.  The entry row names the first allowed entry, which
    moved the trip; an exit of a trip that never entered starts from its given status.
    """
    seg = _segments(events, trips)
    scheduled, entered, left = F.col("trip_id").isNotNull(), F.col("first_entry").isNotNull(), F.col("leave").isNotNull()
    ref = F.coalesce("trip_id", -F.col("first_entry.event_id"))
    before = F.when(scheduled, F.col("from_status")).otherwise(F.lit("scheduled"))
    entry = F.when(entered, F.struct(before.alias("from_status"), F.lit("inside_plant").alias("to_status"), F.col("first_entry.event_id").alias("trigger_event_id"), F.col("first_entry.ts").alias("ts")))
    exit_ = F.when(left, F.struct(F.when(entered, F.lit("inside_plant")).otherwise(before).alias("from_status"), F.lit("completed").alias("to_status"), F.col("leave.event_id").alias("trigger_event_id"), F.col("leave.ts").alias("ts")))
    rows = seg.filter(entered | (scheduled & left)).select(ref.alias("trip_ref"), "plate_number", F.explode(F.array_compact(F.array(entry, exit_))).alias("c"))
    return rows.select("trip_ref", "plate_number", "c.*")


def exit_dwells(events: DataFrame, trips: DataFrame, impute_dwell: bool = True) -> DataFrame:
    """Every exit with the entry it is paired with and its dwell minutes."""
    seg = _segments(events, trips).filter("leave is not null")
    entry = F.coalesce("last_entry", "given_entry")
    has_trip = F.col("trip_id").isNotNull() | F.col("last_entry").isNotNull()
    no_trip, no_entry = (F.lit(30), F.lit(25)) if impute_dwell else (F.lit(None).cast("int"), F.lit(None).cast("int"))
    return seg.select(
        F.col("leave.event_id").alias("event_id"),
        "plate_number",
        F.when(has_trip, F.coalesce("trip_id", -F.col("first_entry.event_id"))).alias("trip_ref"),
        F.when(has_trip, entry).alias("entry_time"),
        F.col("leave.ts").alias("exit_time"),
        F.when(~has_trip, no_trip).when(entry.isNull(), no_entry).otherwise(dwell_minutes(entry, F.col("leave.ts"))).alias("dwell_minutes"),
    )


def apply_status_changes(trips: DataFrame, changes: DataFrame) -> DataFrame:
    """Manual status changes (trip_id, status, changed_at): entry and exit are set once.

    The dwell time is only set with the exit and rounds down.
    """
    c = changes.groupBy("trip_id").agg(
        F.max_by("status", "changed_at").alias("_status"),
        F.min(F.when(F.col("status") == "inside_plant", F.col("changed_at"))).alias("_in"),
        F.min(F.when(F.col("status") == "completed", F.col("changed_at"))).alias("_out"),
    )
    fresh = F.col("actual_exit_time").isNull() & F.col("_out").isNotNull()
    entry = F.coalesce("actual_entry_time", F.when(F.col("_in") < F.col("_out"), F.col("_in")))
    return trips.join(c, "trip_id", "left").withColumns(
        {
            "dwell_minutes": F.when(fresh & entry.isNotNull(), dwell_minutes(entry, F.col("_out"), "floor")).otherwise(F.col("dwell_minutes")),
            "actual_entry_time": F.coalesce("actual_entry_time", "_in"),
            "actual_exit_time": F.coalesce("actual_exit_time", "_out"),
            "status": F.coalesce("_status", "status"),
        }
    ).drop("_status", "_in", "_out")


def status_durations(history: DataFrame) -> DataFrame:
    """Transitions with the time spent in the state entered."""
    bucket = time_bucket(F.col("ts"), 365 * DAY_MICROS)
    df = neighbour_row(history, ["trip_id"], ["ts", "seq"], bucket, ["to_status"], "_before", -1)
    df = neighbour_row(df, ["trip_id"], ["ts", "seq"], bucket, ["ts"], "_after", 1)
    return df.select(
        "trip_id", F.col("_before.to_status").alias("from_status"), "to_status", F.col("ts").alias("entered_at"),
        F.col("_after.ts").alias("left_at"),
        F.round((micros(F.col("_after.ts")) - micros(F.col("ts"))) / 60_000_000, 2).alias("minutes_in_state"),
    )


def lifecycle_violations(history: DataFrame) -> DataFrame:
    """Transitions that go back in the lifecycle or leave a closed trip."""
    bucket = time_bucket(F.col("ts"), 365 * DAY_MICROS)
    df = neighbour_row(history, ["trip_id"], ["ts", "seq"], bucket, ["to_status"], "_before", -1)
    rank = lambda c: F.array_position(F.lit(list(LIFECYCLE)), c)
    before, after = F.col("_before.to_status"), F.col("to_status")
    side = after.isin("cancelled", "exception")
    bad = before.isin(*CLOSED) | (~side & (rank(after) <= rank(before)))
    return df.filter(before.isNotNull() & bad).select("trip_id", before.alias("from_status"), after.alias("to_status"), "ts")


def running_occupancy(events: DataFrame) -> DataFrame:
    """Vehicles inside per gate after every event: entries minus exits so far."""
    delta = F.when(F.col("event_type") == "entry", 1).otherwise(-1)
    return running_sum(events, ["gate_id"], ["ts", "event_id"], delta, time_bucket(F.col("ts")), "occupancy")


def overstays(trips: DataFrame, as_of: Column, overstay_minutes: int = 60) -> DataFrame:
    """Trips on site for too long, or past their expected departure at ``as_of``."""
    long = F.coalesce("dwell_minutes", F.lit(0)) > overstay_minutes
    late = F.coalesce(as_of > F.col("expected_departure"), F.lit(False))
    return trips.filter(F.col("status").isin(*INSIDE) & (long | late))

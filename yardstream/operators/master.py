"""Master data: idempotent loads, registration, patches, deletions, corrections, audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardstream.functions.plate_rules import plate_key, state_code
from yardstream.sources.tables import staged


def insert_missing(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose natural key is not there yet.

    Repeated keys inside ``new`` count once (the lowest ``order``).  Loading the
    same rows again changes nothing.
    """
    rows = new.select(*existing.columns)
    rank = F.struct(*([F.col(order)] if order else [F.col(c) for c in rows.columns]))
    once = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), rank).alias("_r")).select("_r.*")
    return existing.unionByName(once.join(existing.select(key), key, "left_anti").select(*existing.columns))


def audit_rows(df: DataFrame, action: str, entity_type: str, entity_id: Column, details: Column, at: Column) -> DataFrame:
    """One audit entry per row."""
    return df.select(
        F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"), entity_id.cast("string").alias("entity_id"),
        details.alias("details"), at.alias("timestamp"),
    )


@dataclass(frozen=True)
class Registration:
    """Result of registering a batch of vehicles."""

    vehicles: DataFrame
    transporters: DataFrame
    whitelist: DataFrame
    watchlist: DataFrame
    rejected: DataFrame
    audit: DataFrame


def register_vehicles(requests: DataFrame, plates: DataFrame, transporters: DataFrame, as_of: Column) -> Registration:
    """Register vehicles (request_id, plate, vehicle_type, owner_name, transporter, authorized).

    Known plates are rejected, as are later requests for the same plate in the
    batch.  Unknown transporters are added by name.  Authorised vehicles go to
    the whitelist, others to the watchlist.
    """
    req = requests.withColumn("plate_number", plate_key(F.trim("plate")))
    known = plates.select(plate_key(F.col("plate_number")).alias("plate_number")).distinct()
    first = req.groupBy("plate_number").agg(F.min("request_id").alias("request_id"))
    fresh = req.join(first, ["plate_number", "request_id"], "left_semi").join(known, "plate_number", "left_anti")
    rejected = req.join(fresh.select("request_id"), "request_id", "left_anti").select("request_id", "plate_number")
    missing = (
        fresh.filter(F.col("transporter").isNotNull() & (F.col("transporter") != ""))
        .select(F.col("transporter").alias("name")).distinct()
        .join(transporters.select("name"), "name", "left_anti")
    )
    vehicles = fresh.select(
        F.col("request_id").alias("vehicle_id"), "plate_number", state_code(F.col("plate_number")).alias("state_code"), "vehicle_type", "owner_name",
        F.coalesce(F.nullif("transporter", F.lit("")), F.lit("Unregistered")).alias("transporter"), F.col("authorized").alias("is_authorized"),
        F.when(F.col("authorized"), F.lit("Available")).otherwise(F.lit("Flagged")).alias("status"),
    )
    white = vehicles.filter("is_authorized").select("vehicle_id", "plate_number", F.lit("Fleet creation").alias("reason"), as_of.alias("valid_from"), F.lit(True).alias("is_active"))
    watch = vehicles.filter("not is_authorized").select(
        "vehicle_id", "plate_number", F.lit("Created as Flagged/Unauthorized vehicle").alias("reason"), F.lit("high").alias("severity"),
        F.concat(F.lit("Unauthorized vehicle "), "plate_number", F.lit(" registered")).alias("alert_message"), F.lit(True).alias("is_active"),
    )
    text = F.concat(F.lit("Created vehicle "), "plate_number", F.lit(" (type="), "vehicle_type", F.lit(", transporter="), "transporter", F.lit(")"))
    audit = audit_rows(vehicles, "VEHICLE_CREATE", "VEHICLE", F.col("vehicle_id"), text, as_of)
    return Registration(vehicles, transporters.select("name").unionByName(missing), white, watch, rejected, audit)


def with_new_ids(rows: DataFrame, existing: DataFrame, id_name: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``id_name``: the numbers after the largest in ``existing``, without gaps, in ``order``.

    ``order`` must tell the rows apart.  Nulls in it come first; without
    existing ids the numbers start at 1.  The rows are cut into ranges of
    ``order`` and numbered within each; only the sizes of the ranges, one
    number a partition, are added up in one place.  The ranges are written
    down first, so a task that runs again finds the same ones.
    """
    part, before = f"_{id_name}_range", f"_{id_name}_before"
    ranged = staged(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "new-rows")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    until = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("_n").over(until), F.lit(0)).alias(before))
    largest = existing.agg(F.max(id_name)).first()[0] or 0
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.withColumn(id_name, inside).join(starts, part).withColumn(id_name, (F.col(id_name) + F.col(before) + largest).cast("long")).drop(part, before)


def number_registration(done: Registration, vehicles: DataFrame, transporters: DataFrame) -> Registration:
    """``done`` with ids of its own: vehicles in the order of their requests, new transporters in that of the first vehicle naming them.

    ``vehicles`` (vehicle_id) and ``transporters`` (transporter_id, name) are
    the rows there before.  Vehicles get ``transporter_id`` (null where they
    name none), lists and audit the new ``vehicle_id``; ``transporters`` become
    (transporter_id, name).
    """
    fresh = done.vehicles.withColumnRenamed("vehicle_id", "request_id")
    named = staged(with_new_ids(fresh, vehicles, "vehicle_id", ["request_id"]), "new-vehicles")
    ids = named.select("request_id", F.col("vehicle_id").alias("_id"))
    first = named.filter("transporter <> 'Unregistered'").groupBy(F.col("transporter").alias("name")).agg(F.min("vehicle_id").alias("_first"))
    new = with_new_ids(first.join(transporters.select("name"), "name", "left_anti"), transporters, "transporter_id", ["_first"])
    hauliers = staged(transporters.select("transporter_id", "name").unionByName(new.select("transporter_id", "name")), "transporters")

    def renumbered(df: DataFrame, column: str) -> DataFrame:
        kind, names = df.schema[column].dataType, df.columns
        return df.join(ids, F.col(column).cast("long") == F.col("request_id")).withColumn(column, F.col("_id").cast(kind)).select(*names)

    return replace(
        done, vehicles=named.drop("request_id").join(hauliers.withColumnRenamed("name", "transporter"), "transporter", "left"), transporters=hauliers,
        whitelist=renumbered(done.whitelist, "vehicle_id"), watchlist=renumbered(done.watchlist, "vehicle_id"), audit=renumbered(done.audit, "entity_id"),
    )


def merge_patches(base: DataFrame, patches: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Overwrite with the non-null fields of the patches.

    ``order`` names a column of ``patches`` that tells those of one key apart:
    they apply one after the other, so of each field the last non-null value
    counts.  Without it there is at most one patch per key.
    """
    fields = [c for c in patches.columns if c not in (key, order)]
    if order:
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
        patches = patches.groupBy(key).agg(*last)
    p = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    merged = base.join(p, key, "left")
    return merged.withColumns({c: F.coalesce(f"_new_{c}", c) for c in fields}).select(*base.columns)


def audit_vehicle_updates(vehicles: DataFrame, patches: DataFrame, at: Column) -> DataFrame:
    """An audit row for every patch (vehicle_id) of a vehicle that exists."""
    hit = patches.join(vehicles.select("vehicle_id").distinct(), "vehicle_id", "left_semi")
    return audit_rows(hit, "VEHICLE_UPDATE", "VEHICLE", F.col("vehicle_id"), F.concat(F.lit("Updated vehicle "), F.col("vehicle_id").cast("string")), at)


def audit_vehicle_deletes(vehicles: DataFrame, deleted: DataFrame, at: Column) -> DataFrame:
    """An audit row for every vehicle (vehicle_id, plate_number) that ``deleted`` names; repeated names count once."""
    hit = vehicles.join(deleted.select("vehicle_id").distinct(), "vehicle_id", "left_semi")
    text = F.concat(F.lit("Deleted vehicle "), F.col("vehicle_id").cast("string"), F.lit(" ("), F.coalesce("plate_number", F.lit("None")), F.lit(")"))
    return audit_rows(hit, "VEHICLE_DELETE", "VEHICLE", F.col("vehicle_id"), text, at)


def delete_cascade(deleted: DataFrame, key: str, parents: DataFrame, owned: dict[str, DataFrame], linked: dict[str, tuple[DataFrame, str]]):
    """Delete parents and the rows they own; other references become null.

    Returns (parents, owned, linked) without the deleted keys.
    """
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    keep = parents.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    rest = {n: df.join(gone, F.col(key) == F.col("_gone"), "left_anti") for n, df in owned.items()}
    loose = {
        n: df.join(gone, F.col(ref) == F.col("_gone"), "left").withColumn(ref, F.when(F.col("_gone").isNull(), F.col(ref))).drop("_gone")
        for n, (df, ref) in linked.items()
    }
    return keep, rest, loose


def clear_read_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.col("is_read"))


def mark_alerts_read(alerts: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Mark the given alerts read at a time; alerts read before keep theirs only if untouched."""
    hit = ids.select(F.col("alert_id").alias("_hit")).distinct()
    old = F.col("read_at") if "read_at" in alerts.columns else F.lit(None).cast("timestamp_ntz")
    return (
        alerts.join(hit, F.col("alert_id") == F.col("_hit"), "left")
        .withColumn("read_at", F.when(F.col("_hit").isNotNull(), at).otherwise(old))
        .withColumn("is_read", F.col("is_read") | F.col("_hit").isNotNull())
        .drop("_hit")
    )


def parse_iso(text: Column) -> Column:
    """ISO time as wall-clock time: a zone suffix is dropped, bad text gives null."""
    return F.regexp_replace(text, r"(Z|[+-]\d{2}:\d{2})$", "").try_cast("timestamp_ntz")


def schedule_trips(requests: DataFrame, vehicles: DataFrame, transporters: DataFrame, gates: DataFrame, as_of: Column) -> DataFrame:
    """Trips from booking requests: plate cleaned, references resolved, times parsed.

    Unreadable arrivals become ``as_of``, unreadable departures two hours later.
    """
    v = vehicles.select(plate_key(F.col("plate_number")).alias("plate_number"), "vehicle_id")
    t = transporters.select(F.col("name").alias("transporter"), F.lit(True).alias("_t"))
    g = gates.select("gate_name", "gate_id")
    df = requests.withColumn("plate_number", plate_key(F.trim("plate")))
    arrival = F.coalesce(parse_iso(F.col("arrival_text")), as_of)
    df = df.withColumn("expected_arrival", arrival)
    return (
        df.join(v, "plate_number", "left").join(t, "transporter", "left").join(g, "gate_name", "left")
        .select(
            "request_id", "plate_number", "vehicle_id", "transporter", F.coalesce("_t", F.lit(False)).alias("transporter_known"), "gate_name", "gate_id",
            "expected_arrival", F.coalesce(parse_iso(F.col("departure_text")), F.col("expected_arrival") + F.expr("interval 2 hours")).alias("expected_departure"),
            F.lit("scheduled").alias("status"),
        )
    )


@dataclass(frozen=True)
class Corrected:
    """Predictions and events after operator corrections, with their records."""

    predictions: DataFrame
    events: DataFrame
    corrections: DataFrame
    audit: DataFrame


def apply_corrections(predictions: DataFrame, events: DataFrame, corrections: DataFrame) -> Corrected:
    """Apply (prediction_id, corrected_plate, corrected_at); the latest per prediction wins.

    A corrected prediction is final with at least 0.98; its event takes the
    plate and is allowed.
    """
    latest = corrections.groupBy("prediction_id").agg(F.max_by(plate_key(F.trim("corrected_plate")), "corrected_at").alias("_plate"), F.max("corrected_at").alias("_at"))
    joined = predictions.join(latest, "prediction_id", "left")
    hit = F.col("_plate").isNotNull()
    fixed = joined.withColumns({
        "_old": F.col("fused_text"),
        "fused_text": F.coalesce("_plate", "fused_text"),
        "status": F.when(hit, F.lit("finalized")).otherwise(F.col("status")),
        "confidence": F.when(hit, F.greatest("confidence", F.lit(0.98))).otherwise(F.col("confidence")),
    })
    log = fixed.filter(hit).select("prediction_id", F.col("_old").alias("original_plate"), F.col("_plate").alias("corrected_plate"), F.col("_at").alias("corrected_at"))
    ev = events.join(latest.select(F.col("prediction_id").alias("_p"), "_plate"), F.col("prediction_id") == F.col("_p"), "left")
    ev = ev.withColumns({
        "plate_number": F.coalesce("_plate", "plate_number"), "is_corrected": F.col("is_corrected") | hit,
        "decision": F.when(hit, F.lit("allow")).otherwise(F.col("decision")),
    }).drop("_p", "_plate")
    text = F.concat(F.lit("Plate corrected from '"), "original_plate", F.lit("' to '"), "corrected_plate", F.lit("'"))
    audit = audit_rows(log, "MANUAL_PLATE_CORRECTION", "PLATE_PREDICTION", F.col("prediction_id"), text, F.col("corrected_at"))
    return Corrected(fixed.select(*predictions.columns), ev.select(*events.columns), log, audit)

"""Detections as boxes: filters, quality gates, plate regions, overlaps, suppression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstream.functions import geometry as G
from yardstream.functions.windows import meet, sorted_scan

VEHICLE_LABELS = ("bike", "car", "motorcycle", "bus", "truck")
# fixed values: label, x, y, width, height as shares of the vehicle box
PLATE_REGIONS = (
    ("front-bottom-center", 0.10, 0.62, 0.80, 0.30),
    ("front-bottom-wide", 0.02, 0.55, 0.96, 0.42),
    ("top-center", 0.15, 0.08, 0.70, 0.25),
    ("mid-center", 0.10, 0.38, 0.80, 0.28),
)


def crop_quality(crops: DataFrame) -> DataFrame:
    """Add the first failing ``reason``, ``is_usable`` and ``score`` of plate crops."""
    w, h, aspect = F.col("w"), F.col("h"), F.col("w") / F.greatest(F.lit(1.0), F.col("h"))
    reason = (
        F.when((w < 16) | (h < 6), "too_small")
        .when((aspect < 0.5) | (aspect > 9.0), "bad_aspect_ratio")
        .when((F.col("brightness") < 10) | (F.col("brightness") > 250) | (F.col("contrast") < 4.0), "poor_exposure")
        .when(F.col("sharpness") < 4.0, "too_blurry")
    )
    score = F.least(F.lit(100.0), F.col("sharpness") / 4.0 + F.col("contrast") * 0.4 + F.least(w, F.lit(200)) * 0.2)
    df = crops.withColumn("reason", reason).withColumn("is_usable", F.col("reason").isNull())
    return df.withColumn("score", F.when(F.col("is_usable"), score).otherwise(F.lit(0.0)))


def crop_quality_browser(crops: DataFrame) -> DataFrame:
    w, h, aspect = F.col("w"), F.col("h"), F.col("w") / F.greatest(F.lit(1.0), F.col("h"))
    reason = (
        F.when((w < 30) | (h < 12) | (w * h < 360), "too_small")
        .when((aspect < 1.1) | (aspect > 7.5), "bad_aspect_ratio")
        .when(F.col("sharpness") < 5, "too_blurry")
    )
    return crops.withColumn("reason", reason).withColumn("is_usable", F.col("reason").isNull())


def region_usable(w: Column, h: Column, variance: Column) -> Column:
    return (w >= 30) & (h >= 8) & F.try_divide(w, h).between(1.2, 12) & (variance >= 55)


def filter_detections(boxes: DataFrame, width: int, height: int, labels: Sequence[str] = VEHICLE_LABELS) -> DataFrame:
    """Vehicle boxes clipped to whole pixels of the frame, without tiny ones."""
    x1, y1, x2, y2 = G.clamp(G.box(), width, height)
    df = boxes.filter(F.col("label").isin(*labels)).withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})
    least_w, least_h = max(24, int(width * 0.04)), max(24, int(height * 0.04))
    return df.filter((F.col("x2") - F.col("x1") >= least_w) & (F.col("y2") - F.col("y1") >= least_h))


def plate_regions(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """The four places of a vehicle box where a plate is looked for."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def clip(v: Column, low: Column, high: Column) -> Column:
        return F.greatest(low, F.least(high, v))

    shapes = F.array(*[
        F.struct(
            F.lit(label).alias("label"),
            clip(F.col("x1") + w * fx, F.lit(0.0), F.lit(width - 1.0)).alias("sx"),
            clip(F.col("y1") + h * fy, F.lit(0.0), F.lit(height - 1.0)).alias("sy"),
            (w * fw).alias("w0"), (h * fh).alias("h0"),
        )
        for label, fx, fy, fw, fh in PLATE_REGIONS
    ])
    df = boxes.select("frame_id", "box_id", F.inline(shapes))
    df = df.withColumn("sw", clip(F.col("w0"), F.lit(1.0), width - F.col("sx"))).withColumn("sh", clip(F.col("h0"), F.lit(1.0), height - F.col("sy")))
    df = df.filter((F.col("sw") >= 25) & (F.col("sh") >= 7))
    return df.select("frame_id", "box_id", "label", *[F.round(c, 4).alias(c) for c in ("sx", "sy", "sw", "sh")])


# --- overlaps -------------------------------------------------------------------
def box_pairs(boxes: DataFrame) -> DataFrame:
    """Geometry of every box against the next box of its frame."""
    a = boxes.select("frame_id", "box_id", *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = boxes.select("frame_id", (F.col("box_id") - 1).alias("box_id"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    p, q = G.box("a_"), G.box("b_")
    _, _, w, h = G.to_xywh(p)
    return a.join(b, ["frame_id", "box_id"]).select(
        "frame_id", "box_id", w.alias("w"), h.alias("h"), G.area(p).alias("area"),
        G.iou(p, q).alias("iou"), G.center_distance(p, q).alias("center_distance"), G.containment(p, q).alias("containment"),
    )


def plates_in_vehicles(plates: DataFrame, vehicles: DataFrame, margin: float = 25.0, min_share: float = 0.40, cell: float = 128.0) -> DataFrame:
    """(frame_id, plate_id, vehicle_id) pairs: plate centre in the widened vehicle box, or
    more than ``min_share`` of the plate covered.

    Both conditions need the plate to touch the widened vehicle box, so boxes
    meet per grid cell of a frame instead of per frame.  A pair seen in several
    cells is taken in the one holding the corner of its overlap.
    """
    def cells(b: G.Box, grow: float) -> Column:
        xs = F.sequence(F.floor((b[0] - grow) / cell), F.floor((b[2] + grow) / cell))
        ys = F.sequence(F.floor((b[1] - grow) / cell), F.floor((b[3] + grow) / cell))
        return F.explode(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy"))))))

    names = ("x1", "y1", "x2", "y2")
    p = plates.select("frame_id", "plate_id", *[F.col(c).alias(f"p_{c}") for c in names], cells(G.box(), 0.0).alias("c"))
    v = vehicles.select("frame_id", "vehicle_id", *[F.col(c).alias(f"v_{c}") for c in names], cells(G.box(), margin).alias("c"))
    pb, vb = G.box("p_"), G.box("v_")
    owner_x = F.floor(F.greatest(pb[0], vb[0] - margin) / cell)
    owner_y = F.floor(F.greatest(pb[1], vb[1] - margin) / cell)
    return (
        p.join(v, ["frame_id", "c"])
        .filter((F.col("c.cx") == owner_x) & (F.col("c.cy") == owner_y))
        .filter(G.center_inside(pb, vb, margin) | (G.containment(pb, vb) > min_share))
        .select("frame_id", "plate_id", "vehicle_id")
    )


# --- suppression -----------------------------------------------------------------
#: Rows that are compared among themselves at once.
_AT_ONCE = 1024


def _suppress_scan(keys: list[str], iou_limit: float, iou_inclusive: bool, contain_limit: float | None):
    """Greedy suppression of boxes arriving by frame and falling confidence.

    The overlaps of many rows are computed at once; only pairs that hit are looked at one by one.
    """

    def hits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether boxes ``a`` (earlier) suppress boxes ``b``, row by row."""
        w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
        h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
        inter = np.where((w > 0) & (h > 0), w * h, 0.0)
        area = np.maximum(1.0, (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]))
        areas = np.maximum(1.0, (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]))
        iou = inter / (area + areas - inter)
        hit = iou >= iou_limit if iou_inclusive else iou > iou_limit
        if contain_limit is not None:
            hit |= inter / np.minimum(area, areas) >= contain_limit
        return hit & (inter > 0)

    def settle(coords: np.ndarray, number: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Which rows survive; ``number`` counts the frames, and ``kept`` are survivors of the first one."""
        out = np.ones(len(coords), dtype=bool)
        head = int(np.searchsorted(number, number[0], "right"))
        for low in range(0, len(kept), _AT_ONCE):
            part = kept[low : low + _AT_ONCE]
            for i in range(0, head, _AT_ONCE):
                rows = coords[i : min(i + _AT_ONCE, head)]
                met = hits(np.tile(part, (len(rows), 1)), np.repeat(rows, len(part), axis=0))
                out[i : i + len(rows)] &= ~met.reshape(len(rows), len(part)).any(axis=1)
        first = np.searchsorted(number, number)
        earlier = np.arange(len(coords)) - first
        late = np.repeat(np.arange(len(coords)), earlier)
        early = np.arange(len(late)) - np.repeat(np.cumsum(earlier) - earlier, earlier) + np.repeat(first, earlier)
        met = hits(coords[early], coords[late])
        for i, j in zip(early[met].tolist(), late[met].tolist()):  # by rising j: an earlier row is settled before it counts
            if out[i]:
                out[j] = False
        return out

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, np.empty((0, 4))
        for pdf in batches:
            for low in range(0, len(pdf), _AT_ONCE):
                part = pdf.iloc[low : low + _AT_ONCE]
                coords = part[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float)
                frames = list(zip(*(part[k].to_list() for k in keys)))
                number = np.cumsum([0, *(a != b for a, b in zip(frames, frames[1:]))])
                flags = settle(coords, number, kept if frames[0] == current else np.empty((0, 4)))
                last = int(np.searchsorted(number, number[-1]))
                before = [kept] if frames[-1] == current and last == 0 else []
                current, kept = frames[-1], np.concatenate([*before, coords[last:][flags[last:]]])
                yield part[flags]

    return scan


def suppress_boxes(
    boxes: DataFrame,
    iou_limit: float = 0.35,
    contain_limit: float | None = 0.50,
    iou_inclusive: bool = True,
    keys: Sequence[str] = ("frame_id",),
    head: int = 256,
) -> DataFrame:
    """Non-maximum suppression per frame: the surviving boxes.

    A box without confidence ranks last.  The ``head`` most confident boxes of a
    frame are settled first.  Only a
    frame with more boxes has a rest; its boxes hit by a settled survivor are
    dropped in parallel, and the few left are settled among themselves.
    """
    from pyspark.sql import Window

    keys = list(keys)
    columns = boxes.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema)
    order = [F.desc_nulls_last("confidence"), F.col("box_id")]
    scan = _suppress_scan(keys, iou_limit, iou_inclusive, contain_limit)
    ranked = boxes.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    top = ranked.filter(F.col("_rank") <= head)
    first = sorted_scan(top.select(*columns), keys, order, scan, schema)
    cut = top.filter(F.col("_rank") == head).select(*keys)
    names = ("x1", "y1", "x2", "y2")
    settled = meet(first, cut, keys).groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("_kept"))

    def hits(k: Column) -> Column:
        a, b = G.box(), (k["x1"], k["y1"], k["x2"], k["y2"])
        inter = G.intersection(a, b)
        area, other = F.greatest(F.lit(1.0), G.area(a)), F.greatest(F.lit(1.0), G.area(b))
        iou = inter / (area + other - inter)
        hit = iou >= iou_limit if iou_inclusive else iou > iou_limit
        if contain_limit is not None:
            hit = hit | (inter / F.least(area, other) >= contain_limit)
        return hit & (inter > 0)

    rest = meet(ranked.filter(F.col("_rank") > head), settled, keys).filter(~F.exists("_kept", hits)).select(*columns)
    return first.unionByName(sorted_scan(rest, keys, order, scan, schema))

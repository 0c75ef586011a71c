"""Tracks: association of boxes over frames, summaries, merging, reading budget."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardstream.functions import geometry as G
from yardstream.functions.windows import busy_spells, meet, running_sum, sorted_scan
from yardstream.sources.tables import staged


def sample_frames(df: DataFrame, fps: float, target_fps: float, frame: str = "frame_number") -> DataFrame:
    """Every n-th frame, n = fps / target rounded half to even, at least 1."""
    step = max(1, round(fps / max(1.0, target_fps)))
    return df.filter(F.col(frame) % step == 0)


def _iou(boxes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """IoU of every box (rows) with every other box (columns)."""
    a, b = boxes[:, None, :], others[None, :, :]
    side = np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2])
    inter = np.maximum(0, side).prod(axis=2)
    size = lambda v: np.maximum(0, v[..., 2:] - v[..., :2]).prod(axis=2)
    union = size(a) + size(b) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def _proximity_scores(boxes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """IoU plus closeness of the centres; 0 where neither qualifies."""
    iou = _iou(boxes, others)
    a, b = boxes[:, None, :], others[None, :, :]
    size = np.maximum(1, np.maximum(a[..., 2:] - a[..., :2], b[..., 2:] - b[..., :2]))
    gap = np.abs((a[..., :2] + a[..., 2:]) / 2.0 - (b[..., :2] + b[..., 2:]) / 2.0) / size
    distance = np.sqrt((gap * gap).sum(axis=2))
    score = np.where(distance < 0.8, iou + np.maximum(0.0, (1.0 - distance) * 0.4), iou)
    return np.where((iou > 0.15) | (distance < 0.40), score, 0.0)


class _Tracks:
    """Live tracks of one video: parallel arrays in order of creation."""

    def __init__(self, velocity: bool) -> None:
        self.velocity = velocity
        self.ids: list[int] = []
        self.boxes = np.empty((0, 4))
        self.before = np.empty((0, 4))
        self.last = np.empty(0, dtype=np.int64)
        self.next_id = 1
        #: Whether a box ever had two best tracks, so that their order decided.
        self.tied = False

    def forget(self, oldest: int) -> None:
        live = self.last >= oldest
        if not live.all():
            self.ids = [t for t, keep in zip(self.ids, live) if keep]
            self.boxes, self.before, self.last = self.boxes[live], self.before[live], self.last[live]

    def frame(self, boxes: np.ndarray, number: int) -> list[int]:
        """Track ids for the boxes of one frame, each matched greedily in turn."""
        if self.velocity:
            shift = self.boxes[:, :2] - self.before[:, :2]
            scores = _iou(boxes, self.boxes + np.hstack([shift, shift]))
            scores[scores <= 0.2] = 0.0
        else:
            scores = _proximity_scores(boxes, self.boxes)
        owners, fresh = [], []
        for i, box in enumerate(boxes):
            best = int(scores[i].argmax()) if scores.shape[1] else -1
            if best >= 0 and scores[i, best] > 0.0:
                self.tied = self.tied or int(np.count_nonzero(scores[i] == scores[i, best])) > 1
                scores[:, best] = 0.0
                owners.append(self.ids[best])
                self.before[best] = self.boxes[best]
                self.boxes[best] = box
                self.last[best] = number
            else:
                owners.append(self.next_id)
                fresh.append(i)
                self.ids.append(self.next_id)
                self.next_id += 1
        if fresh:
            new = boxes[fresh]
            self.boxes = np.vstack([self.boxes, new])
            self.before = np.vstack([self.before, new])
            self.last = np.append(self.last, [number] * len(fresh))
        return owners

    def state(self) -> list[list]:
        """[id, what the future depends on] of each live track, in order of creation."""
        parts = [self.last[:, None], self.boxes, *([self.before] if self.velocity else [])]
        return [[t, *row] for t, row in zip(self.ids, np.hstack(parts).tolist())]

    def resume(self, state: list[list]) -> None:
        """Go on from a state: its tracks are numbered from 1 in order."""
        rows = np.array([row[1:] for row in state], dtype=float).reshape(len(state), 9 if self.velocity else 5)
        self.ids, self.next_id = list(range(1, len(state) + 1)), len(state) + 1
        self.last, self.boxes = rows[:, 0].astype(np.int64), rows[:, 1:5]
        self.before = rows[:, 5:].copy() if self.velocity else self.boxes.copy()


#: Columns that the tracker adds to the rows it reads and writes.
_READ = "_f long, _spell long, _chunk long, _warm boolean, _seed string"
_WRITTEN = "_local long, _summary string"


def _track_chunks(velocity: bool, frame_step: int, alive: int, video: str):
    """Rows of (video, spell, chunk) in order -> own rows with the chunk's own track number, and a summary row per chunk.

    A chunk starts from the state in its seed row, or from nothing with the
    frames before it as a warm-up.  The summary holds the live tracks before its
    first own frame and after its last one.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tracks, entry, rest = None, None, None, None
        ended: list[dict] = []

        def finish() -> None:
            if entry is not None:
                text = json.dumps({**entry, "fresh": tracks.next_id - 1 - entry["warm"], "tied": tracks.tied, "exit": tracks.state()})
                ended.append({video: current[0], "_spell": current[1], "_chunk": current[2], "_summary": text})

        def frames(rows: pd.DataFrame, whole: bool) -> Iterator[pd.DataFrame]:
            """Match the frames of ``rows``; unless these are the last ones, the last frame waits for what follows."""
            nonlocal current, tracks, entry, rest
            marks = [rows[c].astype(object).where(rows[c].notna(), None).to_numpy() for c in (video, "_spell", "_chunk", "_f")]
            starts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([m[1:] != m[:-1] for m in marks])]))
            limits = [*starts.tolist(), len(rows)]
            end = limits[-1] if whole else limits[-2]
            boxes, seed, warm = rows[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float), rows["_seed"].to_numpy(), rows["_warm"].to_numpy(dtype=bool)
            local, own = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
            for lo, hi in zip(limits, limits[1:]):
                if lo >= end:
                    break
                key, number = tuple(m[lo] for m in marks[:3]), int(marks[3][lo])
                if key != current:
                    finish()
                    current, tracks, entry = key, _Tracks(velocity), None
                if isinstance(seed[lo], str):
                    tracks.resume(json.loads(seed[lo]))
                    lo += 1
                if lo == hi:
                    continue
                tracks.forget(number - frame_step - alive)
                if not warm[lo] and entry is None:
                    entry = {"first": number, "warm": tracks.next_id - 1, "entry": tracks.state()}
                    tracks.tied = False
                local[lo:hi], own[lo:hi] = tracks.frame(boxes[lo:hi], number), not warm[lo]
            rest = rows.iloc[end:]
            if own.any():
                yield rows[own].assign(_local=local[own], _summary=None)
            if ended:
                yield pd.DataFrame({c: pd.Series([row.get(c) for row in ended], dtype=object) for c in [*rows.columns, "_local", "_summary"]})
                ended.clear()

        for batch in batches:
            if len(batch):
                yield from frames(batch if rest is None or rest.empty else pd.concat([rest, batch]), False)
        if rest is not None:
            columns = [*rest.columns, "_local", "_summary"]
            if len(rest):
                yield from frames(rest, True)
            finish()
            if ended:
                yield pd.DataFrame({c: pd.Series([row.get(c) for row in ended], dtype=object) for c in columns})

    return scan


def _stitch(velocity: bool, frame_step: int, alive: int, video: str):
    """Summaries of a spell in order -> what each chunk's track numbers are, or the state that it has to start from.

    A chunk holds when its first state is the last one of the chunk before: the
    same live tracks, in the same order or without a tie in which order would
    have decided.  Otherwise the chunk is asked for again with the right state;
    what follows is judged as if it ended in the same state.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, live, created = None, [], 0
        for batch in batches:
            out = []
            keys = batch[[video, "_spell"]].astype(object).where(lambda x: x.notna(), None)
            for v, spell, chunk, attempt, text in zip(keys[video], keys["_spell"], batch["_chunk"], batch["_try"], batch["_summary"]):
                if (v, spell) != current:
                    current, live, created = (v, spell), [], 0
                own = json.loads(text)
                before = sorted(t for t in live if t[1] >= own["first"] - frame_step - alive)  # by number: in order of creation
                held = {tuple(t[1:]): t[0] for t in before}
                found = [tuple(t[1:]) for t in own["entry"]]
                same = len(held) == len(before) == len(found) == len(set(found)) and held.keys() == set(found)
                holds = [t[1:] for t in own["entry"]] == [t[1:] for t in before] or (same and not own["tied"])
                numbers = {t[0]: held.get(tuple(t[1:])) for t in own["entry"]} if not holds or same else {t[0]: b[0] for t, b in zip(own["entry"], before)}
                out.append((v, spell, chunk, attempt, created, own["warm"], json.dumps(numbers), None if holds else json.dumps(before), created + own["fresh"]))
                after = [[numbers.get(t[0]) if t[0] <= own["warm"] else created + t[0] - own["warm"], *t[1:]] for t in own["exit"]]
                live = [t for t in after if t[0] is not None]
                created += own["fresh"]
            yield pd.DataFrame(out, columns=[video, "_spell", "_chunk", "_try", "_created", "_warm_tracks", "_numbers", "_seed", "_total"])

    return scan


def assign_tracks(
    detections: DataFrame,
    mode: str = "proximity",
    max_missed: int | None = None,
    frame_step: int = 1,
    video: str = "video_id",
    frame: str = "frame_index",
    chunk_frames: int = 4096,
) -> DataFrame:
    """Add ``track_id``: detections of one vehicle over the frames of a video.

    ``proximity`` scores overlap plus centre distance (30 missed frames allowed,
    0 for live view); ``velocity`` compares with the linearly moved box (10).
    A null video is a video like others.

    Association is sequential inside a video, but no track outlives a pause of
    more than ``max_missed`` frames: spells between pauses are independent.  A
    spell is cut into chunks of about ``chunk_frames`` frames that run in parallel, each
    from nothing a few track lives before its start.  Where the live tracks at
    a border are those of the chunk before - nearly always, since what is not
    seen fades - the chunk holds; the others run again from the right state,
    until all borders meet.  The result is that of one scan over the video.
    """
    spark = detections.sparkSession
    velocity = mode == "velocity"
    missed = (10 if velocity else 30) if max_missed is None else max_missed
    alive = missed * frame_step if velocity else missed
    warm = 4 * (alive + frame_step)
    width = max(chunk_frames * frame_step, 2 * warm)
    names = detections.columns
    rows = detections.withColumn("_f", F.col(frame).cast("long"))
    rows = busy_spells(rows, [video], "_f", alive + frame_step, 100_000, "_spell")
    rows = staged(rows.withColumn("_chunk", F.floor((F.col("_f") - F.col("_spell")) / width)), "track-rows")
    plain = [f"{f.name} {f.dataType.simpleString()}" for f in detections.schema]
    schema = ", ".join([*plain, _READ, _WRITTEN])
    order = [F.col("_f"), F.col("_seed").isNull(), F.desc("confidence"), F.col("box_id")]
    scan = _track_chunks(velocity, frame_step, alive, video)
    run = lambda df, n: staged(sorted_scan(df, [video, "_spell", "_chunk"], order, scan, schema).withColumn("_try", F.lit(n)), "tracked")

    ends = (F.col("_f") - F.col("_spell")) % width >= width - warm
    places = F.when(ends, F.array(F.struct(F.col("_chunk").alias("c"), F.lit(False).alias("w")), F.struct((F.col("_chunk") + 1).alias("c"), F.lit(True).alias("w")))).otherwise(
        F.array(F.struct(F.col("_chunk").alias("c"), F.lit(False).alias("w"))))
    both = rows.withColumn("_at", F.explode(places)).select(*names, "_f", "_spell", F.col("_at.c").alias("_chunk"), F.col("_at.w").alias("_warm"), F.lit(None).cast("string").alias("_seed"))
    runs, attempt = run(both, 0), 0
    key = [video, "_spell", "_chunk"]
    kind = detections.schema[video].dataType.simpleString()
    while True:
        latest = Window.partitionBy(*key).orderBy(F.desc("_try"))
        summaries = runs.filter("_summary is not null").select(*key, "_try", "_summary").withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")
        plan = staged(sorted_scan(summaries, [video, "_spell"], ["_chunk"], _stitch(velocity, frame_step, alive, video),
                                  f"{video} {kind}, _spell long, _chunk long, _try int, _created long, _warm_tracks long, _numbers string, _seed string, _total long"), "track-plan")
        again = plan.filter("_seed is not null").select(*key, "_seed")
        if again.isEmpty():
            break
        attempt += 1
        own = meet(rows, again.drop("_seed"), key).select(*names, "_f", "_spell", "_chunk", F.lit(False).alias("_warm"), F.lit(None).cast("string").alias("_seed"))
        first = again.join(own.groupBy(*key).agg(F.min("_f").alias("_f")).select(F.col(video).alias("_v"), F.col("_spell").alias("_s"), F.col("_chunk").alias("_c"), "_f"),
                           F.col(video).eqNullSafe(F.col("_v")) & (F.col("_spell") == F.col("_s")) & (F.col("_chunk") == F.col("_c")))
        filled = {video: F.col(video), "_f": F.col("_f"), "_spell": F.col("_spell"), "_chunk": F.col("_chunk"), "_warm": F.lit(False), "_seed": F.col("_seed")}
        seeds = first.select(*[filled.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in own.schema])
        runs = runs.unionByName(run(own.unionByName(seeds), attempt))

    total = plan.groupBy(video, "_spell").agg(F.max("_total").alias("_n"))
    earlier = Window.partitionBy(video).orderBy("_spell").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(video, "_spell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    placed = meet(plan.drop("_seed", "_total"), offset, [video, "_spell"])
    own_number = F.when(F.col("_local") > F.col("_warm_tracks"), F.col("_created") + F.col("_local") - F.col("_warm_tracks")).otherwise(
        F.element_at(F.from_json("_numbers", "map<string, long>"), F.col("_local").cast("string")))
    return meet(runs.filter("_summary is null"), placed, [*key, "_try"]).select(*names, (own_number + F.col("_offset")).alias("track_id"))


# --- summaries ---------------------------------------------------------------------
def dominant_class(df: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """Most frequent class per key; ties go to the class seen first."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(
        F.max_by(label, F.struct("_n", -F.col("_first"))).alias("dominant_class"), F.sum("_n").alias("frames_seen")
    )


def track_summary(df: DataFrame, keys: list[str], frame: str = "frame_number", confidence: str = "ocr_confidence") -> DataFrame:
    last = F.max_by(F.struct("x1", "y1", "x2", "y2"), F.col(frame))
    return df.groupBy(*keys).agg(
        F.min(frame).alias("first_seen_frame"), F.max(frame).alias("last_seen_frame"), F.count("*").alias("frames_seen"),
        F.max(confidence).alias("vehicle_confidence"), last.alias("_b"),
    ).select(*keys, "first_seen_frame", "last_seen_frame", "frames_seen", "vehicle_confidence", "_b.*")


def class_counts(df: DataFrame, keys: list[str], label: str, order: str = "frame_number") -> DataFrame:
    """Rows (keys, class, n, first frame): the mergeable form of a class counter."""
    return df.groupBy(*keys, F.col(label).alias("vehicle_class")).agg(F.count("*").alias("n"), F.min(order).alias("first_frame"))


def merge_tracks(tracks: DataFrame, counts: DataFrame) -> DataFrame:
    """Merge the tracks of a video that carry the same plate.

    ``tracks`` has one row per track, ``counts`` its class counter rows.  The
    canonical track has the highest final confidence, reader confidence and
    frame count; merged classes are summed.  Ties go to the class the canonical
    track saw first, then to the earliest track.
    """
    group = ["video_id", "plate_number"]
    rank = F.struct("final_confidence", "ocr_confidence", "frames_seen", -F.col("track_id"))
    merged = tracks.groupBy(*group).agg(
        F.max_by("track_id", rank).alias("track_id"),
        F.min("first_seen_frame").alias("first_seen_frame"), F.max("last_seen_frame").alias("last_seen_frame"),
        F.sum("frames_seen").alias("frames_seen"), F.max("vehicle_confidence").alias("vehicle_confidence"),
        F.max("final_confidence").alias("final_confidence"), F.count("*").alias("merged_tracks"),
    )
    # the counters of a group next to its canonical track
    member = tracks.select("track_id", *group).join(merged.select(*group, F.col("track_id").alias("_canonical")), group)
    own = (F.col("track_id") == F.col("_canonical")).cast("int")
    per_class = counts.join(member, "track_id").groupBy(*group, "vehicle_class").agg(
        F.sum("n").alias("_n"), F.max(F.struct(own, F.when(own == 1, -F.col("first_frame")).otherwise(-F.col("track_id")), -F.col("first_frame"))).alias("_early")
    )
    top = per_class.groupBy(*group).agg(F.max_by("vehicle_class", F.struct("_n", "_early")).alias("vehicle_class"))
    return merged.join(top, group)


def rank_detections(tracks: DataFrame) -> DataFrame:
    """Add ``detection_no``: plated tracks first, then confidence, vehicle confidence, frames."""
    has_plate = (F.length(F.coalesce("plate_number", F.lit(""))) >= 4).cast("int")
    df = tracks.withColumns({
        "_1": -has_plate, "_2": -F.col("final_confidence"), "_3": -F.col("vehicle_confidence"), "_4": -F.col("frames_seen")
    })
    bucket = F.floor((F.col("_1") * 2 + F.col("_2")) * 50)
    df = running_sum(df, ["video_id"], ["_1", "_2", "_3", "_4", "track_id"], F.lit(1), bucket, "detection_no")
    return df.drop("_1", "_2", "_3", "_4")


def merge_frame_predictions(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row per frame number of a merged group: the prediction of its earliest track."""
    first = F.min_by(F.struct("track_id", "plate_number", "confidence"), F.col("track_id"))
    return frames.groupBy(*keys, "frame_number").agg(first.alias("_p")).select(*keys, "frame_number", "_p.*")


def last_observations(df: DataFrame, keys: list[str], order: str, n: int = 30) -> DataFrame:
    """The newest ``n`` rows per key (limited per partition before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _near(k: Column, width: float, height: float) -> Column:
    """Whether box ``k`` and the row's box are at one place: enough overlap, or close centres."""
    a, b = G.box(), (k["x1"], k["y1"], k["x2"], k["y2"])
    (ax, ay), (bx, by) = G.center(a), G.center(b)
    return (G.iou(a, b) > 0.20) | ((F.abs(ax - bx) / width < 0.22) & (F.abs(ay - by) / height < 0.35))


def _cells(low: tuple[Column, Column], high: tuple[Column, Column], width: float, height: float) -> Column:
    """The grid cells (0.22 widths by 0.35 heights) between two points."""
    index = lambda v, size: F.floor(v / size).cast("long")
    xs = F.sequence(index(low[0], width * 0.22), index(high[0], width * 0.22))
    ys = F.sequence(index(low[1], height * 0.35), index(high[1], height * 0.35))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("px"), y.alias("py")))))


def _first_confirmed(plateless: DataFrame, confirmed: DataFrame, width: float, height: float, block: int) -> DataFrame:
    """``plateless`` with ``_hit`` (position, owner): the first confirmed track of its video at the same place.

    Two centres in one grid cell are always at one place, so the first track of
    the own cell is a hit, and of the other cells in reach only packs of tracks
    with an earlier position are looked at.  A pack spans 16 * ``block`` positions.
    """
    cx, cy = G.center(G.box())
    place = ["video_id", "px", "py"]
    cell = [F.floor(cx / (width * 0.22)).cast("long").alias("px"), F.floor(cy / (height * 0.35)).cast("long").alias("py")]
    columns = plateless.columns
    item = F.struct("position", F.col("track_id").alias("owner"), "x1", "y1", "x2", "y2")
    placed = confirmed.select("video_id", "track_id", "position", "x1", "y1", "x2", "y2", *cell)
    own = placed.groupBy(*place).agg(F.min(F.struct("position", F.col("track_id").alias("owner"))).alias("_own"))
    bare = plateless.select(*columns, *cell).join(own, place, "left").select(*columns, "_own")
    # Overlap above 0.2 means: no side more than five times the other's, and centres at most two of the own sides apart.
    rx, ry = F.greatest(F.lit(width * 0.22), 2 * (F.col("x2") - F.col("x1"))), F.greatest(F.lit(height * 0.35), 2 * (F.col("y2") - F.col("y1")))
    cells = _cells((cx - rx, cy - ry), (cx + rx, cy + ry), width, height)
    reach = bare.select("video_id", "track_id", "x1", "y1", "x2", "y2", "_own", F.explode(cells).alias("_c")).select("*", "_c.*").drop("_c")
    # Of a cell only those count that are earlier than the sure hit of some track in reach.
    limits = reach.groupBy(*place).agg(F.max(F.coalesce("_own.position", F.lit((1 << 63) - 1))).alias("_limit"))
    early = placed.join(limits, place).filter(F.col("position") < F.col("_limit"))
    finer = [F.floor(4 * cx / (width * 0.22)).alias("_fx"), F.floor(4 * cy / (height * 0.35)).alias("_fy")]
    packs = early.groupBy(*place, *finer, F.floor(F.col("position") / (16 * block)).alias("_part")).agg(
        F.collect_list(item).alias("_pack"), F.min("position").alias("_first"), F.min("x1").alias("_x1"), F.min("y1").alias("_y1"), F.max("x2").alias("_x2"), F.max("y2").alias("_y2"),
        F.min(cx).alias("_cx1"), F.max(cx).alias("_cx2"), F.min(cy).alias("_cy1"), F.max(cy).alias("_cy2"))
    touches = (F.col("x1") < F.col("_x2")) & (F.col("x2") > F.col("_x1")) & (F.col("y1") < F.col("_y2")) & (F.col("y2") > F.col("_y1"))
    around = cx.between(F.col("_cx1") - width * 0.22, F.col("_cx2") + width * 0.22) & cy.between(F.col("_cy1") - height * 0.35, F.col("_cy2") + height * 0.35)
    hit = F.array_min(F.transform(F.filter("_pack", lambda k: _near(k, width, height)), lambda k: F.struct(k["position"].alias("position"), k["owner"].alias("owner"))))
    found = (
        reach.join(packs, place).filter((F.col("_own").isNull() | (F.col("_first") < F.col("_own.position"))) & (touches | around))
        .withColumn("_in", hit).filter("_in is not null").groupBy("video_id", "track_id").agg(F.min("_in").alias("_in"))
    )
    return bare.join(found, ["video_id", "track_id"], "left").select(*columns, F.least("_own", "_in").alias("_hit"))


def _first_apart(tracks: DataFrame, width: float, height: float) -> DataFrame:
    """Of the tracks of a video, taken by track_id, those at no place of one taken before: (video_id, track_id, box).

    Rounds: a track that is the earliest in every grid cell it reaches is
    taken, and what is at its place goes.  Two earliest tracks share no cell,
    so none of them touches another, and a round is two aggregates by (video,
    cell) and one join with at most one taken track per cell.
    """
    cx, cy = G.center(G.box())
    low = F.least(F.col("x1"), cx - width * 0.11), F.least(F.col("y1"), cy - height * 0.175)
    high = F.greatest(F.col("x2"), cx + width * 0.11), F.greatest(F.col("y2"), cy + height * 0.175)
    names = ["video_id", "track_id", "x1", "y1", "x2", "y2"]
    left, taken = staged(tracks.select(*names, _cells(low, high, width, height).alias("_cells")), "places"), None
    while not left.isEmpty():
        by_cell = left.select(*names, F.size("_cells").alias("_n"), F.explode("_cells").alias("_cell"))
        least = by_cell.groupBy("video_id", "_cell").agg(F.min("track_id").alias("track_id"))
        # one row per cell: a track that leads all its cells is taken
        lead = least.groupBy("video_id", "track_id").agg(F.count("*").alias("_lead"))
        now = staged(left.join(lead, ["video_id", "track_id"]).filter(F.col("_lead") == F.size("_cells")).select(*names, "_cells"), "places-taken")
        taken = now if taken is None else taken.unionAll(now)
        owners = now.select("video_id", F.struct("track_id", "x1", "y1", "x2", "y2").alias("_k"), F.explode("_cells").alias("_cell"))
        gone = by_cell.join(owners, ["video_id", "_cell"]).filter(_near(F.col("_k"), width, height) | (F.col("track_id") == F.col("_k.track_id"))).select("video_id", "track_id").distinct()
        left = staged(left.join(gone, ["video_id", "track_id"], "left_anti"), "places")
    return left.select(*names, "_cells") if taken is None else taken


def attach_plateless(plateless: DataFrame, confirmed: DataFrame, width: float, height: float, block: int = 64) -> DataFrame:
    """Add ``merged_into`` and ``is_kept`` to plate-less tracks (video_id, track_id, frames_seen, box).

    In order of track_id, a track goes to the first track at its place: of the
    confirmed ones by ``position``, then of the plate-less ones kept so far.
    Without one it is kept if it was seen in two frames, and takes in later
    ones; seen once, it is dropped.  Every track has video_id, track_id and a box.
    """
    columns = plateless.columns
    first = staged(_first_confirmed(plateless, confirmed, width, height, block), "plateless")
    open_ = first.filter("_hit is null")
    kept = _first_apart(open_.filter("frames_seen >= 2"), width, height)
    cx, cy = G.center(G.box())
    low = F.least(F.col("x1"), cx - width * 0.11), F.least(F.col("y1"), cy - height * 0.175)
    high = F.greatest(F.col("x2"), cx + width * 0.11), F.greatest(F.col("y2"), cy + height * 0.175)
    reach = open_.select("video_id", "track_id", "x1", "y1", "x2", "y2", F.explode(_cells(low, high, width, height)).alias("_cell"))
    places = kept.select("video_id", F.struct("track_id", "x1", "y1", "x2", "y2").alias("_k"), F.explode("_cells").alias("_cell"))
    joined = reach.join(places, ["video_id", "_cell"]).filter((F.col("_k.track_id") <= F.col("track_id")) & ((F.col("_k.track_id") == F.col("track_id")) | _near(F.col("_k"), width, height)))
    owner = joined.groupBy("video_id", "track_id").agg(F.min("_k.track_id").alias("_kept"))
    return first.join(owner, ["video_id", "track_id"], "left").select(
        *columns, F.coalesce("_hit.owner", F.when(F.col("_kept") != F.col("track_id"), F.col("_kept"))).alias("merged_into"),
        (F.col("_hit").isNull() & F.coalesce(F.col("_kept") == F.col("track_id"), F.lit(False))).alias("is_kept"),
    )


def consolidate_tracks(plateless: DataFrame, confirmed: DataFrame, width: float, height: float, block: int = 64) -> DataFrame:
    """The tracks left after ``attach_plateless``, with what they took in.

    Both inputs also have first_seen_frame, last_seen_frame, frames_seen and
    vehicle_confidence: an owner gets the least, the largest, the sum and the
    largest of its own and its merged tracks'; ``merged_tracks`` counts them all.
    """
    facts = "first_seen_frame", "last_seen_frame", "frames_seen", "vehicle_confidence"
    attached = staged(attach_plateless(plateless, confirmed, width, height, block), "attached")
    own = confirmed.select("video_id", "track_id", *facts, F.lit(True).alias("has_plate"))
    rows = own.unionByName(attached.filter("is_kept").select("video_id", "track_id", *facts, F.lit(False).alias("has_plate")))
    taken = attached.filter("merged_into is not null").select("video_id", F.col("merged_into").alias("track_id"), *facts, F.lit(None).cast("boolean").alias("has_plate"))
    return rows.unionByName(taken).groupBy("video_id", "track_id").agg(
        F.max("has_plate").alias("has_plate"), F.min("first_seen_frame").alias("first_seen_frame"), F.max("last_seen_frame").alias("last_seen_frame"),
        F.sum("frames_seen").alias("frames_seen"), F.max("vehicle_confidence").alias("vehicle_confidence"), F.count("*").alias("merged_tracks"),
    )


def reading_budget(
    df: DataFrame,
    max_attempts: int = 4,
    max_reads: int = 3,
    cooldown_ms: int = 400,
    frame_gap: int = 2,
    track: str = "track_id",
) -> DataFrame:
    """Add ``run_ocr``: whether a frame of a track is worth reading.

    Needs ``t_ms``, ``frame_number``, ``has_text`` and ``confirms``: what a
    reading would give (null: nothing); (t_ms, frame_number) identifies a frame
    of a track.  Stops when confirmed or the budget is used up.

    An attempt is the first frame allowed after the attempt before, so a round
    is one minimum per track, pre-aggregated before the shuffle, whatever the
    track's length.  A null track is a track like others.
    """
    when = F.struct("t_ms", "frame_number")
    frame = F.struct("t_ms", "frame_number", F.coalesce("has_text", F.lit(False)).alias("has_text"), F.coalesce("confirms", F.lit(False)).alias("confirms"))
    state = df.groupBy(track).agg(F.min_by(frame, when).alias("p"))
    state = state.select(
        track, F.array(F.struct("p.t_ms", "p.frame_number")).alias("_picks"), F.col("p.has_text").cast("int").alias("_reads"),
        (F.col("p.has_text") & F.col("p.confirms")).alias("_done"),
    )
    for _ in range(max_attempts - 1):
        last = F.element_at("_picks", -1)
        open_ = ~F.col("_done") & (F.col("_reads") < max_reads)
        allowed = (F.col("t_ms") - last["t_ms"] >= cooldown_ms) & (F.col("frame_number") - last["frame_number"] >= frame_gap) & (when > last)
        found = meet(df, state, [track]).filter(open_ & allowed).groupBy(track).agg(F.min_by(frame, when).alias("p"))
        hit = F.col("p").isNotNull()
        state = meet(state, found, [track], "left").select(
            track,
            F.when(hit, F.array_append("_picks", F.struct("p.t_ms", "p.frame_number"))).otherwise(F.col("_picks")).alias("_picks"),
            (F.col("_reads") + F.coalesce(F.col("p.has_text").cast("int"), F.lit(0))).alias("_reads"),
            (F.col("_done") | F.coalesce(F.col("p.has_text") & F.col("p.confirms"), F.lit(False))).alias("_done"),
        )
    return meet(df, state.select(track, "_picks"), [track]).withColumn("run_ocr", F.array_contains("_picks", when)).drop("_picks")


def frames_per_second(df: DataFrame, ts: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """Frames per second of wall clock."""
    w = F.window(F.col(ts).cast("timestamp"), "1 second")
    return df.groupBy(*(keys or []), w.alias("w")).agg(F.count("*").alias("fps")).select(
        *(keys or []), F.col("w.start").cast("timestamp_ntz").alias("second"), "fps"
    )

"""Suppression and tracking against plain simulations."""

import random

import pytest
from pyspark.sql import functions as F

from yardstream.operators import boxes as B
from yardstream.operators import tracking as T


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0.0


def size(a):
    return max(1.0, (a[2] - a[0]) * (a[3] - a[1]))


def random_boxes(rng, n):
    out = []
    for i in range(n):
        x, y = rng.randrange(600), rng.randrange(300)
        out.append((i, float(x), float(y), float(x + 30 + rng.randrange(90)), float(y + 30 + rng.randrange(60)), round(rng.random(), 2)))
    return out


@pytest.mark.parametrize("head", [8, 256])
@pytest.mark.parametrize("contain", [0.5, None])
def test_suppression_with_a_crowded_frame(spark, head, contain):
    rng = random.Random(3)
    frames = {0: random_boxes(rng, 400), 1: random_boxes(rng, 12), 2: random_boxes(rng, 8)}
    df = spark.createDataFrame([(f, *b) for f, bs in frames.items() for b in bs], "frame_id long, box_id int, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = {(r.frame_id, r.box_id) for r in B.suppress_boxes(df, 0.35, contain, head=head).collect()}
    want = set()
    for f, bs in frames.items():
        kept = []
        for b in sorted(bs, key=lambda b: (-b[5], b[0])):
            def clash(k):
                inter = overlap(b[1:5], k[1:5])
                return inter > 0 and (inter / (size(b[1:5]) + size(k[1:5]) - inter) >= 0.35 or (contain is not None and inter / min(size(b[1:5]), size(k[1:5])) >= contain))
            if not any(clash(k) for k in kept):
                kept.append(b)
        want |= {(f, b[0]) for b in kept}
    assert got == want


def simulate(dets, missed, velocity):
    """Frame by frame association; tracks live in a list of [id, box, earlier box, frame]."""
    owners, live, count = {}, [], 0
    for frame in sorted({d[0] for d in dets}):
        live = [t for t in live if frame - 1 - t[3] <= missed]
        used, born = set(), []
        for d in sorted((d for d in dets if d[0] == frame), key=lambda d: (-d[6], d[1])):
            box, best, top = d[2:6], None, 0.0
            for t in live:
                if t[0] in used:
                    continue
                ref = t[1]
                if velocity:
                    dx, dy = t[1][0] - t[2][0], t[1][1] - t[2][1]
                    ref = (ref[0] + dx, ref[1] + dy, ref[2] + dx, ref[3] + dy)
                inter = overlap(box, ref)
                area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
                iou = inter / (area(box) + area(ref) - inter)
                if velocity:
                    score, fits = iou, iou > 0.2
                else:
                    dx = abs(box[0] + box[2] - ref[0] - ref[2]) / 2 / max(1, box[2] - box[0], ref[2] - ref[0])
                    dy = abs(box[1] + box[3] - ref[1] - ref[3]) / 2 / max(1, box[3] - box[1], ref[3] - ref[1])
                    gap = (dx * dx + dy * dy) ** 0.5
                    score, fits = iou + max(0.0, (1 - gap) * 0.4) if gap < 0.8 else iou, iou > 0.15 or gap < 0.4
                if fits and score > top:
                    best, top = t, score
            if best is None:
                count += 1
                born.append([count, box, box, frame])
                owners[frame, d[1]] = count
            else:
                used.add(best[0])
                best[2], best[1], best[3] = best[1], box, frame
                owners[frame, d[1]] = best[0]
        live += born
    return owners


@pytest.mark.parametrize("mode,missed", [("proximity", 30), ("proximity", 0), ("velocity", 10)])
def test_tracking(spark, mode, missed):
    rng = random.Random(7)
    videos = {}
    for v in range(3):
        dets, frame = [], 0
        cars = [[rng.randrange(500), rng.randrange(250), rng.randrange(-9, 10), rng.randrange(-5, 6)] for _ in range(6)]
        for _ in range(30):
            frame += rng.choice([1, 1, 1, 2, 12, 45])
            for i, c in enumerate(cars):
                c[0], c[1] = c[0] + c[2], c[1] + c[3]
                if rng.random() < 0.8:
                    dets.append((frame, i, float(c[0]), float(c[1]), float(c[0] + 60), float(c[1] + 40), round(rng.random(), 3)))
        videos[v] = dets
    df = spark.createDataFrame([(v, *d) for v, ds in videos.items() for d in ds], "video_id long, frame_index int, box_id int, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = {(r.video_id, r.frame_index, r.box_id): r.track_id for r in T.assign_tracks(df, mode, max_missed=missed).collect()}
    want = {(v, *k): t for v, ds in videos.items() for k, t in simulate(ds, missed, mode == "velocity").items()}
    assert got == want


def crowded(frames, cars, seed, shared=False, grid=1):
    """Detections of one video without a pause: cars drift, cross, vanish and come back; ``grid`` makes equal scores likely."""
    rng = random.Random(seed)
    place = [[rng.randrange(400), rng.randrange(200), rng.randrange(-4, 5), rng.randrange(-3, 4)] for _ in range(cars)]
    dets = []
    for f in range(frames):
        for i, c in enumerate(place):
            c[0], c[1] = (c[0] + c[2]) % 400, (c[1] + c[3]) % 200
            if rng.random() < 0.7 or i == 0:
                x, y = float(c[0] // grid * grid), float(c[1] // grid * grid)
                dets.append((f, i, x, y, x + 60, y + 40, 0.5 if shared else round(rng.random(), 3)))
    return dets


@pytest.mark.parametrize("mode,missed", [("proximity", 30), ("proximity", 0), ("velocity", 10)])
@pytest.mark.parametrize("grid", [1, 40])
def test_chunks_of_a_video_without_pauses_equal_one_scan(spark, mode, missed, grid):
    videos = {v: crowded(1500, 5, v, shared=True, grid=grid) for v in (None, 1)}
    df = spark.createDataFrame([(v, *d) for v, ds in videos.items() for d in ds], "video_id long, frame_index int, box_id int, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = {(r.video_id, r.frame_index, r.box_id): r.track_id for r in T.assign_tracks(df, mode, max_missed=missed, chunk_frames=100).collect()}
    assert got == {(v, *k): t for v, ds in videos.items() for k, t in simulate(ds, missed, mode == "velocity").items()}


def test_borders_that_do_not_meet_run_again(spark, monkeypatch):
    """A box that stands still keeps what a warm-up can't know: two parked cars whose boxes are the same."""
    dets = [(f, i, 10.0 * (i // 2), 0.0, 50.0 + 10.0 * (i // 2), 40.0, 0.5) for f in range(2000) for i in range(4) if (f + i) % 3 or f < 5]
    df = spark.createDataFrame([(1, *d) for d in dets], "video_id long, frame_index int, box_id int, x1 double, y1 double, x2 double, y2 double, confidence double")
    rounds, stitch = [], T._stitch
    monkeypatch.setattr(T, "_stitch", lambda *a: rounds.append(1) or stitch(*a))
    got = {(r.frame_index, r.box_id): r.track_id for r in T.assign_tracks(df, max_missed=30, chunk_frames=100).collect()}
    assert got == simulate(dets, 30, False)
    assert len(rounds) > 1


def test_frame_step():
    assert [max(1, round(f / 6)) for f in (25, 30, 3)] == [4, 5, 1]


def at_one_place(a, b, width=1280.0, height=720.0):
    inter = overlap(a, b)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union > 0.20 or (abs(a[0] + a[2] - b[0] - b[2]) / 2 / width < 0.22 and abs(a[1] + a[3] - b[1] - b[3]) / 2 / height < 0.35)


def fold(bare, confirmed):
    """The rule in order, one track at a time: (merged_into, is_kept) by track, and the tracks left."""
    said, left = {}, {}
    for v in {r[0] for r in bare + confirmed}:
        have = [[*r] for r in sorted(confirmed, key=lambda r: r[-1]) if r[0] == v]
        for r in sorted(r for r in bare if r[0] == v):
            owner = next((k for k in have if at_one_place(r[6:10], k[6:10])), None)
            said[v, r[1]] = (owner[1] if owner else None, owner is None and r[4] >= 2)
            if owner:
                owner[2:6] = min(owner[2], r[2]), max(owner[3], r[3]), owner[4] + r[4], max(owner[5], r[5])
            elif r[4] >= 2:
                have.append([*r])
        left.update({(v, k[1]): tuple(k[2:6]) for k in have})
    return said, left


@pytest.mark.parametrize("area,size,block", [((3000, 2000), (80, 60), 1), ((9000, 7000), (900, 500), 64), ((1280, 720), (300, 50), 2)])
def test_plateless_tracks_against_the_ordered_fold(spark, area, size, block):
    rng = random.Random(11)
    schema = "video_id long, track_id long, first_seen_frame int, last_seen_frame int, frames_seen long, vehicle_confidence double, x1 double, y1 double, x2 double, y2 double"
    box = lambda x, y, w, h: (float(x), float(y), float(x + w), float(y + h))
    make = lambda n, base: [(rng.randrange(2), base + i, rng.randrange(50), 50 + rng.randrange(50), rng.randrange(1, 4), round(rng.random(), 3), *box(rng.randrange(-100, area[0]), rng.randrange(area[1]), rng.randrange(5, size[0]), rng.randrange(5, size[1]))) for i in range(n)]
    bare, confirmed = make(150, 1000), [(*r, (r[1] * 7) % 41) for r in make(40, 0)]
    sides = spark.createDataFrame(bare, schema), spark.createDataFrame(confirmed, schema + ", position long")
    said, left = fold(bare, confirmed)
    got = {(r.video_id, r.track_id): (r.merged_into, r.is_kept) for r in T.attach_plateless(*sides, 1280.0, 720.0, block).collect()}
    assert got == said
    whole = {(r.video_id, r.track_id): (r.first_seen_frame, r.last_seen_frame, r.frames_seen, r.vehicle_confidence) for r in T.consolidate_tracks(*sides, 1280.0, 720.0, block).collect()}
    assert whole == left


def test_plateless_tracks_without_partners(spark):
    schema = "video_id long, track_id long, frames_seen long, x1 double, y1 double, x2 double, y2 double"
    bare, none = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 9.0, 9.0), (1, 2, 2, 0.0, 0.0, 9.0, 9.0), (1, 3, 1, 0.0, 0.0, 9.0, 9.0)], schema), spark.createDataFrame([], schema + ", position long")
    assert sorted((r.track_id, r.merged_into, r.is_kept) for r in T.attach_plateless(bare, none, 1280.0, 720.0).collect()) == [(1, None, False), (2, None, True), (3, 2, False)]
    assert T.attach_plateless(bare.limit(0), none, 1280.0, 720.0).collect() == []


def test_reading_budget_against_a_plain_scan(spark):
    rng = random.Random(9)
    rows = [(t, f, f * 130 + rng.randrange(100), rng.random() < 0.6, rng.random() < 0.2) for t in range(40) for f in range(60)]
    df = spark.createDataFrame(rows, "track_id long, frame_number int, t_ms long, has_text boolean, confirms boolean")
    want, state = [], {}
    for t, f, ms, text, confirms in rows:
        n, reads, done, last_ms, last_f = state.get(t, (0, 0, False, -(10**9), -(10**9)))
        read = not done and n < 4 and reads < 3 and ms - last_ms >= 400 and f - last_f >= 2
        if read:
            state[t] = n + 1, reads + text, done or (text and confirms), ms, f
        want.append((t, f, read))
    assert sorted(map(tuple, T.reading_budget(df).select("track_id", "frame_number", "run_ocr").collect())) == sorted(want)
    assert sum(r for _, _, r in want) > 80


def test_suppression_compares_many_rows_at_once(monkeypatch):
    """Few array calls for many boxes, and the result of the plain rule, across frames, batches and pieces."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    frame = np.sort(np.concatenate([rng.integers(0, 300, 3000), np.full(2600, 150)]))
    xy = rng.integers(0, 300, (len(frame), 2)).astype(float)
    rows = pd.DataFrame({"frame_id": frame, "x1": xy[:, 0], "y1": xy[:, 1], "x2": xy[:, 0] + rng.integers(0, 90, len(frame)), "y2": xy[:, 1] + rng.integers(1, 60, len(frame))})

    def plain(least, inclusive, contain):
        kept, out = {}, []
        for f, *b in rows.itertuples(index=False):
            good = True
            for a in kept.setdefault(f, []):
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                inter = w * h if w > 0 and h > 0 else 0.0
                p, q = (max(1.0, (c[2] - c[0]) * (c[3] - c[1])) for c in (b, a))
                iou = inter / (p + q - inter)
                if inter > 0 and ((iou >= least if inclusive else iou > least) or (contain is not None and inter / min(p, q) >= contain)):
                    good = False
                    break
            if good:
                kept[f].append(b)
            out.append(good)
        return rows[out]

    for limits in ((0.35, True, 0.5), (0.5, False, None)):
        cuts = [0, 1, 700, 1500, 4100, len(rows)]
        got = pd.concat(B._suppress_scan(["frame_id"], *limits)(rows.iloc[a:b] for a, b in zip(cuts, cuts[1:])))
        assert got.equals(plain(*limits))
    calls, real = [], np.minimum
    monkeypatch.setattr(np, "minimum", lambda *a, **k: calls.append(1) or real(*a, **k))
    few = rows[rows.frame_id < 100]
    list(B._suppress_scan(["frame_id"], 0.35, True, 0.5)([few]))
    assert len(calls) < len(few) / 50

"""Stream states in buckets of keys: few calls of the state store for many keys."""

from types import SimpleNamespace

from pyspark.sql import Row

from yardstream.streaming.board import _Overstay
from yardstream.streaming.observations import _FIELDS, _Buffer
from yardstream.streaming.passages import _LastAccepted


class Store:
    """A state store that counts the calls it gets."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def fire(self, processor, watermark):
        out = []
        while due := [t for t in sorted(self.timers) if t < watermark]:
            out += processor.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), None)
            self.timers.discard(due[0])
        return out


def started(processor):
    processor.init(Store())
    return processor, processor.handle


def test_overstay_of_many_trips():
    p, store = started(_Overstay())
    rows = [Row(trip_id=i, due_us=i * 1000, is_closed=False) for i in range(1000)] + [Row(trip_id=7, due_us=7000, is_closed=True), Row(trip_id=2000, due_us=None, is_closed=False)]
    assert list(p.handleInputRows((0,), iter(rows), None)) == [] and store.calls <= 5
    assert sorted(r.trip_id for r in store.fire(p, 500)) == [i for i in range(501) if i != 7]  # the one due at the watermark too
    assert list(p.handleInputRows((0,), iter([Row(trip_id=i, due_us=0, is_closed=True) for i in range(600, 1000)]), None)) == []
    assert sorted(r.trip_id for r in store.fire(p, 10_000)) == list(range(501, 600)) and store.value is None and not store.timers
    assert store.calls <= 25


def test_passages_of_many_plates():
    p, store = started(_LastAccepted(10_000, ["plate"], "id", ["id", "plate"]))
    rows = [Row(id=i + 1000 * k, plate=str(i), t_us=k * 8000, is_free=i == 5) for i in range(1000) for k in range(3)]
    out = {r.id: r.accepted_id for r in p.handleInputRows((0,), iter(rows), None)}
    assert all(out[i] == out[i + 1000] == i and out[i + 2000] == i + 2000 for i in range(1000) if i != 5) and store.calls <= 4
    assert all(out[i] == i for i in (5, 1005, 2005))
    assert [r.accepted_id for r in p.handleInputRows((0,), iter([Row(id=1, plate="1", t_us=20_000, is_free=False), Row(id=9, plate="x", t_us=None, is_free=False)]), None)] == [9, 2001]
    store.fire(p, 100)
    assert store.value is None


def test_reads_of_many_tracks():
    p, store = started(_Buffer(3, 10))
    rows = [Row(track_id=i, **dict(zip(_FIELDS, (f, "A", 0.5, 0.5, "car", i * 1000 + f, f != 4)))) for i in range(500) for f in range(5)]
    out = list(p.handleInputRows((0,), iter(rows), None))
    assert len(out) == 500 * 4 and {r.frame_number for r in out} == {1, 2, 3, 4} and store.calls <= 4
    closed = store.fire(p, 110)
    assert {r.track_id for r in closed} == set(range(100)) and all(r.closed for r in closed)

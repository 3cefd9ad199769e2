"""The tracker against a second one, written coordinate by coordinate: each of centre x, centre y and area moves by itself with its own velocity, the aspect stays; and cases of known outcome."""

import random
from functools import cache
from math import sqrt

import numpy as np
import pytest

from vigil.operators import folds


class Coordinate:
    """A place that moves with a velocity: mean and covariance of two numbers (velocity 0 for good, where noise_v is None)."""

    def __init__(self, x, moves, r, q, qv):
        self.x, self.v, self.moves, self.r, self.q, self.qv = x, 0.0, moves, r, q, qv
        self.a, self.b, self.c, self.gain = 10.0, 0.0, 1e4 if moves else 0.0, None

    def predict(self):
        self.x += self.v
        self.a, self.b, self.c = self.a + 2 * self.b + self.c + self.q, self.b + self.c, self.c + (self.qv if self.moves else 0)

    def update(self, z):
        if self.gain is None:  # that of the first update holds from then on
            self.gain = (self.a / (self.a + self.r), self.b / (self.a + self.r))
        d = z - self.x
        self.x, self.v = self.x + self.gain[0] * d, self.v + self.gain[1] * d


class Track:
    def __init__(self, number, box):
        x, y, w, h = box
        self.number, self.misses = number, 0
        self.parts = [Coordinate(x + w / 2, True, 1, 1, 0.01), Coordinate(y + h / 2, True, 1, 1, 0.01), Coordinate(w * h, True, 10, 1, 1e-4), Coordinate(w / h, False, 10, 1, 0)]

    def predict(self):
        area = self.parts[2]
        if area.x + area.v <= 0:
            area.v = 0.0
        for p in self.parts:
            p.predict()
        cx, cy, area, aspect = (p.x for p in self.parts)
        w = sqrt(max(area * aspect, 0))
        h = area / w if w > 0 else 0
        self.box = (cx - w / 2, cy - h / 2, w, h)

    def update(self, box):
        x, y, w, h = box
        for p, z in zip(self.parts, (x + w / 2, y + h / 2, w * h, w / h), strict=True):
            p.update(z)
        self.misses = 0


def overlap(a, b):
    """Of boxes that count their last pixel too."""
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]) + 1
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]) + 1
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] + 1) * (a[3] + 1) + (b[2] + 1) * (b[3] + 1) - both + 1e-5)


def cheapest(cost, n, m):
    """Pairs of least total cost, as many as there can be, by trying all."""

    @cache
    def best(i, used, skips):
        if i == n:
            return 0, ()
        found = []
        if skips:
            total, pairs = best(i + 1, used, skips - 1)
            found.append((total, pairs))
        for j in range(m):
            if not used >> j & 1:
                total, pairs = best(i + 1, used | 1 << j, skips)
                found.append((total + cost[i][j], ((i, j), *pairs)))
        return min(found)

    return best(0, 0, max(0, n - m))[1]


class Second:
    def __init__(self, least=0.3, misses=3):
        self.least, self.misses, self.tracks, self.made = least, misses, [], 0

    def step(self, boxes):
        for t in self.tracks:
            t.predict()
        cost = [[int(-100 * overlap(b, t.box)) for t in self.tracks] for b in boxes]
        of = {}
        for i, j in cheapest(cost, len(boxes), len(self.tracks)):
            if cost[i][j] <= int(-100 * self.least):
                of[i] = self.tracks[j]
        for t in self.tracks:
            t.misses += 1
        for i, t in of.items():
            t.update(boxes[i])
        self.tracks = [t for t in self.tracks if t.misses <= self.misses]
        for i, b in enumerate(boxes):
            if i not in of:
                self.made += 1
                of[i] = Track(self.made, b)
                self.tracks.append(of[i])
        return [of[i].number for i in range(len(boxes))]


@pytest.mark.parametrize("seed", range(12))
def test_moving_boxes_have_the_tracks_of_the_second_tracker(seed):
    """Objects that move, grow, shrink, hide for some frames, leave, and come anew; and boxes that are there once."""
    rnd = random.Random(seed)
    one, two = folds.Tracker(0.3, 3), Second(0.3, 3)
    things = [[rnd.uniform(0, 1500), rnd.uniform(0, 900), rnd.uniform(40, 200), rnd.uniform(40, 200), rnd.uniform(-9, 9), rnd.uniform(-9, 9), rnd.uniform(0.97, 1.03), i] for i in range(4)]
    boxes_of = []
    for _ in range(120):
        boxes = []
        for k, t in enumerate(things):
            t[0], t[1], t[2], t[3] = t[0] + t[4], t[1] + t[5], min(max(t[2] * t[6], 20), 300), min(max(t[3] * t[6], 20), 300)
            if rnd.random() < 0.02:
                things[k] = [rnd.uniform(0, 1500), rnd.uniform(0, 900), rnd.uniform(40, 200), rnd.uniform(40, 200), rnd.uniform(-9, 9), rnd.uniform(-9, 9), rnd.uniform(0.97, 1.03), t[7]]
            if rnd.random() > 0.15:
                boxes.append(tuple(x + rnd.uniform(-1, 1) for x in t[:4]))
        if rnd.random() < 0.1:
            boxes.append((rnd.uniform(0, 1500), rnd.uniform(0, 900), 30.0, 30.0))
        boxes_of.append(boxes)
    got = [one.step(np.array(b, float).reshape(-1, 4)) for b in boxes_of]
    assert got == [two.step(b) for b in boxes_of] and max(map(max, filter(None, got))) < sum(map(len, boxes_of)) / 3
    for mine, other in zip(one.tracks, two.tracks, strict=True):  # the numbers themselves
        assert np.allclose(mine["x"][[0, 1, 2, 3]], [p.x for p in other.parts], rtol=1e-6) and np.allclose(mine["x"][[4, 5, 6]], [p.v for p in other.parts[:3]], rtol=1e-5, atol=1e-6)


def numbers(frames, **options):
    tracker = folds.Tracker(**options)
    return [tracker.step(np.array(b, float).reshape(-1, 4)) for b in frames], tracker


def test_people_who_stay_and_one_who_is_seen_once():
    """Four people over five frames keep their tracks; a fifth, seen in one frame alone, has one of its own."""
    four = [[(1703 - 2 * i, 385, 157, 340), (1293, 455, 83, 213), (259 + 2 * i, 449, 101, 262), (1253 + i, 529, 55, 127)] for i in range(5)]
    four[2].append((429, 300, 55, 127))
    got, tracker = numbers(four)
    assert [g[:4] for g in got] == [[1, 2, 3, 4]] * 5 and got[2][4] == 5
    assert sum(t["misses"] == 0 for t in tracker.tracks) == 4


def test_two_that_cross_keep_their_tracks_and_end_when_all_is_empty():
    a, b = [(0.8, 0.3 + 0.05 * i, 0.1, 0.1) for i in range(5)], [(0.1 + 0.1 * i, 0.1 + 0.1 * i, 0.15, 0.15) for i in range(5)]
    got, tracker = numbers([[a[0], b[0]], [a[1], b[1]], [b[2], a[2]], [b[3], a[3]], [b[4], a[4]], [], [], [], [], []], overlap=0.2)
    assert got[:5] == [[1, 2], [1, 2], [2, 1], [2, 1], [2, 1]] and tracker.tracks == []


def scattered(sources, frames, steady=False):
    """Boxes here and there, which overlap now and then; and with steady one that is always there."""
    rnd, rows = random.Random(5), []
    for s in sources:
        for f in range(frames):
            for k in range(rnd.randrange(5)):
                rows.append((s, f, "boat", k, 0.5, rnd.randrange(300), rnd.randrange(200), rnd.randrange(30, 90), rnd.randrange(30, 90), [1.0, 0.5] if rnd.random() < 0.5 else [rnd.random() - 0.5, 1.0]))
            rows += [(s, f, "car", 9, 0.5, 600 + f % 3, 600, 50, 60, [0.0, 1.0])] if steady else []
    return rows


BOXES = "source_id string, frame_id long, label string, tracking_id int, confidence double, x int, y int, w int, h int, look array<double>"


@pytest.mark.parametrize("steady", [False, True])
@pytest.mark.parametrize("appearance", [False, True])
def test_blocks_of_frames_have_the_tracks_of_one_tracker(spark, steady, appearance, monkeypatch):
    """Blocks that go on alike are put together; sources of which that isn't true, as one object is always there, go through one tracker."""
    from vigil.operators.appearance import AppearanceTracker, appearance_tracks

    dets, want = spark.createDataFrame(scattered(("a", None), 400, steady), BOXES), []
    rows = sorted((tuple(r) for r in dets.collect()), key=lambda r: (str(r[0]), r[1], *r[5:9], *r[2:5]))
    for s in ("None", "a"):
        tracker, last = AppearanceTracker(threshold=0.6, streak=2, misses=4) if appearance else folds.Tracker(), None
        for f in sorted({r[1] for r in rows if str(r[0]) == s}):
            g = [r for r in rows if str(r[0]) == s and r[1] == f]
            boxes = np.array([r[5:9] for r in g], float)
            if not appearance:
                for _ in range(0 if last is None else min(f - last - 1, 4)):
                    tracker.step(np.zeros((0, 4)))
                last = f
            ids = tracker.step(boxes, np.array([r[9] for r in g])) if appearance else tracker.step(boxes)
            want += [(*r[1:9], f"{s}_{i}") for r, i in zip(g, ids, strict=True) if i]
    alone = []
    monkeypatch.setattr(folds, "_by_blocks", lambda rows, *a, plain=folds._by_blocks: alone.append(rows) or plain(rows, *a))
    cut = {"size": 100, "warm_up": 60}
    got = appearance_tracks(dets, "look", **cut, threshold=0.6, streak=2, misses=4) if appearance else folds.sort_tracks(dets.drop("look"), **cut)
    assert want and sorted(tuple(r)[1:] for r in got.collect()) == sorted(want)
    assert steady <= (len(alone) == 2)


def test_boxes_that_meet_no_track_need_no_assignment(monkeypatch):
    monkeypatch.setattr(folds, "assign", None)
    got, _ = numbers([[(100 * i, 0, 20, 20), (0, 100 + 100 * i, 20, 20)] for i in range(6)])
    assert got == [[2 * i + 1, 2 * i + 2] for i in range(6)]


def test_assignments_number_by_number_are_those_of_arrays():
    rnd = np.random.default_rng(1)
    for t in range(300):
        n, m = sorted(rnd.integers(1, 9, 2))
        c = rnd.integers(-4, 3, (n, m)).astype(float) if t % 2 else rnd.random((n, m))
        assert list(folds._paths(c))[1:] == folds._paths_of_few(c.tolist())[1:]

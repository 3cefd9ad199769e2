"""The heat map of motion against a picture that is cooled and warmed frame by frame, and its regions against a flood fill."""

import random

import numpy as np
import pytest

from vigil.operators import motion


def picture(frames, every, cell, wide, high, decay=4, add=80):
    """(block, cx, cy) -> heat after each block, and on until all is cold."""
    cells = (-(-high // cell), -(-wide // cell))
    now, out = np.zeros(cells, int), {}
    for n in range(len(frames) + every + 300):
        now = np.maximum(0, now - decay)
        for x, y, w, h in frames[n] if n < len(frames) else []:
            a, b, c, d = max(x, 0), max(y, 0), min(x + w, wide), min(y + h, high)
            if a < c and b < d and w > 0 and h > 0:
                part = now[b // cell : (d - 1) // cell + 1, a // cell : (c - 1) // cell + 1]
                part[:] = np.minimum(255, part + add)
        if (n + 1) % every == 0:
            for cy, cx in zip(*np.nonzero(now)):
                out[(n + 1) // every - 1, int(cx), int(cy)] = int(now[cy, cx])
    return out


@pytest.mark.parametrize("every", [1, 7, 50])
def test_heat_equals_frame_by_frame(spark, every):
    rnd = random.Random(every)
    sources = {s: [[(rnd.randrange(-30, 120), rnd.randrange(-30, 90), rnd.choice([0, 5, 30, 200]), rnd.randrange(1, 40)) for _ in range(rnd.choice([0, 0, 1, 2]))] for _ in range(120)] for s in ("a", "b")}
    rows = [(s, 10 * n, [dict(zip("xywh", r)) for r in frame]) for s, frames in sources.items() for n, frame in enumerate(frames)]
    df = spark.createDataFrame(rows, "source_id string, frame_id long, regions array<struct<x:int,y:int,w:int,h:int>>")
    got = {s: {} for s in sources}
    for r in motion.heat(df, "regions", every, 10, (100, 75)).collect():
        got[r.source_id][r.block, r.cx, r.cy] = r.heat
    assert got == {s: picture(frames, every, 10, 100, 75) for s, frames in sources.items()}


def flood(hot):
    rows, columns = hot.shape
    seen, parts, outside = set(), [], set()
    todo = [(-1, -1)]
    while todo:
        y, x = todo.pop()
        if (y, x) in outside or not (-1 <= y <= rows and -1 <= x <= columns) or (0 <= y < rows and 0 <= x < columns and hot[y, x]):
            continue
        outside.add((y, x))
        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    for y, x in zip(*np.nonzero(hot)):
        if (y, x) in seen:
            continue
        part, todo = set(), [(int(y), int(x))]
        while todo:
            p = todo.pop()
            if p in part or not (0 <= p[0] < rows and 0 <= p[1] < columns and hot[p]):
                continue
            part.add(p)
            todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        seen |= part
        if any((a + c, b + d) in outside for a, b in part for c, d in ((1, 0), (-1, 0), (0, 1), (0, -1))):
            ys, xs = [p[0] for p in part], [p[1] for p in part]
            parts.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    return parts


def test_outer_components_equal_a_flood_fill():
    rnd = np.random.default_rng(2)
    for share in (0.0, 0.1, 0.4, 0.6, 0.9, 1.0):
        for _ in range(20):
            hot = rnd.random((9, 14)) < share
            assert motion.outer_components(hot) == flood(hot)
    ring = np.ones((5, 5), bool)
    ring[1:-1, 1:-1] = False
    ring[2, 2] = True
    assert motion.outer_components(ring) == [(0, 0, 5, 5)]  # what lies in the hole is left out


def test_regions_of_heat(spark):
    rows = [("a", n, [{"x": 0, "y": 0, "w": 20, "h": 20}, {"x": 50, "y": 50, "w": 5, "h": 5}]) for n in range(10)] + [("b", 0, []), ("c", 0, None)]
    df = spark.createDataFrame(rows, "source_id string, frame_id long, regions array<struct<x:int,y:int,w:int,h:int>>")
    got = [tuple(r) for r in motion.heat_regions(df, "regions", 10, 10, (100, 75), 300).filter("block = 0").collect()]
    assert got == [("a", 0, 0, 0, 0, 20, 20)]
    assert sorted(tuple(r)[2:] for r in motion.heat_regions(df, "regions", 10, 10, (100, 75), 0, most=2).filter("block = 0").collect()) == [(0, 0, 0, 20, 20), (1, 50, 50, 10, 10)]
    assert motion.heat_regions(df.limit(0), "regions", 10, 10, (100, 75), 0).count() == 0


@pytest.mark.parametrize("stretch", [7, 20, 30])
def test_heat_by_stretches_equals_frame_by_frame(spark, stretch):
    """Cells come into a stretch cold, warm and at their most; no row a cell and block is shuffled."""
    rnd = random.Random(stretch)
    frames = [[(rnd.randrange(-30, 120), rnd.randrange(-30, 90), rnd.choice([5, 30, 90]), rnd.randrange(1, 60)) for _ in range(rnd.choice([0, 0, 1, 3]))] for _ in range(211)]
    rows = [("a", n, [dict(zip("xywh", r)) for r in frame] or None) for n, frame in enumerate(frames)]
    df = spark.createDataFrame(rows, "source_id string, frame_id long, regions array<struct<x:int,y:int,w:int,h:int>>")
    got = {(r.block, r.cx, r.cy): r.heat for r in motion.heat(df, "regions", 7, 10, (100, 75), stretch=stretch).collect()}
    assert got == picture(frames, 7, 10, 100, 75)

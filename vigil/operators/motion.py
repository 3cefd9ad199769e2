"""Motion: which regions of a frame count, what is remembered of earlier frames, what kind of scene it is, and what that does to the regions. A frame's
regions are an array of boxes (x, y, w, h)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators import frames, keyed, windows

#: A scene's thresholds in their order, and the sizes of its treatment.
SCENES = (("noise", 0.15, "noisy"), ("complexity", 0.7, "complex"), ("intensity", 0.3, "high_motion"), ("density", 0.1, "crowded"))
NOISE_AREA, CROWDED_MOST, MARGIN, COMPLEX_MERGE = 300, 20, 5, 0.15


def _area(r: Column) -> Column:
    return r["w"].cast("long") * r["h"]


def plausible(regions: Column, least: int, most: int, ratio: float, picture: tuple[int, int] | None = None, limit: int | None = None) -> Column:
    """Regions whose area lies within least and most and whose longer side is at most ratio times the shorter; with picture those inside it; with limit
    the first so many of them."""

    def good(r: Column) -> Column:
        long, short = F.greatest(r["w"], r["h"]), F.greatest(F.lit(1), F.least(r["w"], r["h"]))
        ok = (r["w"] > 0) & (r["h"] > 0) & _area(r).between(least, most) & (long / short <= ratio)
        if picture:
            ok = ok & (r["x"] >= 0) & (r["y"] >= 0) & (r["x"] + r["w"] <= picture[0]) & (r["y"] + r["h"] <= picture[1])
        return ok

    kept = F.filter(regions, good)
    return kept if limit is None else F.slice(kept, 1, limit)


def remembered(rows: DataFrame, key: str, order: str, regions: str, frames_back: int, name: str = "history", size: int = windows.BLOCK) -> DataFrame:
    """Adds the regions of this frame and of those up to frames_back numbers before it, oldest first. Blocks of frame numbers are worked on apart; the last
    frames of each stand in the next one too."""
    size = max(size, 2 * frames_back)
    n = F.col(order)
    mine = F.struct(F.floor(n / size).alias("b"), F.lit(False).alias("context"))
    after = F.struct((F.floor(n / size) + 1).alias("b"), F.lit(True).alias("context"))
    df = rows.withColumn("__at", F.explode(F.when(F.pmod(n, F.lit(size)) >= size - frames_back, F.array(mine, after)).otherwise(F.array(mine))))
    w = windows.over([key, "__at.b"], order).rangeBetween(-frames_back, 0)
    df = df.withColumn(name, F.flatten(F.collect_list(regions).over(w)))
    return df.filter("not __at.context").drop("__at")


def scene(noise: Column, complexity: Column, intensity: Column, density: Column) -> Column:
    """The kind of a scene: the first measure over its threshold decides."""
    given = {"noise": noise, "complexity": complexity, "intensity": intensity, "density": density}
    out = F.when(F.lit(False), "")
    for measure, threshold, kind in SCENES:
        out = out.when(given[measure] > threshold, kind)
    return out.otherwise("simple")


def strategy(noise: Column, complexity: Column, intensity: Column, millis: Column) -> Column:
    """Which way of detection suits the last frames, by their mean measures and the mean time a frame takes."""
    return F.when((noise > SCENES[0][1]) | (complexity > SCENES[1][1]), "advanced").when((intensity < 0.1) & (millis > 20), "classic").otherwise("advanced")


def treated(regions: Column, kind: Column, picture: tuple[int, int]) -> Column:
    """Regions by the kind of scene: small ones go from noisy ones, near ones merge in complex ones, of crowded ones the largest stay, and those of high
    motion grow by a margin within the picture."""
    large = F.filter(regions, lambda r: _area(r) >= NOISE_AREA)
    most = F.slice(F.transform(F.array_sort(F.transform(regions, lambda r, i: F.struct((-_area(r)).alias("a"), i.alias("i"), r.alias("r")))), lambda s: s["r"]), 1, CROWDED_MOST)
    wide, high = picture
    grown = F.transform(regions, lambda r: F.struct(F.greatest(F.lit(0), r["x"] - MARGIN).alias("x"), F.greatest(F.lit(0), r["y"] - MARGIN).alias("y"), F.least(F.lit(wide) - r["x"], r["w"] + 2 * MARGIN).alias("w"), F.least(F.lit(high) - r["y"], r["h"] + 2 * MARGIN).alias("h")))
    merged = frames.forward_merged(regions, COMPLEX_MERGE)
    return F.when(kind == "noisy", large).when(kind == "complex", merged).when(kind == "crowded", most).when(kind == "high_motion", grown).otherwise(regions)


def statistics(current: Column, history: Column, picture: tuple[int, int]) -> tuple[Column, Column]:
    """The area of all regions, now and remembered, merged where they overlap by over 0.3, and its share of the picture."""
    area = F.aggregate(frames.forward_merged(F.concat(current, history), 0.3), F.lit(0).cast("long"), lambda s, r: s + _area(r))
    return area, area / float(picture[0] * picture[1])


#: Heat that a frame takes from every cell, that a region adds to the cells it lies on, from which on a cell is hot, at most; regions of a picture.
DECAY, ADD, HOT, MOST_HEAT, MOST_REGIONS = 4, 80, 60, 255, 20


#: Frames of a stretch that one task works on at a time.
STRETCH = 6400


class _Heat:
    """The heat of a picture's cells from one stretch of frames to the next. shift, low and high say what a stretch does to each cell."""

    def __init__(self, cells: int):
        self.heat = np.zeros(cells, np.int64)

    def row(self, r: dict) -> list[tuple]:
        out = [(r["source_id"], r["stretch"], r["last"], self.heat.tolist())]
        self.heat = np.minimum(r["high"], np.maximum(r["low"], self.heat + r["shift"]))
        return out

    def end(self) -> list[tuple]:
        return []


def heat(rows: DataFrame, regions: str, every: int, cell: int, picture: tuple[int, int], decay: int = DECAY, add: int = ADD, stretch: int = STRETCH) -> DataFrame:
    """source_id, block, cx, cy, heat: of every cell of the picture that isn't cold, its heat after each `every` frames of a source (block: how many times so many, from 0; frames that are still
    missing to the last block are frames without motion). A frame takes decay from every cell, then each of its regions adds to the cells it lies on, within 0..255. rows: source_id,
    frame_id and an array of boxes, a row a frame.

    Cooling and warming shift a cell's heat and clamp it; shifts in a row come to one shift and one clamp. So each stretch of frames (some blocks) says what it does to the cells, whatever they had before; the
    stretches of a source, a row each, are followed in order, and each then gives its blocks. A task holds the regions of one stretch."""
    wide, high = picture
    columns, lines = -(-wide // cell), -(-high // cell)
    per = max(1, stretch // every) * every
    floor = lambda a: F.floor(F.greatest(a, F.lit(0)) / cell).cast("int")
    until = lambda a, size, most: F.floor((F.least(a + size, F.lit(most)) - 1) / cell).cast("int") + 1
    inside = F.filter(regions, lambda r: (r["w"] > 0) & (r["h"] > 0) & (r["x"] < wide) & (r["y"] < high) & (r["x"] + r["w"] > 0) & (r["y"] + r["h"] > 0))
    at = windows.ranked(rows, "source_id", "frame_id", "__n").dropna(subset=["source_id"])
    at = at.select("source_id", F.floor((F.col("__n") - 1) / per).alias("stretch"), F.col("__n").alias("n"), F.explode_outer(inside).alias("r"))
    at = at.select("source_id", "stretch", "n", F.when(F.col("r").isNotNull(), floor(F.col("r.x"))).alias("x"), until(F.col("r.x"), F.col("r.w"), wide).alias("x2"), floor(F.col("r.y")).alias("y"), until(F.col("r.y"), F.col("r.h"), high).alias("y2"))
    kind = rows.schema["source_id"].dataType.simpleString()

    def frames_of(b: pd.DataFrame) -> Iterator[tuple[int, list[tuple]]]:
        """The frames with motion in order, and their regions in cells; a row without x is a frame without any."""
        b = b[b["x"].notna()].sort_values("n")
        boxes = list(zip(*[b[c].astype(int).tolist() for c in ("x", "x2", "y", "y2")], strict=True))
        n = b["n"].to_numpy()
        begins = np.concatenate([[0], np.flatnonzero(n[1:] != n[:-1]) + 1, [len(n)]]).tolist() if len(n) else [0]
        for i, j in zip(begins[:-1], begins[1:], strict=True):
            yield int(n[i]), boxes[i:j]

    def warm(h: np.ndarray, cold: int, boxes: list[tuple]) -> None:
        """h: pictures, with the heat of cells that cooled so far, after a frame of these regions."""
        np.maximum(h - cold, 0, out=h)
        for x, x2, y, y2 in boxes:
            h[..., y:y2, x:x2] += add
        np.minimum(h, MOST_HEAT, out=h)

    def says(k: tuple, b: pd.DataFrame) -> pd.DataFrame:
        h, shift, now = np.zeros((2, lines, columns), np.int32), np.zeros((lines, columns), np.int64), k[1] * per
        h[1] = MOST_HEAT
        for n, boxes in frames_of(b):
            warm(h, decay * (n - now), boxes)
            for x, x2, y, y2 in boxes:
                shift[y:y2, x:x2] += add
            now = n
        end = (k[1] + 1) * per
        np.maximum(h - decay * (end - now), 0, out=h)
        return pd.DataFrame({"source_id": [k[0]], "stretch": [k[1]], "last": [int(b["n"].max())], "shift": [(shift - decay * per).ravel()], "low": [h[0].ravel()], "high": [h[1].ravel()]})

    def gives(k: tuple, b: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        h, now, out = np.array(start["heat"].iloc[0], np.int32).reshape(lines, columns), k[1] * per, []

        def snap(block: int) -> None:
            nonlocal h, now
            h = np.maximum(h - decay * ((block + 1) * every - now), 0)
            now = (block + 1) * every
            cy, cx = np.nonzero(h)
            out.append(pd.DataFrame({"block": block, "cx": cx, "cy": cy, "heat": h[cy, cx]}))

        block = now // every
        for n, boxes in frames_of(b):
            while n > (block + 1) * every:
                snap(block)
                block += 1
            warm(h, decay * (n - now), boxes)
            now = n
        last = bool(start["ends"].iloc[0])
        while h.any() if last else (block + 1) * every <= (k[1] + 1) * per:
            snap(block)
            block += 1
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({"block": [], "cx": [], "cy": [], "heat": []})
        found.insert(0, "source_id", k[0])
        return found

    answers = at.groupBy("source_id", "stretch").applyInPandas(says, f"source_id {kind}, stretch long, last long, shift array<long>, low array<long>, high array<long>")
    comes = keyed.fold(answers, ["source_id"], ["stretch"], lambda: _Heat(lines * columns), f"source_id {kind}, stretch long, last long, heat array<long>")
    comes = comes.withColumn("ends", F.lead("last").over(windows.over("source_id", "stretch")).isNull()).select(F.col("source_id").alias("__s"), F.col("stretch").alias("__t"), "heat", "ends")
    return at.groupBy("source_id", "stretch").cogroup(comes.groupBy("__s", "__t")).applyInPandas(gives, f"source_id {kind}, block long, cx long, cy long, heat int")


def outer_components(hot: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h in cells) around the parts of a picture that hang together, by sides or corners; in order of their first cell, row by row. Parts in a hole of another are left out."""
    rows, columns = hot.shape

    def spread(mark: np.ndarray, on: np.ndarray, corners: bool) -> np.ndarray:
        """The least mark of all cells that hang together, cell by cell."""
        none = mark.max() + 1
        mark = np.where(on, mark, none)
        while True:
            p = np.pad(mark, 1, constant_values=none)
            moves = [(a, b) for a in (0, 1, 2) for b in (0, 1, 2) if corners or 1 in (a, b)]
            new = np.where(on, np.minimum.reduce([p[a : a + rows, b : b + columns] for a, b in moves]), none)
            if np.array_equal(new, mark):
                return mark
            mark = new

    number = np.arange(rows * columns).reshape(rows, columns)
    part = spread(number, hot, True)
    rim = np.ones_like(hot)
    rim[1:-1, 1:-1] = False
    outside = ~hot & (spread(np.where(rim, -1, number), ~hot, False) == -1)
    p = np.pad(outside, 1, constant_values=True)
    seen = hot & (p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:])
    out = []
    for k in np.unique(part[seen]):
        y, x = np.nonzero(part == k)
        out.append((int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)))
    return out


def heat_regions(rows: DataFrame, regions: str, every: int, cell: int, picture: tuple[int, int], least_area: int, hot: int = HOT, most: int = MOST_REGIONS, **options: int) -> DataFrame:
    """source_id, block, place, x, y, w, h: after each block the boxes, in pixels, around the hot parts of the picture: of the first so many parts those of least_area or more. A block's picture, of a
    bounded number of cells, is one group."""
    wide, high = -(-picture[0] // cell), -(-picture[1] // cell)
    kind = rows.schema["source_id"].dataType.simpleString()

    def find(k: tuple, b: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((high, wide), bool)
        held[b["cy"].to_numpy(), b["cx"].to_numpy()] = True
        found = [(*k, i, x * cell, y * cell, w * cell, h * cell) for i, (x, y, w, h) in enumerate(outer_components(held)[:most]) if w * h * cell * cell >= least_area]
        return pd.DataFrame(found, columns=["source_id", "block", "place", "x", "y", "w", "h"])

    cells = heat(rows, regions, every, cell, picture, **options).filter(F.col("heat") > hot)
    return cells.groupBy("source_id", "block").applyInPandas(find, f"source_id {kind}, block long, place int, x int, y int, w int, h int")

"""The hook of a detector: frames with pictures go through a model in Arrow batches, and its boxes come out as detections.

The model is made once a Python worker and kept (a worker serves many tasks). Pictures go to it in batches of bounded bytes, whole or cut into tiles; boxes of tiles are put back in their
place, and those that meet over a seam are one (frames.stitch_groups). Several looks at the same pictures share one pass over them. Pictures of one size are stacked, so that cutting, looking (by a model that
takes stacks) and putting back go by arrays, a batch at a time. A task holds an Arrow batch, one batch of pictures, and the boxes of the frames in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigil.operators import frames

#: label, confidence, x, y, w, h.
Found = tuple[str, float, int, int, int, int]


class Model(Protocol):
    def detect(self, pictures: list[np.ndarray]) -> list[list[Found]]:
        """What each picture (rows of pixels) shows. A model may also have detect_stack(), which takes pictures of one size as one array and gives arrays: which picture, label, confidence, x, y, w, h."""
        ...


#: The models that this worker has made, by name.
_MADE: dict[str, Model] = {}
#: Bytes of pictures that go to a model at once.
BATCH_BYTES = 16 << 20
SCHEMA = pa.schema([("source_id", pa.string()), ("frame_id", pa.int64()), ("label", pa.string()), ("confidence", pa.float64()), ("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32())])


def made(name: str, make: Callable[[], Model]) -> Model:
    if name not in _MADE:
        _MADE[name] = make()
    return _MADE[name]


def cut(picture: np.ndarray, columns: int, rows: int) -> list[tuple[int, int, np.ndarray]]:
    """x, y and the pixels of each tile; the last of a row or column takes the remainder. A stack of pictures is cut as one is."""
    high, wide = picture.shape[-2:]
    xs, ys = (sorted({0, *frames.tile_seams(size, n)}) for size, n in ((wide, columns), (high, rows)))
    return [(x, y, picture[..., y:b, x:a]) for y, b in zip(ys, [*ys[1:], high], strict=True) for x, a in zip(xs, [*xs[1:], wide], strict=True)]


def stitched(found: list[Found], wide: int, high: int, columns: int, rows: int, gap: int, overlap: float) -> list[Found]:
    """The boxes of a frame's tiles, with those that meet over a seam as one: the box around all, and the greatest confidence."""
    seams = (frames.tile_seams(wide, columns), frames.tile_seams(high, rows))
    groups = frames.stitch_groups([f[2:] for f in found], [f[0] for f in found], seams, gap, overlap)
    out: dict[int, Found] = {}
    for g, (label, confidence, x, y, w, h) in zip(groups, found, strict=True):
        if g not in out:
            out[g] = (label, confidence, x, y, w, h)
            continue
        _, sure, a, b, c, d = out[g]
        left, top = min(a, x), min(b, y)
        out[g] = (label, max(sure, confidence), left, top, max(a + c, x + w) - left, max(b + d, y + h) - top)
    return list(out.values())


def _seen(model: Model, stack: np.ndarray) -> list[np.ndarray]:
    """What detect_stack() says, of any model."""
    if hasattr(model, "detect_stack"):
        return [np.asarray(c) for c in model.detect_stack(stack)]
    found = [(i, *f) for i, boxes in enumerate(model.detect(list(stack))) for f in boxes]
    kinds = (np.int64, object, np.float64, *[np.int64] * 4)
    return [np.array(c, kind) for c, kind in zip(zip(*found, strict=True) if found else [()] * 7, kinds, strict=True)]


def _looked(model: Model, stack: np.ndarray, tiles: tuple[int, int], gap: int, overlap: float) -> list[np.ndarray]:
    """which, label, confidence, x, y, w, h of all boxes of a stack of pictures."""
    if tiles == (1, 1):
        return _seen(model, stack)
    high, wide = stack.shape[1:]
    parts = []
    for left, top, tile in cut(stack, *tiles):
        which, label, confidence, x, y, w, h = _seen(model, tile)
        if len(which):
            parts.append((which, label, confidence, x + left, y + top, w, h))
    if not parts:
        return _seen(model, stack[:0])
    found = [np.concatenate(c) for c in zip(*parts, strict=True)]
    alone = np.bincount(found[0], minlength=len(stack))[found[0]] == 1
    if alone.all():
        return found
    several = [c[~alone] for c in found]
    several = [c[np.argsort(several[0], kind="stable")] for c in several]
    ends = np.flatnonzero(np.diff(several[0], append=-1)) + 1
    boxes, start, met = list(zip(*(c.tolist() for c in several[1:]), strict=True)), 0, []
    for end in ends.tolist():
        i = int(several[0][start])
        met += [(i, *f) for f in stitched(boxes[start:end], wide, high, *tiles, gap, overlap)]
        start = end
    return [np.concatenate((c[alone], np.array(m, c.dtype))) for c, m in zip(found, zip(*met, strict=True), strict=True)]


def looks(pictures: DataFrame, name: str, make: Callable[[], Model], of: dict[str, dict[str, Any]], gap: int = 1, overlap: float = 0.3) -> DataFrame:
    """look, and the columns of detect(): what the model finds by each look at the pictures, which are read once for all of them. of: each look's tiles and batch_bytes, as detect() takes them."""
    asked = [(look, o.get("tiles", (1, 1)), o.get("batch_bytes", BATCH_BYTES)) for look, o in of.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made(name, make)
        for batch in batches:
            column = lambda c: batch.column(batch.schema.names.index(c))  # noqa: B023, E731
            sizes: dict[tuple[int, int], list[tuple[int, pa.Buffer]]] = {}
            for i, (wide, high, pixels) in enumerate(zip(column("width").to_pylist(), column("height").to_pylist(), column("pixels"), strict=True)):
                raw = pixels.as_buffer()
                if wide and high and raw is not None and len(raw) >= wide * high:
                    sizes.setdefault((wide, high), []).append((i, raw))
            found: list[tuple[str, list[np.ndarray]]] = []
            for (wide, high), rows in sizes.items():
                for look, tiles, batch_bytes in asked:
                    n = max(1, -(-batch_bytes // (wide * high)))
                    for at in range(0, len(rows), n):
                        stack = np.stack([np.frombuffer(raw, np.uint8, wide * high) for _, raw in rows[at : at + n]]).reshape(-1, high, wide)
                        which, *boxes = _looked(model, stack, tiles, gap, overlap)
                        if len(which):
                            found.append((look, [np.array([i for i, _ in rows[at : at + n]])[which], *boxes]))
            if found:
                which, *boxes = (np.concatenate(c) for c in zip(*(f for _, f in found), strict=True))
                said = pa.array(np.repeat(np.array([look for look, _ in found], object), [len(f[0]) for _, f in found]), pa.string())
                source, frame = (column(c).take(pa.array(which)) for c in ("source_id", "frame_id"))
                yield pa.RecordBatch.from_arrays([said, source.cast(pa.string()), frame, *[pa.array(b).cast(f.type) for b, f in zip(boxes, list(SCHEMA)[2:], strict=True)]], schema=pa.schema([("look", pa.string()), *SCHEMA]))

    return pictures.select("source_id", "frame_id", "width", "height", "pixels").mapInArrow(run, "look string, source_id string, frame_id long, label string, confidence double, x int, y int, w int, h int")


def detect(pictures: DataFrame, name: str, make: Callable[[], Model], tiles: tuple[int, int] = (1, 1), batch_bytes: int = BATCH_BYTES, gap: int = 1, overlap: float = 0.3) -> DataFrame:
    """source_id, frame_id, label, confidence, x, y, w, h of all that the model finds. pictures: source_id, frame_id, width, height and pixels (a byte each, row by row); a row without pixels, or with too few,
    gives nothing. tiles: columns and rows that a picture is cut into."""
    return looks(pictures, name, make, {"": {"tiles": tiles, "batch_bytes": batch_bytes}}, gap, overlap).drop("look")

"""What the pipeline does only as a stream, with state by source: sliding windows of frames whose objects expire, evidence that is given when its object expires, windows of a fixed
number of frames, and answers that meet their requests before a deadline.

State stands in maps and lists (RocksDB), not in one pickled value: a micro-batch changes the entries of the objects that it holds or that expire. It is bounded by the frames of a window and the objects in
them. A source's rows of one micro-batch are put in order; `files` in stateful.source bounds a micro-batch. Rows of the newest frame may come in a later batch; those of a frame that has left the
window are passed over. A row without a frame says that its source ends: what is left then expires with its last frame. Null sources are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Stateful processors need this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

Payload = tuple[Any, ...]
#: What is kept of an object: of what was kept, a new sighting, and the place of its frame among the source's frames (from 0).
Keep = Callable[[Payload | None, Payload, int], Payload | None]


def _latest(old: Payload | None, new: Payload, place: int) -> Payload:
    return new


class _Sliding(StatefulProcessor):
    """The window of one source: objects by the frame they were last seen in."""

    def __init__(self, frames: int, payload: list[str], kinds: str, order: list[str], keep: Keep):
        self.frames, self.payload, self.kinds, self.order, self.keep = max(1, frames), payload, kinds, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alive = handle.getMapState("alive", "object_id string", f"frame_id long{self.kinds}, held boolean")
        self.window = handle.getMapState("window", "frame_id long", "place long")
        self.seen = handle.getValueState("seen", "newest long, frames long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows), ignore_index=True)
        ends = b["frame_id"].isna().any()
        b = b.dropna(subset=["frame_id"]).sort_values(["frame_id", "object_id", *self.order], ascending=[True, True, *[False] * len(self.order)], kind="stable")
        newest, count = self.seen.get() if self.seen.exists() else (None, 0)
        alive = {k[0]: v for k, v in self.alive.iterator()}
        window = {k[0]: v[0] for k, v in self.window.iterator()}
        had, frames, out = set(alive), set(window), []
        by_frame: dict[int, set[str]] = {}
        for o, v in alive.items():
            by_frame.setdefault(v[0], set()).add(o)
        changed: set[str] = set()

        def leave(until: int) -> None:
            """Frames up to this one leave the window, in order, with the objects that no later frame holds."""
            for f in sorted(f for f in window if f <= until):
                at = min(f + self.frames, newest)
                out.append((*key, None, f, at, *[None] * len(self.payload)))
                for o in sorted(by_frame.pop(f, ())):
                    _, *payload, held = alive.pop(o)
                    out.append((*key, o, f, at, *(payload if held else [None] * len(self.payload))))
                del window[f]

        columns = [b[c].tolist() for c in ("frame_id", "object_id", *self.payload)]
        last = None
        for f, o, *values in zip(*columns, strict=True):
            f = int(f)
            if newest is None or f > newest:
                if newest is not None:
                    newest = f
                    leave(f - self.frames)
                newest = f
            if f <= newest - self.frames:
                continue
            if f not in window:
                window[f], count = count, count + 1
            if o is None or pd.isna(o) or (f, o) == last:  # of an object's rows in a frame the first by order counts
                continue
            last = (f, o)
            was = alive.get(o)
            kept = self.keep(tuple(was[1:-1]) if was and was[-1] else None, tuple(None if pd.isna(v) else v for v in values), window[f])
            if was:
                by_frame[was[0]].discard(o)
            at = max(f, was[0]) if was else f
            by_frame.setdefault(at, set()).add(o)
            alive[o] = (at, *(kept or [None] * len(self.payload)), kept is not None)
            changed.add(o)
        if ends and newest is not None:
            leave(newest)
        if newest is not None:
            self.seen.update((newest, count))
        for o in had - set(alive):
            self.alive.removeKey((o,))
        for o in changed & set(alive):
            self.alive.updateValue((o,), alive[o])
        for f in frames - set(window):
            self.window.removeKey((f,))
        for f in set(window) - frames:
            self.window.updateValue((f,), (window[f],))
        yield pd.DataFrame(out, columns=["source_id", "object_id", "frame_id", "expired_at", *self.payload])

    def close(self) -> None:
        pass


def sliding(stream: DataFrame, frames: int, payload: list[str] | None = None, order: list[str] | None = None, keep: Keep = _latest) -> DataFrame:
    """source_id, object_id, frame_id, expired_at and payload: what leaves each source's window of so many frame numbers. A row with an object: it was last seen in that frame, and isn't in the window any
    more; payload is what was kept of it. One without: the frame itself. stream: source_id, frame_id, object_id (null: a frame without objects) and the payload. order: of an object's
    rows in one frame the greatest by these counts."""
    payload, order = payload or [], order or []
    kinds = "".join(f", {c} {stream.schema[c].dataType.simpleString()}" for c in payload)
    rows = stream.select("source_id", F.col("frame_id").cast("long").alias("frame_id"), F.col("object_id").cast("string").alias("object_id"), *payload, *[c for c in order if c not in payload]).dropna(subset=["source_id"])
    schema = f"source_id {stream.schema['source_id'].dataType.simpleString()}, object_id string, frame_id long, expired_at long{kinds}"
    return rows.groupBy("source_id").transformWithStateInPandas(_Sliding(frames, payload, kinds, order, keep), schema, "append", "None")


class _Tumbling(StatefulProcessor):
    """Frames of one source that wait for their batch to be full."""

    def __init__(self, size: int, stride: int):
        self.size, self.stride = max(1, size), max(1, stride)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "frame_id long")
        self.seen = handle.getValueState("seen", "newest long, frames long, batches long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = sorted(set().union(*(c["frame_id"].unique().tolist() for c in rows)))
        newest, count, batches = self.seen.get() if self.seen.exists() else (None, 0, 0)
        waiting, out = [r[0] for r in self.waiting.get()] if self.waiting.exists() else [], []
        for f in new:
            if newest is not None and f <= newest:
                continue
            newest, count = f, count + 1
            if (count - 1) % self.stride:
                continue
            waiting.append(f)
            if len(waiting) == self.size:
                out.append((*key, batches, waiting[0], waiting[-1]))
                waiting, batches = [], batches + 1
        if newest is not None:
            self.seen.update((newest, count, batches))
        if waiting:
            self.waiting.put([(f,) for f in waiting])
        elif self.waiting.exists():
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["source_id", "batch_no", "first", "frame_id"])

    def close(self) -> None:
        pass


def tumbling(stream: DataFrame, size: int, stride: int = 1) -> DataFrame:
    """source_id, batch_no, first, frame_id (the last): every stride-th frame of a source is collected, and each `size` of them are given together. stream: source_id, frame_id."""
    rows = stream.select("source_id", F.col("frame_id").cast("long").alias("frame_id")).dropna()
    schema = f"source_id {stream.schema['source_id'].dataType.simpleString()}, batch_no long, first long, frame_id long"
    return rows.groupBy("source_id").transformWithStateInPandas(_Tumbling(size, stride), schema, "append", "None")


def reconciled(requests: DataFrame, answers: DataFrame, wait: str, late: str = "0 seconds") -> DataFrame:
    """candidate_id, created, request_id, completed, occurred: of each request the first answer that comes within `wait` (of answers of one number and one time one that says it occurred), or nulls, once no other can come. Both are streams with a watermark: an
    answer is kept until it is too old for any request to come, a request until its deadline has passed; then the outer join gives it without an answer. requests: candidate_id,
    created; answers: request_id, candidate_id, completed, occurred."""
    q = requests.select("candidate_id", "created").withWatermark("created", late)
    a = answers.select(F.col("candidate_id").alias("__candidate"), "request_id", "completed", "occurred").withWatermark("completed", late)
    met = (F.col("candidate_id") == F.col("__candidate")) & (F.col("completed") >= F.col("created")) & (F.col("completed") < F.col("created") + F.expr(f"INTERVAL {wait}"))
    all_of = q.join(a, met, "leftOuter")
    first = F.min(F.when(F.col("completed").isNotNull(), F.struct("completed", "request_id", (~F.coalesce("occurred", F.lit(False))).alias("not")))).alias("r")
    return all_of.groupBy("candidate_id", F.window("created", "1 microsecond").alias("w")).agg(first).select("candidate_id", F.col("w.start").alias("created"), "r.request_id", "r.completed", (~F.col("r.not")).alias("occurred"))

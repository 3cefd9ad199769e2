"""Rules that are truly sequential: throttling block by block, averages, access states and inner suppression on the JVM; trackers in numpy
per source."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.geometry import Box
from vigil.operators import keyed, windows
from vigil.sources.shared import stored

#: Rows of one block of a chain, at most.
BLOCK_ROWS = 1 << 16
#: Intervals of one span of a throttled key's time.
SPAN = 1024
#: What a chain begins with: anything is due.
FIRST = -(1 << 62)


def _links(times: np.ndarray, until: np.ndarray, late: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Of each row the place of the next one, if it is taken: the first from its until on (late: the one behind that), or the first of the next run, if that comes before."""
    return np.minimum(np.searchsorted(times, until) + late, np.searchsorted(run, run, side="right"))


def _exits(times: np.ndarray, until: np.ndarray, late: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Of each row, if the chain takes it: what the chain leaves the block with, as 2 * due + late. Pointers to next rows are doubled until all have left."""
    n, follow = len(times), _links(times, until, late, run)
    out = np.where(np.searchsorted(times, until) < n, 2 * (times[-1] + 1), 2 * until + late)  # the one passed over may be the block's last
    last = np.where(follow < n, np.minimum(follow, n - 1), np.arange(n))
    while not np.array_equal(further := last[last], last):
        last = further
    return out[last]


class _Blocks:
    """The blocks of one key in order: what the chain comes into each with. Only a block's first run can go on from the block before."""

    def __init__(self):
        self.run, self.code = None, FIRST

    def row(self, r: dict) -> list[tuple]:
        *head, first_run, last_run, times, exits, second = r.values()
        if self.run != first_run:
            self.code = FIRST
        out = [(*head, self.code)]
        at = int(np.searchsorted(times, self.code >> 1))
        passed = at == len(times)
        at += self.code & 1
        if at < len(times):
            self.code = int(exits[at])
        elif first_run != last_run:
            self.code = int(second)
        elif not passed:
            self.code = 2 * (int(times[-1]) + 1)
        self.run = last_run
        return out

    def end(self) -> list[tuple]:
        return []


def chained(rows: DataFrame, key: str, order: str, until: Column, span: int, late: Column | None = None, run: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """Greedy: of a key's rows in order the first is taken, then the first at or after `until` of the one taken last, and so on; where that one was late, the first is passed over and
    the one behind it taken. With run (whole numbers that grow with order) each run of a key begins anew. Of rows of one place in order, the least by ties may be taken. Rows without a key
    or a place go; without an until no other follows. until follows order by one at least, and is a function of key and order, as late is. order: whole numbers.

    A key's rows are cut by order into spans, these into blocks of BLOCK_ROWS at most. Each block first says what it does to what comes into it; these answers, a row a block, are followed in
    order, and each block then gives its rows. No task holds more than a block of a key."""
    names, ties, some_late = rows.columns, ties or [], late is not None
    df = rows.dropna(subset=[key, order]).withColumns({
        "__until": F.greatest(F.coalesce(until, F.lit(1 << 60)), F.col(order) + 1).cast("long"), "__late": F.coalesce(late, F.lit(False)).cast("int") if some_late else F.lit(0),
        "__run": F.col(run).cast("long") if run else F.lit(0).cast("long"), "__span": F.floor(F.col(order) / span),
    })
    df = df.withColumn("__part", F.floor((F.row_number().over(windows.over([key, "__span"], order)) - 1) / BLOCK_ROWS))
    block = [key, "__span", "__part"]
    head = f"{key} {rows.schema[key].dataType.simpleString()}, __span long, __part long"
    arrays = lambda b: [b[c].to_numpy(np.int64) for c in (order, "__until", "__late", "__run")]

    def answer(k: tuple, b: pd.DataFrame) -> pd.DataFrame:
        times, until, late, runs = arrays(b.drop_duplicates(order).sort_values(order))
        exits = _exits(times, until, late, runs)
        n = int(np.searchsorted(runs, runs[0], side="right"))
        second = int(exits[n]) if n < len(exits) else 0
        times, exits = times[:n], exits[:n]
        if not some_late:  # of equal exits the last says it all
            stays = np.append(exits[1:] != exits[:-1], True)
            times, exits = times[stays], exits[stays]
        return pd.DataFrame([(*k, runs[0], runs[-1], times, exits, second)], columns=[*block, "first_run", "last_run", "times", "exits", "second"])

    answers = df.select(*block, order, "__until", "__late", "__run").groupBy(*block).applyInPandas(answer, f"{head}, first_run long, last_run long, times array<long>, exits array<long>, second long")
    states = keyed.fold(answers, [key], ["__span", "__part"], _Blocks, f"{head}, code long")

    def passing(k: tuple, b: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values([order, *ties], kind="stable").drop_duplicates(order)
        times, until, late, runs = arrays(b)
        follow, code, at = _links(times, until, late, runs), int(state["code"].iloc[0]) if len(state) else FIRST, []
        i = min(int(np.searchsorted(times, code >> 1)) + (code & 1), int(np.searchsorted(runs, runs[0], side="right"))) if len(times) else 0
        while i < len(times):
            at.append(i)
            i = int(follow[i])
        return b.iloc[at][names]

    renamed = states.toDF(*(f"__k{i}" for i in range(len(block))), "code")
    return df.groupBy(*block).cogroup(renamed.groupBy(*renamed.columns[:-1])).applyInPandas(passing, rows.schema)


def throttle(rows: DataFrame, key: str, micros: str, interval: int, *keep: str) -> DataFrame:
    """Greedy: a row passes if the last one that passed is interval microseconds or more behind; of rows of one time the least may. Rows without
    a key or a time go."""
    rows = rows.select(key, micros, *keep)
    if interval <= 0:
        return rows.dropna(subset=[key, micros])
    return chained(rows, key, micros, F.col(micros) + interval, interval * SPAN, ties=list(keep))


def candidates(rows: DataFrame, key: str, order: str, flag: Column, least: int, until: Column | None = None, late: Column | None = None, size: int = windows.BLOCK) -> DataFrame:
    """Rows at which a candidate is made: within a run of flag that has lasted least rows, the first, and again the first from `until` on, the place in order at which the last one was
    decided. A late one is only found out by the first row from there on, behind which the next follows. Without an until there is one a run."""
    held = windows.runs(rows, key, order, flag).filter(F.col("run_length") >= max(1, least))
    if until is None:
        return held.filter(F.col("run_length") == max(1, least))
    return chained(held, key, order, until, size, late, "run_start")


def suppressed(events: DataFrame, intervals: dict[str, int], enabled: bool = True) -> DataFrame:
    """Events that are posted: of a source, those of a name with an interval (in seconds) are throttled, all others pass; so do all unless enabled.
    events: source_id, event_name, ts, and others."""
    intervals = {n: s for n, s in intervals.items() if s > 0}
    if not enabled or not intervals:
        return events
    columns = events.columns
    named = F.create_map(*[F.lit(x) for kv in intervals.items() for x in kv])
    seconds = F.try_element_at(named, F.col("event_name"))
    some = events.filter(seconds.isNotNull()).withColumns({"__us": F.unix_micros(F.col("ts").cast("timestamp")), "__key": F.concat_ws("_", "source_id", "event_name")})
    passed = chained(some, "__key", "__us", F.col("__us") + seconds.cast("long") * 1_000_000, max(intervals.values()) * 1_000_000 * SPAN, ties=columns).select(*columns)
    return events.filter(seconds.isNull()).unionByName(passed)


def ema(values: Column, alpha: float) -> Column:
    """Exponential average of an array, seeded by its first value."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(a * (1 - alpha) + x * alpha))


def ema_by(rows: DataFrame, key: str, order: str, value: str, alpha: float, size: int = windows.BLOCK) -> DataFrame:
    """key, ema: the exponential average of a key's values at its end. A block of a key's rows comes to the sum of its values, each weighted by the rows behind it in the block; the blocks'
    sums are weighted by the rows behind the block. The key's first value, which seeds the average, weighs 1 instead of alpha."""
    inside = windows.over([key, "__block"], F.desc(order))
    df = rows.select(key, order, value).withColumn("__block", windows.block_of(rows, order, size)).withColumn("__after", F.row_number().over(inside) - 1)
    keeps = F.lit(1 - alpha)
    blocks = df.groupBy(key, "__block").agg(F.sum(F.col(value) * alpha * F.pow(keeps, F.col("__after"))).alias("s"), F.count("*").alias("n"), F.min_by(value, order).alias("first"))
    w = windows.over(key, F.desc("__block")).rowsBetween(windows.Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"behind": F.coalesce(F.sum("n").over(w), F.lit(0)), "__earliest": F.min("__block").over(windows.Window.partitionBy(key))})
    seed = F.when(F.col("__block") == F.col("__earliest"), F.col("first") * (1 - alpha) * F.pow(keeps, F.col("n") - 1)).otherwise(0.0)
    return blocks.groupBy(key).agg(F.sum((F.col("s") + seed) * F.pow(keeps, F.col("behind"))).alias("ema"))


#: next state by geometry and previous state.
ACCESS = {"in": dict(Outside="Entering", Entering="Inside", Inside="Inside", Leaving="Entering"), "mixed_in": dict(Outside="Entering", Entering="Entering", Inside="Inside", Leaving="Entering"), "mixed_out": dict(Outside="Outside", Entering="Leaving", Inside="Leaving", Leaving="Leaving"), "out": dict(Outside="Outside", Entering="Leaving", Inside="Leaving", Leaving="Outside")}


def access_states(rows: DataFrame, key: str, order: str, geometry: str) -> DataFrame:
    """key, order and state after each row of a region-access machine that starts Outside. A row of no geometry leaves its state.

    By ACCESS a state depends on the stay alone, the rows since the centre last changed sides: a stay on the inner side begins with Entering
    and is Inside once a later row of it is wholly in; one on the outer side begins with Leaving (the first of all: Outside) and is
    Outside once a later row of it is wholly out. So window functions say it."""
    w = windows.over(key, order)
    upto = w.rowsBetween(windows.Window.unboundedPreceding, 0)
    g = F.when(F.col(geometry).isin(*ACCESS), F.col(geometry))
    df = rows.select(key, order, g.alias("__g")).withColumn("__side", F.last(F.when(F.col("__g").isNotNull(), F.col("__g").isin("in", "mixed_in")), ignorenulls=True).over(upto))
    df = df.withColumn("__turn", F.coalesce((F.col("__side") != F.lag("__side").over(w)).cast("int"), F.lit(0)))
    df = df.withColumn("__stay", F.sum("__turn").over(upto))
    stay = windows.over([key, "__stay"], order).rowsBetween(windows.Window.unboundedPreceding, 0)
    df = df.withColumns({"__seen": F.count("__g").over(stay), "__whole": F.count_if(F.col("__g").isin("in", "out")).over(stay), "__first": F.first("__g", ignorenulls=True).over(stay)})
    later = F.col("__whole") - F.col("__first").isin("in", "out").cast("int") > 0  # the stay's first row only begins it
    state = F.when(F.col("__side"), F.when(later, "Inside").otherwise("Entering")).otherwise(F.when(later | (F.col("__stay") == 0), "Outside").otherwise("Leaving"))
    return df.select(key, order, F.when(F.col("__side").isNull(), "Outside").otherwise(state).alias("state"))


def _iof(a, b) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    least = min(a[2] * a[3], b[2] * b[3])
    return w * h / least if w > 0 and h > 0 and least else 0.0


def suppress_inner(boxes: list[tuple[int, int, int, int]], ratio: float) -> list[int]:
    """Places that stay: in order, of two boxes that overlap by more than ratio of the smaller one the larger stays, the earlier on
    a tie; a box that is gone takes no further part."""
    gone = [False] * len(boxes)
    for i in range(len(boxes)):
        for j in range(i + 1, len(boxes)):
            if gone[i]:
                break
            if not gone[j] and _iof(boxes[i], boxes[j]) > ratio:
                gone[j if boxes[i][2] * boxes[i][3] >= boxes[j][2] * boxes[j][3] else i] = True
    return [i for i, g in enumerate(gone) if not g]


def inner_suppression(dets: DataFrame, ratio: float) -> DataFrame:
    """suppress_inner() frame by frame and label by label, the surest box first, as a fold over the small array of a frame's boxes of one label.

    Box i, if it is still there, meets the first later box that is larger and overlaps it enough: up to that one all that overlap it go,
    and with that one box i itself. Frames in which no two boxes overlap enough stay as they are, without the fold."""
    names, key = dets.columns, ["source_id", "frame_id", "label"]
    first = ["x", "y", "w", "h", "tracking_id"]
    order = F.struct((-F.col("confidence")).alias("__c"), *first, *[c for c in names if c not in (*key, *first)])
    g = dets.dropna(subset=key).groupBy(*key).agg(F.sort_array(F.collect_list(order)).alias("b"))
    box = lambda r: Box(r["x"], r["y"], r["w"], r["h"])
    at = lambda i: F.get("b", i)
    n = F.size("b")

    def meets(i: Column, j: Column) -> Column:
        return box(at(i)).iof(box(at(j))) > ratio

    def step(gone: Column, i: Column) -> Column:
        larger = F.filter(F.sequence(i + 1, n - 1), lambda j: ~F.get(gone, j) & (box(at(i)).area < box(at(j)).area) & meets(i, j))
        stop = F.coalesce(F.get(larger, F.lit(0)), n)
        leave = lambda stop: F.transform(gone, lambda was, k: was | ((k == i) & (stop < n)) | ((k > i) & (k < stop) & meets(i, k)))
        return F.when(F.get(gone, i) | (i == n - 1), gone).otherwise(F.get(F.transform(F.array(stop), leave), F.lit(0)))  # stop is worked out once

    none = F.transform("b", lambda _: F.lit(False))
    gone = F.aggregate(F.sequence(F.lit(0), n - 1), none, step)
    apart = ~F.exists(F.transform("b", lambda r, i: F.struct(r.alias("r"), i.alias("i"))), lambda p: F.exists(F.slice("b", p["i"] + 2, n), lambda q: box(p["r"]).iof(box(q)) > ratio))
    kept = F.when(n == 1, F.col("b")).when(apart, F.col("b")).otherwise(F.get(F.transform(F.array(gone), lambda out: F.filter("b", lambda _, i: ~F.get(out, i))), F.lit(0)))
    return g.select(*key, F.explode(kept).alias("k")).select(*[F.col(c) if c in key else F.col(f"k.{c}") for c in names])


#: Columns up to which plain numbers are quicker than arrays.
FEW = 100


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns (shortest augmenting paths); every row or every column is assigned."""
    if not cost.size:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    match = _paths_of_few(c.tolist()) if c.shape[1] <= FEW else _paths(c)
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, len(match)) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def _paths(c: np.ndarray) -> np.ndarray:
    """Of each column, from 1, its row, from 1 (0: none)."""
    n, m = c.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row, free = match[j], ~used[1:]
            now = c[row - 1] - u[row] - v[1:]
            better = free & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j
            k = int(np.where(free, least[1:], np.inf).argmin()) + 1
            d = least[k]
            u[match[used]] += d
            v[used] -= d
            least[~used] -= d
            j = k
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    return match


def _paths_of_few(c: list[list[float]]) -> list[int]:
    """The same, number by number."""
    n, m = len(c), len(c[0])
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    inf = float("inf")
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, free, used = [inf] * (m + 1), list(range(1, m + 1)), []
        while True:
            used.append(j)
            row = match[j]
            costs, base, k, d = c[row - 1], u[row], 0, inf
            for f in free:
                now = costs[f - 1] - base - v[f]
                if now < least[f]:
                    least[f], way[f] = now, j
                if least[f] < d:
                    d, k = least[f], f
            for g in used:
                u[match[g]] += d
                v[g] -= d
            free.remove(k)
            if match[k] == 0:
                break
            for f in free:
                least[f] -= d
            least[k] -= d
            j = k
        j = k
        while j:
            match[j], j = match[way[j]], way[j]
    return match


class Tracker:
    """Boxes over frames by constant-velocity Kalman filters on (cx, cy, area, aspect) and least-cost assignment on overlap. The gain is that of the
    first update, as filters of this family keep it; so it follows from how many frames that came after the track's birth. Tracks stand as arrays, a row a track."""

    F_ = np.eye(7) + np.eye(7, k=4)
    H_ = np.eye(4, 7)
    P_, R_, Q_ = np.diag([10.0] * 4 + [1e4] * 3), np.diag([1.0, 1, 10, 10]), np.diag([1.0] * 4 + [0.01, 0.01, 1e-4])
    #: The gains, by the frames from a track's birth to its first update.
    _gains: list[np.ndarray] = []
    #: What is kept of a track besides its boxes: columns of whole numbers.
    KEPT = ("id", "misses", "age", "gain")

    def __init__(self, overlap: float = 0.3, misses: int = 3):
        self.overlap, self.misses, self.next = overlap, misses, 1
        self.x, self.of = np.zeros((0, 7)), np.zeros((0, len(self.KEPT)), np.int64)

    def digest(self) -> str:
        """Of all that its answers to further frames rest on, but for the numbers of its tracks."""
        return hashlib.blake2b(b"".join(np.ascontiguousarray(a).tobytes() for a in self._rests_on()), digest_size=16).hexdigest()

    def _rests_on(self) -> list[np.ndarray]:
        return [self.x, self.of[:, 1:]]

    @property
    def tracks(self) -> list[dict]:
        """The tracks that are alive."""
        return [{"x": x, **dict(zip(self.KEPT, of.tolist(), strict=True))} for x, of in zip(self.x, self.of, strict=True)]

    @classmethod
    def gain(cls, frames: int) -> np.ndarray:
        while len(cls._gains) < frames:
            p = cls.P_
            for _ in range(len(cls._gains) + 1):
                p = cls.F_ @ p @ cls.F_.T + cls.Q_
            cls._gains.append(p @ cls.H_.T @ np.linalg.inv(cls.H_ @ p @ cls.H_.T + cls.R_))
        return cls._gains[frames - 1]

    @staticmethod
    def moved(x: np.ndarray, gain: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Tracks after an update, one or many: term by term, so that the sum is the same however many there are."""
        d = (seen - x)[..., None, :4]
        return x + (gain[..., 0] * d[..., 0] + gain[..., 1] * d[..., 1] + gain[..., 2] * d[..., 2] + gain[..., 3] * d[..., 3])

    @staticmethod
    def _states(b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(b), 7))
        out[:, 0], out[:, 1], out[:, 2], out[:, 3] = b[:, 0] + b[:, 2] / 2, b[:, 1] + b[:, 3] / 2, b[:, 2] * b[:, 3], b[:, 2] / np.maximum(b[:, 3], 1e-9)
        return out

    def _predict(self) -> np.ndarray:
        """Moves the tracks on by a frame: their boxes [4, tracks]."""
        x = self.x
        x[x[:, 2] + x[:, 6] <= 0, 6] = 0
        x[:, :3] += x[:, 4:]
        s = x.T
        w = np.sqrt(np.maximum(s[2] * s[3], 0))
        h = np.divide(s[2], w, out=np.zeros_like(w), where=w > 0)
        return np.array([s[0] - w / 2, s[1] - h / 2, w, h])

    def step(self, boxes: np.ndarray) -> list[int]:
        """The track of each box of the next frame."""
        of, n = self.of, len(boxes)
        out = [0] * n
        if len(of):
            x, y, w, h = self._predict()
            of[:, 1:3] += 1  # a miss, for now
            if n:
                bx, by, bw, bh = boxes.T[:, :, None]
                wide = np.maximum(0, np.minimum(bx + bw, x + w) - np.maximum(bx, x) + 1)
                both = np.maximum(0, np.minimum(by + bh, y + h) - np.maximum(by, y) + 1)
                if (wide * both).any() or self.overlap < 0.01:
                    cost = np.trunc(-100 * wide * both / ((bw + 1) * (bh + 1) + (w + 1) * (h + 1) - wide * both + 1e-5))
                    least = int(-100 * self.overlap)
                    near, some = cost <= least, cost < 0
                    states = self._states(boxes) if near.any() else boxes
                    if not near.any():  # none is matched, whatever is assigned
                        pairs = []
                    elif some.sum(0).max() == 1 == some.sum(1).max():  # no two that overlap meet a third: all of them stand in any least-cost assignment
                        pairs = np.argwhere(near).tolist()
                    else:
                        pairs = assign(cost)
                    for i, j in pairs:
                        if near[i, j]:
                            of[j, 3] = of[j, 3] or of[j, 2]
                            self.x[j] = self.moved(self.x[j], self.gain(int(of[j, 3])), states[i])
                            of[j, 1], out[i] = 0, int(of[j, 0])
            stay = of[:, 1] <= self.misses
            if not stay.all():
                self.x, self.of = self.x[stay], of[stay]
        new = [i for i in range(n) if not out[i]]
        if new:
            for i in new:
                out[i], self.next = self.next, self.next + 1
            self.x = np.concatenate([self.x, self._states(boxes[new])])
            self.of = np.concatenate([self.of, [[out[i], 0, 0, 0] for i in new]])
        return out


ORDER = ["frame_id", "x", "y", "w", "h", "label", "confidence", "tracking_id"]


class _Sort:
    """forgets: after so many frames without boxes no track is left."""

    def __init__(self, overlap: float, misses: int):
        self.tracker, self.forgets, self.last = Tracker(overlap, misses), misses + 1, None

    def __call__(self, frame: int, boxes: np.ndarray) -> list[int]:
        for _ in range(0 if self.last is None else min(frame - self.last - 1, self.forgets)):
            self.tracker.step(boxes[:0])
        self.last = frame
        return self.tracker.step(boxes)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns."""
    differs = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        differs |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(differs) + 1]) if len(columns[0]) else np.zeros(0, int)


def ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each of begins on, so many each."""
    return np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)


def renumbered(ids: np.ndarray, known: np.ndarray, first: int, names: np.ndarray, after: int) -> np.ndarray:
    """Numbers of a piece's tracks as those of the whole: known ones, which it began with, have names; from first on they go on with after. 0 stays."""
    at = np.searchsorted(known, ids).clip(0, max(len(known) - 1, 0))
    old = names[at] if len(known) else np.zeros_like(ids)
    return np.where(ids == 0, 0, np.where(ids >= first, ids - first + after, old))


#: Rows that a task of trackers by blocks works on together.
HELD = 200_000
#: Frame numbers of a block of a source's frames, and of those before it that it begins with.
TRACK_BLOCK, WARM_UP = 8192, 1024
_ANSWER = {"first_frame": "long", "last_frame": "long", "enters": "string", "entered": "array<long>", "first_id": "long", "leaves": "string", "left": "array<long>", "next_id": "long"}


class _Numbers:
    """The blocks of one source in order: which track of the source each track of a block is. met: the block began with the very tracks that the one before it ended with."""

    def __init__(self):
        self.next, self.known, self.leaves, self.last = None, [], "", None

    def row(self, r: dict) -> list[tuple]:
        first = self.next is None
        self.next = int(r["first_id"]) if first else self.next
        forgotten = not first and r["forgets"] is not None and r["first_frame"] - self.last > r["forgets"] and not len(r["entered"])
        met = first or forgotten or self.leaves == r["enters"]
        known = dict(zip(map(int, r["entered"]), self.known)) if met and not first and not forgotten else {}
        out = (r["__source"], r["__block"], met, list(known), list(known.values()), r["first_id"], self.next)
        shift = self.next - int(r["first_id"])
        self.known = [known[n] if n in known else n + shift for n in map(int, r["left"])]
        self.next, self.leaves, self.last = int(r["next_id"]) + shift, r["leaves"], r["last_frame"]
        return [out]

    def end(self) -> list[tuple]:
        return []


def gathered(batches: Iterator[pd.DataFrame], rows: int = HELD) -> Iterator[pd.DataFrame]:
    """The same rows in larger batches."""
    some: list[pd.DataFrame] = []
    for b in batches:
        some.append(b)
        if sum(map(len, some)) >= rows:
            yield pd.concat(some, ignore_index=True)
            some = []
    if some:
        yield pd.concat(some, ignore_index=True)


def _by_blocks(rows: DataFrame, names: list[str], track: Callable[[], Callable[..., list[int]]], look: str | None, size: int) -> DataFrame:
    """names, the number that the block's tracker gives to each row, and a row a block, without a number, that says what tracks it began and ended with. rows: sorted by __source and __block, with __warm for the frames that
    stand before the block. A task holds some HELD rows and one frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known, held, answer = None, None, None, None

        def filled(b: pd.DataFrame) -> pd.DataFrame:
            return b.assign(**{c: None for c in columns if c not in b})[columns]

        def said() -> tuple:
            t = known.tracker
            return t.digest(), t.of[:, 0].tolist(), t.next

        def done(frame: int | None) -> pd.DataFrame:
            leaves, left, after = said()
            return filled(pd.DataFrame({"__source": [now[0]], "__block": [now[1]], **{f"__{n}": [v] for n, v in zip(_ANSWER, (answer[0], frame, *answer[1:], leaves, left, after), strict=True)}}))

        columns, last = [*names, "__source", "__block", "__number", *[f"__{n}" for n in _ANSWER]], None

        def ids(b: pd.DataFrame, begins: np.ndarray) -> Iterator[pd.DataFrame]:
            nonlocal now, known, answer, last
            boxes, keys = b[["x", "y", "w", "h"]].to_numpy(float), list(zip(b["__source"].to_numpy()[begins].tolist(), b["__block"].to_numpy()[begins].tolist(), strict=True))
            frames, warm, numbers = b["frame_id"].to_numpy()[begins].tolist(), b["__warm"].to_numpy(bool), []
            more = [np.stack(b[look].to_numpy()).astype(float)] if look else []
            ends = [*begins[1:].tolist(), len(b)]
            parts = starts(np.array([k[0] for k in keys], object), np.array([k[1] for k in keys]), warm[begins]).tolist()
            for p, q in zip(parts, [*parts[1:], len(keys)], strict=True):
                if keys[p] != now:
                    if answer:
                        yield done(last)
                    now, known, answer = keys[p], track(), None
                i, j = int(begins[p]), ends[q - 1]
                if not warm[i]:
                    answer = answer or (frames[p], *said())
                if hasattr(known, "many"):
                    numbers += known.many(np.array(frames[p:q]), boxes[i:j], begins[p:q] - i, *[m[i:j] for m in more])
                else:
                    for frame, a, z in zip(frames[p:q], begins[p:q].tolist(), ends[p:q], strict=True):
                        numbers += known(frame, boxes[a:z], *[m[a:z] for m in more])
                last = frames[q - 1]
            yield filled(b.assign(__number=numbers)[(np.array(numbers) > 0) & ~warm])

        for b in gathered(batches):
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            begins = starts(b["__source"].to_numpy(), b["__block"].to_numpy(), b["frame_id"].to_numpy())
            if len(begins):
                held = b.iloc[begins[-1] :]
            if len(begins) > 1:  # the last frame may go on
                yield from ids(b.iloc[: begins[-1]], begins[:-1])
        if held is not None and len(held):
            yield from ids(held, np.zeros(1, int))
        if answer:
            yield done(last)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.repartition(keyed.tasks_for(rows), "__source", "__block").sortWithinPartitions("__source", "__block", *ORDER).mapInPandas(run, ", ".join([schema, "__source string, __block long, __number long", *[f"__{n} {kind}" for n, kind in _ANSWER.items()]]))


def tracked(dets: DataFrame, track: Callable[[], Callable[..., list[int]]], look: str | None = None, size: int = TRACK_BLOCK, warm_up: int = WARM_UP) -> DataFrame:
    """The detections with the track_id that a source's track gives to each (number 0: it goes), frame by frame in order; rows of no source are one source, rows of no frame go. track() takes a frame and its boxes, and
    with look what else is known of each; its tracker's digest() says all that its answers to further frames rest on, but for the numbers.

    A source's frames are cut into blocks, each with a tracker of its own that begins some frames before the block, without any tracks. Tracks end, and once those are gone that only one of two trackers knew
    the two go on alike. So where each block begins with the very tracks that the one before ended with, the blocks' answers are those of one tracker, but for the numbers, which a row a block puts right. The sources of
    which that isn't true go through one tracker each."""
    source = F.concat(F.when(F.col("source_id").isNull(), "none").otherwise("source "), F.coalesce("source_id", F.lit("")))
    names = [c for c in dets.columns if c != look]
    rows = dets.dropna(subset=["frame_id"]).withColumn("__source", source)
    forgets = F.lit(getattr(track(), "forgets", None)).cast("long")
    block = F.floor(F.col("frame_id") / size)
    mine, after = F.struct(block.alias("block"), F.lit(False).alias("warm")), F.struct((block + 1).alias("block"), F.lit(True).alias("warm"))
    cut = rows.withColumn("__at", F.explode(F.when(F.pmod(F.col("frame_id"), F.lit(size)) >= size - warm_up, F.array(mine, after)).otherwise(F.array(mine))))
    cut = cut.withColumns({"__block": F.col("__at.block").cast("long"), "__warm": F.col("__at.warm")}).drop("__at")
    found = stored(_by_blocks(cut, names, track, look, size), "tracks")
    answers = found.filter("__number is null").select("__source", "__block", *[F.col(f"__{n}").alias(n) for n in _ANSWER], forgets.alias("forgets"))
    blocks = stored(keyed.fold(answers, ["__source"], ["__block"], _Numbers, "__source string, __block long, met boolean, mine array<long>, theirs array<long>, first_id long, base long"), "blocks")
    apart = blocks.filter("not met").select("__source").distinct()
    number = F.when(F.col("__number") >= F.col("first_id"), F.col("__number") - F.col("first_id") + F.col("base")).otherwise(F.get("theirs", (F.array_position("mine", F.col("__number")) - 1).cast("int")))
    track_id = F.concat(F.coalesce("source_id", F.lit("None")), F.lit("_"), number.cast("string")).alias("track_id")
    whole = found.filter("__number is not null").join(blocks, ["__source", "__block"])
    if apart.isEmpty():
        return whole.select(*names, track_id)
    one = rows.join(apart, "__source", "left_semi").withColumns({"__block": F.lit(0).cast("long"), "__warm": F.lit(False)})
    one = _by_blocks(one, names, track, look, size).filter("__number is not null").withColumns({"first_id": F.lit(0), "base": F.lit(0), "mine": F.array().cast("array<long>"), "theirs": F.array().cast("array<long>")})
    return whole.join(apart, "__source", "left_anti").select(*names, track_id).unionByName(one.select(*names, track_id))


def sort_tracks(dets: DataFrame, overlap: float = 0.3, misses: int = 3, **blocks: int) -> DataFrame:
    """track_id of each detection, unique by source. A source's frames stream in order through trackers, as in tracked(); a task holds the boxes of one frame and
    the tracks that are alive."""
    return tracked(dets, lambda: _Sort(overlap, misses), **blocks)

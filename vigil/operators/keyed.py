"""Rules with a memory of bounded size, run over each key's rows in order: rows stream through a task after one shuffle and sort, so that a key of
any length needs no more memory than its state. Waiting requests and stored evidence are such rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Rule(Protocol):
    def row(self, r: dict[str, Any]) -> list[tuple]: ...

    def end(self) -> list[tuple]: ...


#: Bytes of input that one task takes.
TASK_BYTES = 128 << 20


def tasks_for(rows: DataFrame) -> int:
    """Tasks of about TASK_BYTES of the tables that rows come from, and no fewer than the session's shuffle partitions; no job runs. (What the optimizer
    says of the rows themselves is no use: without statistics it takes a join for a product.)"""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(least, -(-size // TASK_BYTES)) if size < 1 << 60 else least


def fold(rows: DataFrame, key: list[str], order: list[str | Column], start: Callable[[], Rule], schema: str | StructType) -> DataFrame:
    """What start()'s rule says of each row of a key, in order, and at the key's end. Rows without a key go."""
    names = schema.names if isinstance(schema, StructType) else [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rule = None, None
        for b in batches:
            out, columns = [], list(b.columns)
            at = [columns.index(k) for k in key]
            for values in b.itertuples(index=False, name=None):
                k = tuple(values[i] for i in at)
                if k != now:
                    out += rule.end() if rule else []
                    now, rule = k, start()
                out += rule.row(dict(zip(columns, values, strict=True)))
            yield pd.DataFrame(out, columns=names)
        if rule:
            yield pd.DataFrame(rule.end(), columns=names)

    return rows.dropna(subset=key).repartition(tasks_for(rows), *key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


class Waiting:
    """A queue of requests. What may stand in it at once depends on the policy: one a source (the latest), one an object (the best; an equal one
    doesn't replace it), each anchored request, or each request, the oldest of which makes room. Other requests are rejected when it is full."""

    def __init__(self, capacity: int):
        self.capacity, self.held = max(1, capacity), {}

    @staticmethod
    def place(r: dict) -> tuple:
        """An object without a name stands for its track, one without a track for its request."""
        if r["policy"] == "latest_per_source":
            return "source", r["source_id"]
        if r["policy"] == "best_per_object":
            return "object", next(str(r[k]) for k in ("object_id", "track_key", "request_id") if r[k] is not None)
        return "request", r["policy"], r["request_id"]

    def _leave(self, place: tuple, outcome: str) -> tuple:
        r = self.held.pop(place)
        return r["queue"], r["request_id"], outcome

    def row(self, r: dict) -> list[tuple]:
        out = [self._leave(p, "expired") for p in [p for p, h in self.held.items() if h["expire_us"] <= r["created_us"]]]
        place = self.place(r)
        if len(self.held) >= self.capacity:
            if r["policy"] == "drop_oldest":
                out.append(self._leave(min(self.held, key=lambda p: self.held[p]["created_us"]), "dropped"))
            elif place not in self.held:
                return [*out, (r["queue"], r["request_id"], "rejected")]
        if place in self.held:
            better = r["policy"] == "latest_per_source" or r["policy"] == "best_per_object" and r["quality"] > self.held[place]["quality"]
            if not better:
                return [*out, (r["queue"], r["request_id"], "not_better")]
            out.append(self._leave(place, "replaced"))
        self.held[place] = r
        return out

    def end(self) -> list[tuple]:
        return [self._leave(p, "waiting") for p in list(self.held)]


def scheduled(requests: DataFrame, capacity: int = 100) -> DataFrame:
    """queue, request_id, outcome (waiting, replaced, not_better, dropped, rejected, expired) of every request. requests: queue, request_id,
    policy, source_id, object_id, quality, created_us, expire_us, and track_key where there is one."""
    track = F.col("track_key") if "track_key" in requests.columns else F.lit(None).cast("string").alias("track_key")
    rows = requests.select("queue", "request_id", "policy", "source_id", "object_id", track, "quality", "created_us", "expire_us").fillna({"quality": 0.0})
    return fold(rows, ["queue"], ["created_us", "request_id"], lambda: Waiting(capacity), "queue string, request_id long, outcome string")


class Store:
    """Evidence that waits for its answer: so many pieces a source and so many bytes in all, each request once; what has expired makes room."""

    def __init__(self, per_source: int, total_bytes: int):
        self.per_source, self.total_bytes, self.held, self.bytes, self.count = max(1, per_source), max(1, total_bytes), {}, 0, {}

    def row(self, r: dict) -> list[tuple]:
        for i in [i for i, h in self.held.items() if h["expire_us"] <= r["created_us"]]:
            h = self.held.pop(i)
            self.bytes -= h["size_bytes"]
            self.count[h["source_id"]] -= 1
        full = self.count.get(r["source_id"], 0) >= self.per_source or self.bytes + r["size_bytes"] > self.total_bytes
        admitted = not full and r["request_id"] not in self.held
        if admitted:
            self.held[r["request_id"]] = r
            self.bytes += r["size_bytes"]
            self.count[r["source_id"]] = self.count.get(r["source_id"], 0) + 1
        return [(r["store"], r["request_id"], admitted)]

    def end(self) -> list[tuple]:
        return []


def admitted(evidence: DataFrame, per_source: int = 30, total_bytes: int = 128 << 20) -> DataFrame:
    """store, request_id, admitted. evidence: store, request_id, source_id, size_bytes, created_us, expire_us."""
    rows = evidence.select("store", "request_id", "source_id", "size_bytes", "created_us", "expire_us").fillna({"size_bytes": 0})
    return fold(rows, ["store"], ["created_us", "request_id"], lambda: Store(per_source, total_bytes), "store string, request_id long, admitted boolean")


class Candidates:
    """A store of candidates that wait for their answer, of bounded size: a new one is refused when it is full. The first answer before the deadline
    confirms (and so publishes) or rejects, each request once; a deadline that passes times out. What is decided stays so and makes room."""

    def __init__(self, capacity: int):
        self.capacity, self.pending = max(1, capacity), {}

    def _late(self, us: int) -> list[tuple]:
        gone = sorted((int(r["deadline_us"]), k) for k, r in self.pending.items() if r["deadline_us"] <= us)
        return [(self.pending.pop(k)["store"], k, "timed_out", at) for at, k in gone]

    def row(self, r: dict) -> list[tuple]:
        out, k = self._late(r["us"]), r["candidate_id"]
        if r["occurred"] is None:
            if len(self.pending) >= self.capacity or k in self.pending:
                return [*out, (r["store"], k, "refused", r["us"])]
            self.pending[k] = r
        elif k in self.pending:
            out.append((self.pending.pop(k)["store"], k, "published" if r["occurred"] else "rejected", r["us"]))
        return out

    def end(self) -> list[tuple]:
        return [(r["store"], k, "pending", r["us"]) for k, r in self.pending.items()]


def decided(candidates: DataFrame, results: DataFrame, capacity: int = 1000) -> DataFrame:
    """store, candidate_id, status (published, rejected, timed_out, refused, pending), us (of the decision). candidates: store, candidate_id, us,
    deadline_us; results: store, candidate_id, us, occurred. At one instant candidates come before results."""
    c = candidates.select("store", "candidate_id", "us", "deadline_us", F.lit(None).cast("boolean").alias("occurred"))
    r = results.filter("occurred is not null").select("store", "candidate_id", "us", F.lit(None).cast("long").alias("deadline_us"), "occurred")
    return fold(c.unionByName(r), ["store"], ["us", F.col("occurred").isNotNull(), "candidate_id"], lambda: Candidates(capacity), "store string, candidate_id long, status string, us long")


class Verification:
    """One life of an object whose label a language model is to verify. A request goes out when none waits and nothing is verified, or on a frame that is
    looked at when the quality beats the best one asked about by over 0.03. An answer to the request that waits counts, a broken one only ends the wait.
    The label is published when the object expires, or by an answer that comes in time after that."""

    def __init__(self, wait_us: int, frame_us: int):
        self.wait, self.frame = wait_us, frame_us
        self.pending = self.label = self.deadline = None
        self.best, self.over = 0.0, False

    def seen(self, frame: int, looked: bool, quality: float) -> None:
        if (self.label is None and self.pending is None) or (looked and quality > self.best + 0.03):
            self.pending, self.best = frame, quality

    def expires(self, frame: int, us: int) -> tuple | None:
        if self.label:
            self.over = True
            return (frame, *self.label)
        self.over, self.deadline = self.pending is None, us + self.wait
        return None

    def answered(self, frame: int, us: int, result: str | None) -> tuple | None:
        if frame != self.pending:
            return None
        self.pending = None
        if not result:
            return None
        self.label = (frame, result)
        if self.deadline is None:
            return None
        self.over = True
        return (-(-us // self.frame), *self.label) if us <= self.deadline else None

    def row(self, r: dict) -> list[tuple]:
        if self.over:
            return []
        if r["turn"] == 1:
            self.seen(r["frame_id"], r["looked"], r["quality"])
            return []
        got = self.expires(r["frame_id"], r["us"]) if r["turn"] == 2 else self.answered(r["frame_id"], r["us"], r["result"])
        return [(r["source_id"], r["object_id"], got[0], f"{r['life']}@{got[1]}", got[2])] if got else []

    def end(self) -> list[tuple]:
        return []


def verified(rows: DataFrame, wait_us: int, frame_us: int) -> DataFrame:
    """source_id, object_id, frame_id, request_id, result of each life that ends with a label. rows: life, us, turn, frame_id, and of turn 1 (a sighting) looked, quality, source_id and object_id, of
    turn 0 (an answer to the request of frame_id) result, null if it is broken; turn 2 is the life's end. Of one time they come by turn, then frame. Rows without a life go."""
    schema = "source_id string, object_id string, frame_id long, request_id string, result string"
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        life = owner = rule = None
        for b in batches:
            if not b.num_rows:
                continue
            lives, results = b["life"], b["result"]
            new = [lives[0].as_py() != life, *pc.not_equal(lives[1:], lives[:-1]).to_numpy(zero_copy_only=False).tolist()]
            out = []
            for i, (begins, turn, us, frame, looked, quality) in enumerate(zip(new, *(b[c].to_numpy(zero_copy_only=False).tolist() for c in ("turn", "us", "frame_id", "looked", "quality")), strict=True)):
                if begins:
                    life, owner, rule = lives[i].as_py(), None, Verification(wait_us, frame_us)
                if rule.over:
                    continue
                got = None
                if turn == 1:
                    if owner is None:
                        owner = b["source_id"][i].as_py(), b["object_id"][i].as_py()
                    rule.seen(frame, looked, quality)
                elif turn == 2:
                    got = rule.expires(frame, us)
                elif frame == rule.pending:
                    got = rule.answered(frame, us, results[i].as_py())
                if got:
                    out.append((*owner, got[0], f"{life}@{got[1]}", got[2]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names)

    # a hash of the life comes first, as lives' names begin alike
    parted = rows.dropna(subset=["life"]).repartition(tasks_for(rows), "life")
    return parted.sortWithinPartitions(F.xxhash64("life"), "life", "us", "turn", "frame_id").mapInArrow(run, schema)


class Queue:
    """A bounded queue that overwrites its oldest when full. At its end: how many came in, went out, were overwritten, the greatest filling as a share
    of the capacity, and how many came in by second."""

    def __init__(self, capacity: int):
        self.capacity, self.depth, self.most, self.came, self.went, self.lost = max(1, capacity), 0, 0, 0, 0, 0
        self.key = self.first = self.last = None

    def row(self, r: dict) -> list[tuple]:
        self.key, self.last = r["queue"], r["us"]
        self.first = r["us"] if self.first is None else self.first
        if r["push"]:
            self.came += 1
            self.lost += self.depth == self.capacity
            self.depth = min(self.capacity, self.depth + 1)
            self.most = max(self.most, self.depth)
        elif self.depth:
            self.depth, self.went = self.depth - 1, self.went + 1
        return []

    def end(self) -> list[tuple]:
        seconds = max((self.last - self.first) / 1e6, 1e-6)
        return [(self.key, self.came, self.went, self.lost, self.depth, self.depth / self.capacity, self.most / self.capacity, self.came / seconds)]


def queue_metrics(log: DataFrame, capacity: int) -> DataFrame:
    """queue, enqueued, dequeued, overwritten, depth, utilisation, max_utilisation, throughput. log: queue, us, id, push (else: something is taken)."""
    schema = "queue string, enqueued long, dequeued long, overwritten long, depth long, utilisation double, max_utilisation double, throughput double"
    return fold(log.select("queue", "us", "id", "push"), ["queue"], ["us", "id"], lambda: Queue(capacity), schema)

"""What stands around a stream: opening a source, its life (play, pause, resume, stop), retries, replay at natural speed, taps, events to subscribers, and the
order in which an event goes to its sinks."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger("vigil")

#: Fixed value: a paced source never sleeps longer than this.
MOST_SLEEP_MS = 100


def open_source(spark: SparkSession, path: str, stream: bool = False, schema: Any = None, files_per_trigger: int | None = None) -> DataFrame:
    """The frames of a Parquet source, which must exist; as a stream, all its files in one micro-batch unless so many are asked for."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(path)
    if not stream:
        return spark.read.parquet(path)
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def looped(frames: DataFrame, times: int) -> DataFrame:
    """A bounded source that starts again at its end, so often; frame numbers and offsets go on."""
    span = frames.agg((F.max("frame_id") - F.min("frame_id") + 1).alias("__span"))
    rounds = frames.withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).crossJoin(span)  # one row is sent
    return rounds.withColumn("frame_id", F.col("frame_id") + F.col("loop") * F.col("__span")).drop("__span")


def retry(run: Callable[[], Any], most: int = 3, delay_ms: int = 1000, progressed: Callable[[], bool] | None = None, sleep: Callable[[float], None] = time.sleep) -> Any:
    """run(), again after each failure: at once the first time, then after a pause; so many failures in a row are given up. progressed says whether
    anything came through since the last failure, which starts the count anew."""
    failures = 0
    while True:
        try:
            return run()
        except Exception as e:
            failures = 1 if progressed and progressed() else failures + 1
            if failures > most:
                raise
            log.warning("source failed (%d of %d): %s", failures, most, e)
            if failures > 1:
                sleep(delay_ms / 1000)


def pause_ms(offset_ms: float, elapsed_ms: float) -> float:
    """How long a replay waits before a frame."""
    return max(0.0, min(MOST_SLEEP_MS, offset_ms - elapsed_ms))


def paced(offsets_ms: Iterable[float], clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterable[float]:
    """The offsets, each no sooner than at its time, in steps of bounded sleep."""
    start = clock()
    for offset in offsets_ms:
        while (wait := pause_ms(offset, (clock() - start) * 1000)) > 0:
            sleep(wait / 1000)
        yield offset


@dataclass
class Player:
    """A stream from start to end. start(frames) begins a query with a checkpoint, so that pausing stops it and resuming goes on where it was. taps are called
    with each micro-batch, all of them, before the handler."""

    open: Callable[[], DataFrame]
    handle: Callable[[DataFrame, int], None]
    checkpoint: str
    trigger: dict[str, Any] = field(default_factory=lambda: {"availableNow": True})
    taps: list[Callable[[DataFrame, int], None]] = field(default_factory=list)
    retries: int = 3
    delay_ms: int = 1000
    query: StreamingQuery | None = None

    def _batch(self, df: DataFrame, n: int) -> None:
        for tap in self.taps:
            tap(df, n)
        self.handle(df, n)

    def play(self) -> StreamingQuery:
        if self.query is None or not self.query.isActive:
            self.query = self.open().writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(**self.trigger).start()
        return self.query

    resume = play

    def play_to_end(self) -> None:
        """Until a bounded source is at its end; a failure starts the query again from its checkpoint."""
        retry(lambda: self.play().awaitTermination(), self.retries, self.delay_ms)

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()

    def stop(self, seconds: float = 10) -> bool:
        """No new start; what is there already is worked off, for so long at most. Says whether all was."""
        q = self.query
        if q is None or not q.isActive:
            return True
        done = threading.Thread(target=q.processAllAvailable, daemon=True)
        done.start()
        done.join(seconds)
        q.stop()
        return not done.is_alive()


class Bus:
    """Control events (objects and frames that expired, new best snapshots) to whoever wants them, in the order they subscribed."""

    def __init__(self):
        self.subscribers: dict[str, list[Callable[[DataFrame], None]]] = {}

    def subscribe(self, topic: str, handler: Callable[[DataFrame], None]) -> Callable[[], None]:
        """Returns what ends the subscription."""
        held = self.subscribers.setdefault(topic, [])
        held.append(handler)
        return lambda: held.remove(handler) if handler in held else None

    def publish(self, topic: str, events: DataFrame) -> None:
        for handler in list(self.subscribers.get(topic, ())):
            handler(events)


class Dispatcher:
    """Gives each micro-batch of events to artefacts, store, poster and bus, in this order; a sink that fails stops those after it, and is logged. After
    close() nothing new is taken."""

    def __init__(self, *sinks: Callable[[DataFrame], None]):
        self.sinks, self.closed, self.running, self.free = sinks, False, 0, threading.Condition()

    def __call__(self, events: DataFrame, batch: int = 0) -> bool:
        with self.free:
            if self.closed:
                return False
            self.running += 1
        try:
            for sink in self.sinks:
                sink(events)
            return True
        except Exception:
            log.exception("events of batch %d weren't published whole", batch)
            return False
        finally:
            with self.free:
                self.running -= 1
                self.free.notify_all()

    def close(self, seconds: float = 10) -> bool:
        """Refuses new work and waits for what was accepted; says whether that ended in time."""
        with self.free:
            self.closed = True
            return self.free.wait_for(lambda: not self.running, seconds)


def log_events(events: DataFrame) -> None:
    """Each message as a line of the log of the executor that holds it."""

    def lines(batches):
        for b in batches:
            for m in b["message"]:
                log.warning("%s", m)
            yield b.iloc[:0]

    events.select(F.col("message").cast("string")).mapInPandas(lines, "message string").write.format("noop").mode("overwrite").save()

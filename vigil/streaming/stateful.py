"""Structured Streaming forms of the stateful operators: throttle, region access, sessions with emit-on-expiry, windowed counts,
and the JSON sink.

State is per key and of fixed size (the last passing time, a machine's state, one open session), never a key's history. A
micro-batch's rows of a key are ordered by time inside the batch; rows older than the state's time are handled on arrival.
Null keys or times: the row is dropped. Checkpoints and results stand in the shared folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.operators.folds import ACCESS, _Sort, starts
from vigil.operators.keyed import Rule
from vigil.operators.together import sort_ids
from vigil.sources.shared import delete, run_dir


def source(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream, so many in a micro-batch (None: all that are there); the schema is the table's."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/{name}.parque[t]")


#: Rows of a micro-batch of a table that is fed in order.
AT_ONCE = 4_000_000


def in_order(spark: SparkSession, sf_dir: str, name: str, order: Column, rows: int | None = None) -> DataFrame:
    """A table as a stream in order, about so many rows in a micro-batch, so that state is all that grows; rows of one place in order come together. The table is laid out anew in the shared folder, a file a micro-batch;
    the files' times say their order."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    at = f"{run_dir(spark)}/feed-{uuid.uuid4().hex}"
    table.repartitionByRange(max(1, -(-table.count() // (rows or AT_ONCE))), order).write.parquet(at)
    place = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for i, path in enumerate(found):
        files.setTimes(path, 1_000_000_000_000 + 1000 * i, -1)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(at)


def proceed(stream: DataFrame, at: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Runs an append stream over what its source holds now, on from where the last run stopped, and gives the table at this place. conf holds while it starts."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def drain(stream: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Runs an append stream over what its source holds now, to the end, and gives the table it wrote."""
    spark = stream.sparkSession
    at = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = proceed(stream, at, conf)
    delete(spark, f"{at}/state")
    return out


def _ordered(chunks: Iterator[pd.DataFrame], micros: str) -> pd.DataFrame:
    return pd.concat(list(chunks), ignore_index=True).sort_values(micros, kind="stable")


def throttle(stream: DataFrame, key: str, micros: str, interval: int) -> DataFrame:
    """Greedy: key and time of rows that are interval microseconds or more behind the last that passed."""

    def run(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, passed = state.get[0] if state.exists else None, []
        for t in _ordered(chunks, micros)[micros].tolist():
            if last is None or t - last >= interval:
                last = t
                passed.append(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(passed), micros: pd.Series(passed, dtype="int64")})

    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {micros} long"
    return stream.select(key, micros).dropna().groupBy(key).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def fold(stream: DataFrame, key: str, order: list[str], start: Callable[[], Rule], schema: str) -> DataFrame:
    """What a rule of keyed says of each row of a key. Its state, of bounded size by the rule, is carried on; its end never comes."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rule, out = pickle.loads(state.get[0]) if state.exists else start(), []
        rows = pd.concat(list(chunks), ignore_index=True).sort_values(order, kind="stable")
        for values in rows.itertuples(index=False, name=None):
            out += rule.row(dict(zip(rows.columns, values, strict=True)))
        state.update((pickle.dumps(rule),))
        yield pd.DataFrame(out, columns=names)

    return stream.dropna(subset=[key]).groupBy(key).applyInPandasWithState(run, schema, "rule binary", "append", GroupStateTimeout.NoTimeout)


def access_states(stream: DataFrame, key: str, order: str, geometry: str) -> DataFrame:
    """key, order and state of the region-access machine, which starts Outside. A row of no geometry, or of an unknown one, leaves its state."""

    def run(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, states = state.get[0] if state.exists else "Outside", []
        rows = _ordered(chunks, order)
        for g in rows[geometry]:
            now = ACCESS[g][now] if g in ACCESS else now
            states.append(now)
        state.update((now,))
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order].to_numpy(), "state": states})

    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {order} long, state string"
    return stream.select(key, F.col(order).cast("long").alias(order), geometry).dropna(subset=[key, order]).groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def sort_tracks(stream: DataFrame, overlap: float = 0.3, misses: int = 3) -> DataFrame:
    """The detections with track_id, source by source. The state holds the tracks that are alive, whose number the boxes of a few frames bound. A frame
    must not be cut over micro-batches; a late one is taken for the next."""
    order = ["frame_id", "x", "y", "w", "h"]

    def run(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        track = pickle.loads(state.get[0]) if state.exists else _Sort(overlap, misses)
        rows = pd.concat(list(chunks), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        boxes, frames = rows[["x", "y", "w", "h"]].to_numpy(float), rows["frame_id"].to_numpy()
        begins = starts(frames)
        ids = sort_ids(track, frames[begins], boxes, begins)
        state.update((pickle.dumps(track),))
        yield rows.assign(track_id=[f"{k[0]}_{i}" for i in ids.tolist()])

    rows = stream.select("source_id", "frame_id", "label", "x", "y", "w", "h").dropna()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("source_id").applyInPandasWithState(run, f"{schema}, track_id string", "tracker binary", "append", GroupStateTimeout.NoTimeout)


def expired_sessions(stream: DataFrame, key: str, micros: str, gap: int, late: str = "0 seconds") -> DataFrame:
    """One row per session (key, first, last, rows) once it has expired: a row comes gap microseconds or more after it, or the
    watermark passes its last row by that much. Sessions still open stay in the state."""

    def run(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        done = []
        if state.hasTimedOut:
            done.append((k[0], first, last, n))
            state.remove()
        else:
            for t in _ordered(chunks, micros)[micros].tolist():
                if last is not None and t - last >= gap:
                    done.append((k[0], first, last, n))
                    first, last, n = None, None, 0
                first, last, n = t if first is None else min(first, t), t if last is None else max(last, t), n + 1
            state.update((first, last, n))
            state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[key, "first_us", "last_us", "n"])

    schema = f"{key} {stream.schema[key].dataType.simpleString()}, first_us long, last_us long, n long"
    timed = stream.select(key, micros).dropna().withColumn("__at", F.timestamp_micros(micros)).withWatermark("__at", late)
    return timed.groupBy(key).applyInPandasWithState(run, schema, "first_us long, last_us long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str, late: str) -> DataFrame:
    """Rows of a key per tumbling time window, given once the watermark has passed the window."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.unix_micros("w.start").alias("start_us"), "n")


def to_json_rows(rows: DataFrame) -> DataFrame:
    """What the HTTP and datagram sinks send: each row as one JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def post_each(stream: DataFrame, send: Callable[[Iterator[str]], None], checkpoint: str, **trigger):
    """Sends each row's JSON from the executors, partition by partition, at least once. send gets an iterator over texts; what it
    raises fails the batch, which is then tried again from the checkpoint."""

    def batch(df: DataFrame, _: int) -> None:
        to_json_rows(df).foreachPartition(lambda rows: send(r.value for r in rows))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

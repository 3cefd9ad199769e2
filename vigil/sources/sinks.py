"""Where events go: a relational table, day folders of artefacts, datagrams; and what is kept of them.

A stream's batches reach a relational table once, however often they are tried: a batch is staged by the executors, and one transaction merges it by event_id and enters its number in a
ledger. Day folders are a table with versions: a manifest names the files of each version, and a new version is there once its manifest has been renamed into place; a reader keeps to the version that it
began with, and what is written but never named counts for nothing.
"""

from __future__ import annotations

import json
import socket
import uuid
from collections.abc import Callable, Iterator
from contextlib import closing
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import scalars
from vigil.sources.shared import delete, run_dir

#: Columns of a stored event, in order; those after the seventh may be null.
EVENT_COLUMNS = ["event_id", "ts", "source_id", "event_type", "event_name", "algorithm_name", "message", "bucket_name", "image_id", "video_id"]


def stored_events(events: DataFrame) -> DataFrame:
    """The ten columns of a stored event: an id of its content where there is none, its bucket, and nulls for artefacts it lacks."""
    have = set(events.columns)
    df = events
    if "event_id" not in have:
        df = df.withColumn("event_id", F.substring(F.sha2(F.concat_ws("|", "source_id", "event_name", "ts", "message"), 256), 1, 36))
    for c in ("event_type", "image_id", "video_id", "message"):
        if c not in have:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.withColumn("bucket_name", scalars.event_bucket(F.col("algorithm_name"), F.col("ts"))).select(*EVENT_COLUMNS)


def to_jdbc(events: DataFrame, url: str, table: str, properties: dict[str, str], batch: int = 5000) -> None:
    """Appends stored events through JDBC, in batches, a connection a partition. Writing a partition again after a lost executor is safe where the
    table's key is event_id and the URL asks the database to ignore rows it has."""
    stored_events(events).write.option("batchsize", batch).option("isolationLevel", "READ_COMMITTED").jdbc(url, table, "append", properties)


#: SQL of a ledger and of a merge by event_id, for databases that know INSERT ... SELECT; {staged} stands for the rows of the batch.
LEDGER = "CREATE TABLE IF NOT EXISTS {ledger} (name VARCHAR, batch BIGINT, PRIMARY KEY (name, batch))"
MERGE = "INSERT INTO {table} ({columns}) SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS copy FROM {staged}) AS s WHERE copy = 1 AND NOT EXISTS (SELECT 1 FROM {table} AS t WHERE t.event_id = s.event_id)"


def staged_parquet(batch: DataFrame, name: str, number: int) -> str:
    """Stages a batch as Parquet in the shared folder, in place of what an earlier try left; as a relation of databases that read Parquet."""
    place = f"{run_dir(batch.sparkSession)}/staged-{name}-{number}"
    batch.write.mode("overwrite").parquet(place)
    return f"read_parquet('{place.removeprefix('file://')}/*.parquet')"


def staged_jdbc(url: str, properties: dict[str, str]) -> Callable[[DataFrame, str, int], str]:
    """Stages a batch in a table of the database itself, in place of what an earlier try left."""

    def stage(batch: DataFrame, name: str, number: int) -> str:
        batch.write.option("truncate", "true").jdbc(url, f"staged_{name}", "overwrite", properties)
        return f"staged_{name}"

    return stage


def merged(connect: Callable[[], Any], table: str, name: str, stage: Callable[[DataFrame, str, int], str] = staged_parquet, ledger: str = "batches") -> Callable[[DataFrame, int], None]:
    """What foreachBatch does with a batch of stored events: nothing, if the ledger has its number; else the executors stage it, and one transaction merges it and enters the number. connect: a connection
    of the Python database interface, to a table with the columns of stored_events(); only SQL passes through it."""

    def put(batch: DataFrame, number: int) -> None:
        with closing(connect()) as c:
            c.execute(LEDGER.format(ledger=ledger))
            if c.execute(f"SELECT 1 FROM {ledger} WHERE name = '{name}' AND batch = {number}").fetchall():
                return
        staged = stage(stored_events(batch), name, number)
        with closing(connect()) as c:
            c.execute("BEGIN")
            c.execute(MERGE.format(table=table, columns=", ".join(EVENT_COLUMNS), staged=staged))
            c.execute(f"INSERT INTO {ledger} VALUES ('{name}', {number})")
            c.execute("COMMIT")
        if stage is staged_parquet:
            delete(batch.sparkSession, f"{run_dir(batch.sparkSession)}/staged-{name}-{number}")

    return put


class DayFolders:
    """Events as Parquet, a folder a day, in versions. A version is a manifest (a file of its own: lines of day and file); the greatest number holds. Files aren't changed once they are written, so
    that every step either leaves the old version or makes the new one; writers that meet at one number try again on the other's version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._jvm = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        self.fs = self._jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._jvm.Path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def version(self) -> int:
        """The newest one; 0: there is none yet."""
        return max((int(n[:-5]) for n in self._names(f"{self.path}/versions") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[tuple[str, str]]:
        """(day, file) of a version."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self._jvm.Path(f"{self.path}/versions/{version:012d}.json"))
        with closing(stream):
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        return [tuple(x) for x in map(json.loads, text.splitlines())]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The events of a version, and their day; None, if there are none. Later versions don't change what it gives."""
        files = [f"{self.path}/{f}" for _, f in self.manifest(version)]
        return self.spark.read.parquet(*files) if files else None

    def _commit(self, change: Callable[[list[tuple[str, str]]], list[tuple[str, str]]], version: int | None = None) -> int:
        while True:
            old = self.version() if version is None else version
            lines = "\n".join(json.dumps(x) for x in change(self.manifest(old)))
            temporary, place = self._jvm.Path(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._jvm.Path(f"{self.path}/versions/{old + 1:012d}.json")
            stream = self.fs.create(temporary, False)
            with closing(stream):
                stream.write(bytearray(lines.encode()))
            if not self.fs.exists(place) and self.fs.rename(temporary, place):
                return old + 1
            self.fs.delete(temporary, False)
            if version is not None:
                raise RuntimeError("another writer was first")

    def _write(self, events: DataFrame) -> list[tuple[str, str]]:
        """Writes files, which no version names yet."""
        folder = f"data/{uuid.uuid4().hex}"
        day = F.date_format("ts", "yyyyMMdd")
        events.withColumns({"day": day, "on": day}).write.partitionBy("on").parquet(f"{self.path}/{folder}")
        days = [d for d in self._names(f"{self.path}/{folder}") if d.startswith("on=")]
        return [(d[3:], f"{folder}/{d}/{n}") for d in days for n in self._names(f"{self.path}/{folder}/{d}") if n.endswith(".parquet")]

    def append(self, events: DataFrame) -> int:
        new = self._write(events)
        return self._commit(lambda held: held + new)

    def load(self, event_id: str) -> DataFrame | None:
        """The stored event of an id."""
        held = self.read()
        return held if held is None else held.filter(F.col("event_id") == event_id)

    def delete(self, ids: DataFrame) -> int:
        """Leaves out the events of these ids (event_id): files that hold any are written anew without them, other files stay as they are."""
        version = self.version()
        held = self.read(version)
        if held is None:
            return version
        name = F.substring_index(F.input_file_name(), "/", -1)
        marked = held.withColumn("__file", name).join(ids.select("event_id").distinct().withColumn("__goes", F.lit(True)), "event_id", "left")
        hit = {r[0] for r in marked.filter("__goes").select("__file").distinct().collect()}  # names of files
        if not hit:
            return version
        touched = [f for _, f in self.manifest(version) if f.rsplit("/", 1)[1] in hit]
        left = self.spark.read.parquet(*[f"{self.path}/{f}" for f in touched]).join(ids.select("event_id"), "event_id", "left_anti")
        new = self._write(left)
        return self._commit(lambda old: [x for x in old if x[1] not in touched] + new, version)

    def expire(self, today: date, days: int) -> int:
        """Leaves out the days that are over so many days old; how many went. Nothing but the manifest is read."""
        old = {d for d, _ in self.manifest() if d.isdigit() and (today - datetime.strptime(d, "%Y%m%d").date()).days > days}
        if old:
            self._commit(lambda held: [x for x in held if x[0] not in old])
        return len(old)

    def tidy(self) -> int:
        """Deletes the files that the newest version doesn't name, and older manifests: for when no one reads an older version, and no one writes. How many files went."""
        version, gone = self.version(), 0
        named = {f for _, f in self.manifest(version)}
        for folder in self._names(f"{self.path}/data"):
            mine = [f"data/{folder}/{d}/{n}" for d in self._names(f"{self.path}/data/{folder}") if d.startswith("on=") for n in self._names(f"{self.path}/data/{folder}/{d}") if n.endswith(".parquet")]
            if not named.intersection(mine):
                gone += len(mine)
                self.fs.delete(self._jvm.Path(f"{self.path}/data/{folder}"), True)
                continue
            for f in set(mine) - named:
                gone += bool(self.fs.delete(self._jvm.Path(f"{self.path}/{f}"), False))
        for n in self._names(f"{self.path}/versions"):
            if n != f"{version:012d}.json":
                self.fs.delete(self._jvm.Path(f"{self.path}/versions/{n}"), False)
        return gone


def expired_days(events: DataFrame, today, days: int) -> DataFrame:
    """The days of day folders that are over so many days old."""
    return events.select("day").distinct().filter(F.datediff(F.lit(today).cast("date"), F.to_date(F.col("day").cast("string"), "yyyyMMdd")) > days)


def send_datagrams(lines: DataFrame, host: str, port: int) -> int:
    """Sends each line as a datagram, from the executors; how many were sent."""

    def run(batches: Iterator) -> Iterator:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for b in batches:
                for line in b.column(0).to_pylist():
                    s.sendto((line or "").encode(), (host, port))
                yield _count(b.num_rows)

    return lines.select(lines.columns[0]).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _count(n: int):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

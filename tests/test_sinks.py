"""A relational table fed by a stream that fails half way, and day folders whose driver is lost between any two steps."""

from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from vigil.sources import sinks

EVENTS = "event_id string, ts timestamp, source_id string, event_name string, algorithm_name string, message string"


def events(spark, ids, day=1):
    return spark.createDataFrame([(f"e{i}", datetime(2024, 1, day, 1), "s", "n", "Alg One", "m") for i in ids], EVENTS)


@pytest.fixture
def table(tmp_path):
    """An embedded database with the table of stored events."""
    path = f"{tmp_path}/events.db"
    with duckdb.connect(path) as c:
        c.execute("CREATE TABLE events (event_id VARCHAR PRIMARY KEY, ts TIMESTAMP, source_id VARCHAR, event_type VARCHAR, event_name VARCHAR, algorithm_name VARCHAR, message VARCHAR, bucket_name VARCHAR, image_id VARCHAR, video_id VARCHAR)")
    return lambda: duckdb.connect(path)


def held(table):
    with table() as c:
        return [r[0] for r in c.execute("SELECT event_id FROM events ORDER BY 1").fetchall()]


def test_a_batch_that_is_tried_again_is_stored_once(spark, table):
    put = sinks.merged(table, "events", "stream")
    put(events(spark, [1, 2, 2]), 0)  # a repeated event within a batch
    put(events(spark, [1, 2, 2]), 0)  # the same batch again
    put(events(spark, [2, 3]), 1)  # an event that an earlier batch held
    assert held(table) == ["e1", "e2", "e3"]


@pytest.mark.parametrize("broken", ["stage", "merge", "ledger", "after"])
def test_a_stream_that_fails_half_way(spark, tmp_path, table, broken):
    """It stops while it stages, merges or enters the batch, or when all is done but Spark doesn't know it; started again, each event is there once."""
    for i in range(3):
        events(spark, [10 * i, 10 * i + 1]).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    failed = []

    class Breaks:
        def __init__(self, c):
            self.c = c

        def execute(self, sql):
            words = {"merge": "INSERT INTO events", "ledger": "INSERT INTO batches"}
            if broken in words and sql.startswith(words[broken]) and not failed:
                failed.append(broken)
                raise OSError("lost")
            return self.c.execute(sql)

        def close(self):
            self.c.close()

    def stage(batch, name, number):
        place = sinks.staged_parquet(batch, name, number)
        if broken == "stage" and not failed:
            failed.append(broken)
            raise OSError("lost")
        return place

    put = sinks.merged(lambda: Breaks(table()), "events", "s", stage)

    def batch(df, number):
        put(df, number)
        if broken == "after" and not failed and number == 1:
            failed.append(broken)
            raise OSError("lost")

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert held(table) == [f"e{i}" for i in (0, 1, 10, 11, 20, 21)]


def ids_of(df):
    return sorted(r.event_id for r in df.collect())


def test_readers_keep_to_their_version(spark, tmp_path):
    days = sinks.DayFolders(spark, f"{tmp_path}/days")
    days.append(sinks.stored_events(events(spark, [1, 2], 1)))
    days.append(sinks.stored_events(events(spark, [3], 2)))
    before = days.read()
    days.delete(spark.createDataFrame([("e1",), ("e3",)], "event_id string"))
    assert ids_of(before) == ["e1", "e2", "e3"] and ids_of(days.read(2)) == ["e1", "e2", "e3"] and ids_of(days.read()) == ["e2"]
    assert days.delete(spark.createDataFrame([("nowhere",)], "event_id string")) == days.version()
    assert days.expire(date(2024, 2, 1), 7) == 1 and days.read() is None
    days.append(sinks.stored_events(events(spark, [5], 3)))
    assert days.tidy() > 0 and days.tidy() == 0 and ids_of(days.read()) == ["e5"]
    assert days.read().select(F.max("day")).first()[0] == "20240103"


@pytest.mark.parametrize("step", ["_write", "create", "rename"])
def test_a_driver_that_is_lost_between_any_two_steps(spark, tmp_path, step):
    days = sinks.DayFolders(spark, f"{tmp_path}/days")
    days.append(sinks.stored_events(events(spark, [1, 2], 1)))
    broken = sinks.DayFolders(spark, f"{tmp_path}/days")

    class Lost:
        def __getattr__(self, name):
            if name == step:
                raise OSError("lost")
            return getattr(days.fs, name)

    if step == "_write":
        whole = broken._write

        def write(df):
            whole(df)
            raise OSError("lost")

        broken._write = write
    else:
        broken.fs = Lost()
    gone = spark.createDataFrame([("e1",)], "event_id string")
    with pytest.raises(OSError, match="lost"):
        broken.delete(gone)
    assert ids_of(days.read()) == ["e1", "e2"]  # the old version is whole
    days.delete(gone)
    assert ids_of(days.read()) == ["e2"]
    days.tidy()
    assert ids_of(days.read()) == ["e2"]


def test_two_writers_at_once(spark, tmp_path):
    """The one that comes second takes up the other's version; a deletion that was overtaken says so."""
    one, two = (sinks.DayFolders(spark, f"{tmp_path}/days") for _ in range(2))
    one.append(sinks.stored_events(events(spark, [1], 1)))
    late = two._commit

    def overtaken(change, version=None):
        two._commit = late
        one.append(sinks.stored_events(events(spark, [2], 1)))
        return late(change, version)

    two._commit = overtaken
    two.append(sinks.stored_events(events(spark, [3], 1)))
    assert ids_of(one.read()) == ["e1", "e2", "e3"]
    two._commit = overtaken
    with pytest.raises(RuntimeError, match="first"):
        two.delete(spark.createDataFrame([("e1",)], "event_id string"))
    two.delete(spark.createDataFrame([("e1",)], "event_id string"))
    assert ids_of(one.read()) == ["e2", "e2", "e3"]

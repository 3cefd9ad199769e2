import itertools
import random

import pandas as pd

from tests.test_engine import SF, rows_of
from vigil.operators import frames
from vigil.plans import streams  # noqa: F401
from vigil.plans.queries import QUERIES
from vigil.sources import views
from vigil.streaming import stateful


def test_throttle_state_outlives_a_micro_batch(spark, tmp_path):
    times = random.Random(4).sample(range(1000), 120)
    for i, part in enumerate([sorted(times)[:50], sorted(times)[50:]]):
        spark.createDataFrame([("a", t) for t in part] + [(None, 1)], "k string, us long").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema("k string, us long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    got = sorted(r.us for r in stateful.drain(stateful.throttle(stream, "k", "us", 40), "t").collect())
    want = []
    for t in sorted(times):
        if not want or t - want[-1] >= 40:
            want.append(t)
    assert got == want


def test_access_states_as_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, "in"), ("a", 2, "in"), ("a", 3, "mixed_out"), ("a", 4, "out"), ("b", 1, "mixed_out"), (None, 1, "in")], "k string, at long, g string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, at long, g string").parquet(f"{tmp_path}/in")
    got = {(r.k, r.at): r.state for r in stateful.drain(stateful.access_states(stream, "k", "at", "g"), "a").collect()}
    assert got == {("a", 1): "Entering", ("a", 2): "Inside", ("a", 3): "Leaving", ("a", 4): "Outside", ("b", 1): "Outside"}


def test_merges_differ_as_described():
    a, b, c = (0, 0, 10, 10), (4, 0, 10, 10), (9, 0, 10, 10)
    assert frames.merge_first([a, c, b], 0.3) == [(0, 0, 14, 10), c]
    assert frames.merge_forward([a, c, b], 0.3) == [(0, 0, 14, 10), c]
    assert frames.merge_forward([a, b, c], 0.2) == [(0, 0, 19, 10)]
    assert frames.merge_all([a, c, b], 0.2) == [(0, 0, 19, 10)]
    assert frames.merge_largest([a, (0, 0, 11, 10)], 0.99) == [(0, 0, 11, 10), a]
    assert frames.merge_all([], 0.5) == []


def test_stitching(spark):
    rows = [("s", 1, "boat", 0, 0.5, 50, 10, 50, 40), ("s", 1, "boat", 7, 0.9, 100, 10, 50, 40), ("s", 1, "car", 3, 0.8, 101, 10, 50, 40), ("s", 2, "boat", 2, 0.7, 100, 10, 50, 40)]
    df = spark.createDataFrame(rows, "source_id string, frame_id long, label string, tracking_id int, confidence double, x int, y int, w int, h int")
    got = sorted(tuple(r) for r in frames.stitched(df, 200, 200, 2, 1).collect())
    assert got == sorted([("s", 1, "boat", 7, 0.9, 50, 10, 100, 40, 2), ("s", 1, "car", 3, 0.8, 101, 10, 50, 40, 1), ("s", 2, "boat", 2, 0.7, 100, 10, 50, 40, 1)])
    assert frames.stitched(df.limit(0), 200, 200, 2, 1).count() == 0


def test_frames_over_batch_borders_equal_a_plain_pass(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = rows_of(QUERIES["box_merge_forward"](spark, SF).toPandas())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    d = views.detections(spark, SF).select("source_id", "frame_id", "x", "y", "w", "h").collect()
    want = []
    for k, g in itertools.groupby(sorted(map(tuple, d)), key=lambda r: r[:2]):
        want += [(*k, *m) for m in frames.merge_forward([r[2:] for r in g], 0.15)]
    assert got == rows_of(pd.DataFrame(want, columns=["source_id", "frame_id", "x", "y", "w", "h"]))

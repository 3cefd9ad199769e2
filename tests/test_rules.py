"""Rules of several steps, requests, shapes, tracking by appearance and pipelines by configuration."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from tests.test_engine import SF
from vigil.functions import scalars, shapes
from vigil.functions.geometry import Box, in_known_polygon, in_polygon
from vigil.operators import appearance, folds, keyed, rules
from vigil.operators.appearance import AppearanceTracker
from vigil.plans import pipelines, shipped
from vigil.sources import sinks, views
from vigil.streaming import stateful


@pytest.mark.parametrize("points", [[(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)], [(1, 1), (6, 2), (3, 7)], [(0, 0), (5, 5), (5, 0), (0, 5)]])
def test_known_polygon_equals_polygon(spark, points):
    df = spark.createDataFrame([(x / 2, y / 2) for x in range(-2, 16) for y in range(-2, 16)], "px double, py double")
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])
    assert df.filter(in_known_polygon(F.col("px"), F.col("py"), points) != in_polygon(F.col("px"), F.col("py"), pts)).count() == 0


def _request(i, policy, created, quality=0.0, source="s", obj="o", ttl=1000):
    return ("q", i, policy, source, obj, quality, created, created + ttl)


REQUEST = "queue string, request_id long, policy string, source_id string, object_id string, quality double, created_us long, expire_us long"


@pytest.mark.parametrize(
    "rows, capacity, want",
    [
        ([_request(1, "latest_per_source", 1), _request(2, "latest_per_source", 2)], 5, {1: "replaced", 2: "waiting"}),
        ([_request(1, "best_per_object", 1, 0.5), _request(2, "best_per_object", 2, 0.5), _request(3, "best_per_object", 3, 0.6)], 5, {1: "replaced", 2: "not_better", 3: "waiting"}),
        ([_request(1, "anchored", 1), _request(2, "anchored", 2), _request(3, "anchored", 3)], 2, {1: "waiting", 2: "waiting", 3: "rejected"}),
        ([_request(1, "anchored", 1), _request(2, "drop_oldest", 2), _request(3, "drop_oldest", 3)], 2, {1: "dropped", 2: "waiting", 3: "waiting"}),
        ([_request(1, "anchored", 1, ttl=5), _request(2, "anchored", 6)], 1, {1: "expired", 2: "waiting"}),
        ([_request(1, "latest_per_source", 1), _request(2, "latest_per_source", 2)], 1, {1: "replaced", 2: "waiting"}),
    ],
)
def test_requests(spark, rows, capacity, want):
    got = keyed.scheduled(spark.createDataFrame(rows, REQUEST), capacity).collect()
    assert {r.request_id: r.outcome for r in got} == want and len(got) == len(rows)


def test_requests_of_no_queue_and_of_none(spark):
    rows = [(None, 1, "anchored", "s", "o", 0.1, 1, 9)]
    assert keyed.scheduled(spark.createDataFrame(rows, REQUEST)).count() == 0
    assert keyed.scheduled(spark.createDataFrame([], REQUEST)).count() == 0


def test_evidence_is_admitted_as_by_plain_counting(spark):
    rnd, rows = random.Random(3), []
    for i in range(400):
        t = 10 * i
        rows.append((rnd.choice("ab"), rnd.randrange(350), rnd.choice("xyz"), rnd.randrange(100), t, t + rnd.randrange(1, 400)))
    got = {}
    for r in keyed.admitted(spark.createDataFrame(rows, "store string, request_id long, source_id string, size_bytes long, created_us long, expire_us long"), 5, 500).collect():
        got.setdefault((r.store, r.request_id), []).append(r.admitted)
    want, inside = {}, []
    for s, i, src, size, t, end in rows:
        inside = [h for h in inside if h[5] > t]
        mine = [h for h in inside if h[0] == s]
        ok = sum(h[2] == src for h in mine) < 5 and sum(h[3] for h in mine) + size <= 500 and all(h[1] != i for h in mine)
        want.setdefault((s, i), []).append(ok)
        inside += [(s, i, src, size, t, end)] if ok else []
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {x for v in want.values() for x in v} == {True, False}


def test_reconciliation_cases(spark):
    c = spark.createDataFrame([(i, 100) for i in range(6)], "candidate_id long, deadline long")
    r = spark.createDataFrame([(1, 1, 10, True, False, True), (2, 1, 5, False, True, True), (3, 2, 100, True, False, True), (4, 3, 9, False, False, True), (4, 3, 12, True, False, True), (5, 4, 9, True, False, False), (6, 9, 9, True, False, True)], "request_id long, candidate_id long, completed long, occurred boolean, expired boolean, handled boolean")
    got = {x.candidate_id: (x.status, x.request_id, x.published) for x in rules.reconciled(c, r, "publish_traditional").collect()}
    late = ("timed_out", None, "traditional")
    assert got == {0: late, 1: ("published", 1, "confirmed"), 2: late, 3: ("rejected", 4, None), 4: late, 5: late}


def test_gatherings_within_others():
    crowd = [(0, 0, 10, 10), (20, 0, 10, 10), (40, 0, 10, 10), (500, 0, 10, 10)]
    kept = rules.kept_gatherings(crowd, 2, 2)
    assert [(i, sorted(m)) for i, m, _ in kept] == [(1, [0, 1, 2])]
    assert rules.kept_gatherings(crowd[3:], 2, 2) == []
    line = [(0, 0, 10, 10), (15, 0, 10, 10), (30, 0, 10, 10)]  # the first's is (0, 1), which the second's, of all three, holds
    assert [(i, sorted(m), b) for i, m, b in rules.kept_gatherings(line, 1, 2)] == [(1, [0, 1, 2], (0, 0, 40, 10))]


def test_appearance_keeps_ids_apart_where_boxes_cross():
    t, one, other = AppearanceTracker(streak=2, threshold=0.3), np.array([1.0, 0]), np.array([0, 1.0])
    seen = []
    for k in range(12):
        boxes = np.array([[100 + 10 * k, 100, 40, 40], [210 - 10 * k, 100, 40, 40]], float)
        seen.append(t.step(boxes, np.array([one, other])))
    assert seen[0] == seen[1] == [0, 0] and all(s == [2, 3] for s in seen[2:])


def test_shapes_and_bags(spark):
    df = spark.createDataFrame([("a", 1, 2, 30, 40, 0.625)], "id string, x int, y int, w int, h int, c double")
    look = shapes.merged_style(shapes.style(color="#000000"), shapes.style(color="#ffffff", font_size=9))
    hidden = shapes.circle_shape(F.lit("c"), F.lit(1.5), F.lit(2.5), 5, shapes.style(visible=False))
    row = df.select(
        look.alias("look"),
        shapes.object_text(F.col("id"), None, F.col("c")).alias("text"),
        shapes.drawn(F.array(shapes.box_shape(F.col("id"), Box.of(), z=F.lit(2)), shapes.text_shape(F.col("id"), Box.of(), F.lit("t")), hidden)).alias("drawn"),
        shapes.bag_get(shapes.bag_set(F.create_map(F.lit("k"), F.lit("v")), "k", F.lit("new")), "k").alias("bag"),
        F.map_keys(shapes.bag_remove(F.create_map(F.lit("k"), F.lit("v")), "k")).alias("none"),
        shapes.best_allowed(F.expr("array(struct('p' AS label, 3D AS score), struct('q' AS label, 2D AS score))"), F.array(F.lit("q"))).alias("allowed"),
        shapes.top_labels(F.expr("array(struct('p' AS label, 0.2D AS score), struct('q' AS label, 0.4D AS score))")).alias("top"),
    ).first()
    assert (row.look.color, row.look.font_size, row.text, [s.id for s in row.drawn], row.bag, row.none, row.allowed, row.top) == ("#000000", 9, "a_0.63", ["text_a", "bbox_a"], "new", [], "q", ["q"])


def test_line_and_area_shapes_are_numbered(spark):
    p = "array(named_struct('x', 0, 'y', 0), named_struct('x', 1, 'y', 1))"
    row = spark.range(1).select(shapes.line_shapes(F.expr(f"array(named_struct('one', {p}, 'other', {p}), named_struct('one', {p}, 'other', {p}))"), "Line", shapes.style()).alias("l"), shapes.area_shapes(F.expr(f"array({p})"), "Area", shapes.style()).alias("a")).first()
    assert [s.id for s in row.l] == ["Line_1", "Line_2", "Line_3", "Line_4"] and [s.id for s in row.a] == ["Area_1"]


def test_pipeline_events_are_stored(spark, tmp_path):
    got = pipelines.stored(views.detections(spark, SF), shipped.PIPELINES["people_density"], shipped._FILES)
    assert got.columns == sinks.EVENT_COLUMNS
    held = sinks.DayFolders(spark, f"{tmp_path}/events")
    held.append(got)
    back = held.read()
    assert back.count() == got.count() > 0 and sinks.expired_days(back, "2030-01-01", 7).count() == back.select("day").distinct().count()


def test_datagrams(spark):
    import socket

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(20)
        assert sinks.send_datagrams(spark.createDataFrame([("a",), ("b",)], "line string"), *s.getsockname()) == 2
        assert {s.recv(10), s.recv(10)} == {b"a", b"b"}


def test_preferences(spark):
    df = spark.createDataFrame([("a:1, b:x,c, a:3",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.key_values(F.col("t"))).collect()] == [{"a": 3}, {}, {}]
    df = spark.createDataFrame([("0.5",), ("7",), ("x",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.number_or(F.col("t"), 0.3, 0, 1)).collect()] == [0.5, 0.3, 0.3, 0.3, 0.3]
    df = spark.createDataFrame([("1, 2,3,4",), ("1,2,3",), ("1,2,3,z",), (None,)], "t string")
    assert [tuple(r[0]) if r[0] else None for r in df.select(scalars.rectangle(F.col("t"))).collect()] == [(1, 2, 3, 4), None, None, None]


def test_tracking_stream_equals_one_tracker(spark, tmp_path):
    rnd, rows = random.Random(2), []
    for f in range(40):
        rows += [("s", f, "boat", 10 + 3 * f + rnd.randrange(2), 20, 40, 30), ("s", f, "boat", 300 - 4 * f, 200 + rnd.randrange(2), 50, 50)] if f % 9 else []
    schema = "source_id string, frame_id long, label string, x int, y int, w int, h int"
    for i, (a, b) in enumerate([(0, 20), (20, 40)]):
        spark.createDataFrame([r for r in rows if a <= r[1] < b], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    got = sorted((r.frame_id, r.x, r.y, r.track_id) for r in stateful.drain(stateful.sort_tracks(stream), "t").collect())
    tracker, want, last = folds.Tracker(), [], None
    for f in sorted({r[1] for r in rows}):
        boxes = sorted(r[3:] for r in rows if r[1] == f)
        for _ in range(0 if last is None else f - last - 1):
            tracker.step(np.zeros((0, 4)))
        last = f
        want += [(f, b[0], b[1], f"s_{t}") for b, t in zip(boxes, tracker.step(np.array(boxes, float)), strict=True)]
    assert got == sorted(want)


def test_tracks_of_long_sources_are_whole(spark):
    rows = [(s, f, "person", 1, 0.5, 10 + f % 7, 10, 50, 60, [1.0, 0.5]) for s in ("a", "b", None) for f in range(1, 4101)]
    dets = spark.createDataFrame(rows, "source_id string, frame_id long, label string, tracking_id int, confidence double, x int, y int, w int, h int, look array<double>")
    got = folds.sort_tracks(dets.drop("look")).groupBy("source_id").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks")).collect()
    assert len(got) == 3 and all((r.n, r.tracks) == (4100, 1) for r in got)
    seen = appearance.appearance_tracks(dets, "look", threshold=0.3, streak=3).groupBy("source_id").agg(F.min("frame_id").alias("first"), F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks")).collect()
    assert len(seen) == 3 and all((r.first, r.n, r.tracks) == (4, 4097, 1) for r in seen)


def test_drawing_works_shapes_out_once(spark):
    """Before, the array of shapes stood again in the function of each of its elements."""
    box = Box(*map(F.lit, (1, 2, 3, 4)))
    marks = F.transform("n", lambda i: shapes.box_shape(F.concat(F.lit("mark"), i.cast("string")), box, z=F.when(i % 2 == 0, i)))
    df = spark.createDataFrame([([4, 1, 2, 3, 0, 4],), ([],), (None,)], "n array<int>").select(shapes.drawn(marks).alias("s"))
    assert [r.s and [x.id for x in r.s] for r in df.collect()] == [["bbox_mark1", "bbox_mark3", "bbox_mark0", "bbox_mark2", "bbox_mark4", "bbox_mark4"], [], None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("mark") == 1

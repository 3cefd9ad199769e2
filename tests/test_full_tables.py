"""Queries that SQL can't say, over whole tables, against plain loops; and parts of the library without a query of their own."""

import itertools
import math
import socket
import threading
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_engine import SF, rows_of
from vigil.functions import scalars, shapes
from vigil.functions.geometry import Box
from vigil.operators import folds, frames, keyed, rules, windows
from vigil.plans import more, pipelines, settings, shipped  # noqa: F401
from vigil.plans.queries import QUERIES
from vigil.sources import regions, sinks, views
from vigil.streaming import lifecycle, stateful

BIG = "/root/testdata/sf0.01"


def by_source(spark, d):
    rows = [r.asDict() for r in views.detections(spark, d).collect()]
    rows.sort(key=lambda r: (r["source_id"], *(r[c] for c in folds.ORDER)))
    for source, g in itertools.groupby(rows, key=lambda r: r["source_id"]):
        yield source, [(f, list(h)) for f, h in itertools.groupby(g, key=lambda r: r["frame_id"])]


def test_tracks_of_whole_sources_equal_one_tracker_each(spark):
    """Over 3,750 frames a source, batch and stream alike."""
    want = []
    for source, found in by_source(spark, BIG):
        tracker, last = folds.Tracker(), None
        for frame, rows in found:
            for _ in range(0 if last is None else min(frame - last - 1, 4)):
                tracker.step(np.zeros((0, 4)))
            last = frame
            ids = tracker.step(np.array([[r[c] for c in "xywh"] for r in rows], float))
            want += [(frame, *(r[c] for c in "xywh"), f"{source}_{i}") for r, i in zip(rows, ids, strict=True)]
    columns = ["frame_id", "x", "y", "w", "h", "track_id"]
    assert sorted(tuple(r) for r in QUERIES["sort_tracking"](spark, BIG).select(columns).collect()) == sorted(want)
    assert sorted(tuple(r) for r in QUERIES["stream_sort_tracking"](spark, BIG).select(columns).collect()) == sorted(want)


def test_gatherings_of_whole_tables_equal_a_loop(spark):
    f = shipped._frames(spark, SF)
    people = [r.asDict() for r in pipelines.people_and_boat(f, 10, 0.5).collect()]
    people.sort(key=lambda r: (r["source_id"], r["frame_id"], r["x"], r["y"], r["w"], r["h"], r["tracking_id"]))
    want = []
    for k, g in itertools.groupby(people, key=lambda r: (r["source_id"], r["frame_id"])):
        p = list(g)
        for i, m, box in rules.kept_gatherings([tuple(r[c] for c in "xywh") for r in p], 3, 2):
            want.append((*k, p[i]["tracking_id"], len(m), sum(p[j]["moving_away"] for j in m), *box))
    got = sorted(tuple(r) for r in QUERIES["kept_gatherings"](spark, SF).collect())
    assert want and got == sorted(want)


def test_smuggling_alarms_equal_a_loop(spark):
    f = shipped._frames(spark, SF)
    g = [r.asDict() for r in QUERIES["kept_gatherings"](spark, SF).collect()]
    seen = [r.asDict() for r in f.sightings.groupBy("source_id", "frame_id").agg(F.bool_or((F.col("label") == "boat") & F.col("under_analysis")).alias("b")).collect()]
    want, raised = [], {}
    for r in sorted(seen, key=lambda r: (r["source_id"], r["frame_id"])):
        s, n = r["source_id"], r["frame_id"]
        own = [x for x in g if (x["source_id"], x["frame_id"]) == (s, n)]
        for flag, on, frames_ in (("g", any(x["size"] > 2 for x in own), 100), ("b", r["b"], 200), ("a", any(x["fleeing"] / x["size"] > 0.6 for x in own), 100)):
            if on:
                raised[s, flag] = n + frames_
        if all(n < raised.get((s, flag), -1) for flag in "gba"):
            want.append((s, n, len(own), sum(x["size"] for x in own)))
    got = [tuple(r) for r in QUERIES["smuggling_alarms"](spark, SF).select("source_id", "frame_id", "gathering_count", "person_count").collect()]
    assert sorted(got) == sorted(want)
    events = QUERIES["pipeline_smuggling"](spark, SF).collect()
    alarms = {(s, n) for s, n, *_ in want}
    assert all((e.source_id, e.frame_id) in alarms for e in events)
    for _, g in itertools.groupby(sorted((e.source_id, e.frame_id) for e in events), key=lambda e: e[0]):
        at = [n for _, n in g]
        assert all(b - a >= 10 for a, b in zip(at, at[1:]))


def test_verified_ships_equal_a_loop(spark):
    f = pipelines.frames(views.detections(spark, SF), shipped.PIPELINES["ship_labels_verified"], shipped._FILES, shipped.hooks("ship_labels_verified"))
    frames_of = {}
    for r in f.dets.select("source_id", "frame_id").distinct().collect():
        frames_of.setdefault(r.source_id, []).append(r.frame_id)
    looked = {(s, n) for s, ns in frames_of.items() for i, n in enumerate(sorted(ns)) if i % 10 == 0}
    boats = {}
    for r in f.sightings.filter("label = 'boat'").collect():
        boats.setdefault((r.source_id, r.object_id), []).append(r)
    want = []
    for (source, oid), rows in boats.items():
        rows.sort(key=lambda r: r.frame_id)
        lives = [[rows[0]]]
        for r in rows[1:]:
            lives.append([r]) if r.frame_id - lives[-1][-1].frame_id >= 50 else lives[-1].append(r)
        for life in lives:
            end = life[-1].frame_id + 50
            events = [(r.frame_id, 1, r.frame_id, r) for r in life] + [(r.frame_id + 3 + r.frame_id * 7 % 200, 0, r.frame_id, r) for r in life]
            if end <= max(frames_of[source]):
                events.append((end, 2, end, None))
            pending = label = deadline = None
            best, over = 0.0, False
            for at, turn, asked, r in sorted(events, key=lambda e: e[:3]):
                if over:
                    break
                if turn == 1:
                    off = math.hypot(r.x + r.w / 2 - 960, r.y + r.h / 2 - 540) / math.hypot(960, 540)
                    q = 0.6 * float(r.confidence) + 0.25 * r.w * r.h / (1920 * 1080) + 0.15 * max(0, 1 - off)
                    if (label is None and pending is None) or ((source, asked) in looked and q > best + 0.03):
                        pending, best = asked, q
                elif turn == 0 and asked == pending:
                    pending = None
                    if asked % 13:
                        label = asked
                        if deadline is not None:
                            over = True
                            if at <= deadline:
                                want.append((source, at, oid, asked % 5))
                elif turn == 2:
                    if label is not None:
                        want.append((source, end, oid, label % 5))
                        over = True
                    elif pending is None:
                        over = True
                    else:
                        deadline = end + 80
    got = [(e.source_id, e.frame_id, e.message.split(" ")[0], int(e.message.split("|kind-")[1][0])) for e in QUERIES["pipeline_ship_labels_verified"](spark, SF).collect()]
    assert want and sorted(got) == sorted(want)


def test_candidate_store_equals_a_loop(spark):
    e = sorted((r.ts, r.event_type, r.user_id, r.value) for r in spark.read.parquet(f"{BIG}/events.parquet").collect())
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000 + 0.5)
    pending, want = {}, []
    for ts, kind, user, value in e:
        t, store = us(ts), f"store-{user % 8}"
        held = pending.setdefault(store, {})
        for k, deadline in sorted(held.items(), key=lambda x: (x[1], x[0])):
            if deadline <= t and kind in ("click", "purchase"):
                want.append((store, k, "timed_out", deadline))
                del held[k]
        if kind == "click":
            if len(held) >= 5 or user in held:
                want.append((store, user, "refused", t))
            else:
                held[user] = t + 86_400_000_000
        elif kind == "purchase" and user in held:
            del held[user]
            want.append((store, user, "published" if value > 50 else "rejected", t))
    got = [tuple(r) for r in QUERIES["candidate_store"](spark, BIG).filter("status <> 'pending'").collect()]
    assert sorted(got) == sorted(want)


def test_best_requests_without_an_object_go_by_track_then_request():
    w = keyed.Waiting(10)
    row = lambda i, o, t, q: {"queue": "q", "request_id": i, "policy": "best_per_object", "source_id": "s", "object_id": o, "track_key": t, "quality": q, "created_us": i, "expire_us": 10**9}
    assert w.row(row(1, None, None, 0.5)) == [] and w.row(row(2, None, None, 0.5)) == []
    assert w.row(row(3, None, "t", 0.5)) == [] and w.row(row(4, None, "t", 0.6)) == [("q", 3, "replaced")]
    assert sorted(x[1] for x in w.end()) == [1, 2, 4]


def test_rules_as_streams_carry_their_state_on(spark, tmp_path):
    for i, part in enumerate([[(1, 0.1), (2, 0.3)], [(3, 0.2), (4, 0.9)]]):
        spark.createDataFrame([("q", n, "best_per_object", "s", "o", None, q, n, 10**9) for n, q in part], "queue string, request_id long, policy string, source_id string, object_id string, track_key string, quality double, created_us long, expire_us long").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema("queue string, request_id long, policy string, source_id string, object_id string, track_key string, quality double, created_us long, expire_us long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    out = stateful.fold(stream, "queue", ["created_us", "request_id"], lambda: keyed.Waiting(5), "queue string, request_id long, outcome string")
    assert sorted(tuple(r) for r in stateful.drain(out, "requests").collect()) == [("q", 1, "replaced"), ("q", 2, "replaced"), ("q", 3, "not_better")]


@pytest.mark.parametrize("size", [3, 1000])
def test_blocks_don_t_change_what_runs_over_a_key(spark, size):
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else None, int(n), bool(rng.integers(0, 3)), int(rng.integers(0, 9))) for i, n in enumerate(sorted(rng.choice(60, 40, replace=False)))]
    df = spark.createDataFrame(rows, "k string, n long, f boolean, v long")
    got = {(r.k, r.n): r for r in windows.runs(windows.running(df, "k", "n", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.when(F.col("v") > 4, F.col("v")))}, size=size), "k", "n", F.col("f"), size=size).collect()}
    for k in ("a", None):
        total = most = length = start = 0
        last = None
        for _, n, f, v in [r for r in rows if r[0] == k]:
            total, most, last = total + v, max(most, v), v if v > 4 else last
            start, length = (start if length else n, length + 1) if f else (0, 0)
            r = got[k, n]
            assert (r.s, r.m, r.l) == (total, most, last)
            assert (r.run_start, r.run_length) == ((start, length) if f else (None, None))


def test_no_window_or_list_over_a_whole_source(spark):
    """Plans of source-wide rules: raw rows are partitioned by source and block, only a row a block by source alone."""
    for name in ("density_running_max", "occurrence_runs", "frame_stride", "sequence_batches", "dominant_scene", "warmed_up_frames", "active_candidates"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window" in line and "source_id" in line and "__block" not in line and "__b" not in line and "__span" not in line and "batch_no" not in line:
                raise AssertionError(f"{name}: {line}")


def test_no_python_in_rules_over_a_frame(spark):
    for name in ("inner_suppression", "region_access", "box_merge_all", "box_merge_first", "tile_stitching", "kept_gatherings", "region_tagging"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert not any(w in plan for w in ("MapInPandas", "MapInArrow", "FlatMapGroups", "PythonUDF")), name


def test_merges_over_columns_equal_those_over_lists(spark):
    rng = np.random.default_rng(7)
    sets = [[tuple(int(v) for v in (*rng.integers(0, 60, 2), *rng.integers(0, 40, 2))) for _ in range(rng.integers(1, 9))] for _ in range(150)]
    rows = [("s", i, *b) for i, s in enumerate(sets) for b in s]
    df = spark.createDataFrame(rows, "source_id string, frame_id long, x int, y int, w int, h int")
    for name, plain in frames.MERGES.items():
        for threshold in (0.05, 0.3):
            want = sorted(("s", i, *b) for i, s in enumerate(sets) for b in plain(sorted(s), threshold))
            assert sorted(tuple(r) for r in frames.merged(df, name, threshold).collect()) == want, name


def test_regions_of_files(spark, tmp_path):
    rect = lambda a, b, c, d: [{"NormalizedX": x, "NormalizedY": y} for x, y in ((a, b), (c, b), (c, d), (a, d))]
    import json

    good = {"Name": "n", "IsObjectAnalyzableRetain": True, "AnalysisAreas": [{"Name": "a", "Points": rect(0.1, 0.1, 0.5, 0.5)}], "ExcludedAreas": [{"Name": "e", "Points": rect(0.6, 0.6, 0.8, 0.8)}], "Lanes": [{"Name": "l", "Index": 1, "Type": "t", "ForbiddenTypes": ["car"], "Points": rect(0.2, 0.2, 0.4, 0.4)}], "InterestAreas": [{"Name": "r", "Type": "restricted area", "RelativeTypes": ["boat"], "Points": rect(0.3, 0.3, 0.7, 0.7)}], "CountLines": [{"Item1": {"Start": {"NormalizedX": 0, "NormalizedY": 0}, "Stop": {"NormalizedX": 1, "NormalizedY": 1}}, "Item2": {"Start": {"NormalizedX": 0, "NormalizedY": 0}, "Stop": {"NormalizedX": 1, "NormalizedY": 0}}}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "broken.json").write_text("{")
    rows = regions.rows_of({"s": tmp_path / "good.json", "t": tmp_path / "broken.json", "u": tmp_path / "none.json"}, 1920, 1080, tmp_path / "good.json")
    assert rows[0]["lanes"][0]["forbidden"] == ["car"] and rows[0]["interest"][0]["relative_types"] == ["boat"] and rows[0]["lines"][0]["enter"]["bx"] == 1920.0
    assert rows[1]["analysis"] == rows[2]["analysis"] == rows[0]["analysis"]
    assert regions.load(tmp_path / "none.json", 10, 10)["analysis"] == []
    at = lambda i, f, cx, cy: ("s", f, f"o{i}", cx - 25, cy - 25, 50, 50)
    df = spark.createDataFrame([at(1, 1, 576, 324), at(2, 1, 1344, 756), at(3, 1, 576, 324), at(3, 2, 1000, 1000), at(3, 99, 1000, 1000)], "source_id string, frame_id long, object_id string, x int, y int, w int, h int")
    dim = regions.dimension(spark, rows)
    got = {(r.object_id, r.frame_id): r for r in regions.retained(regions.tagged(df, dim), 50).collect()}
    assert (got["o1", 1].under_analysis, got["o1", 1].lane, got["o1", 1].areas) == (True, 1, ["r"])
    assert not got["o2", 1].under_analysis and got["o2", 1].lane is None
    assert got["o3", 2].under_analysis and not got["o3", 99].under_analysis  # retained, until it has expired
    with pytest.raises(Exception, match="no region definition"):
        regions.tagged(df.withColumn("source_id", F.lit("x")), dim).collect()
    assert regions.tagged(df.withColumn("source_id", F.lit("x")), dim, "drop").count() == 0


def test_settings_take_defaults_and_refuse_missing_sections():
    doc = shipped.document([("ObjectDensity", {"EventName": "e", "LocalEventIntervalSec": "x"})], {"ConfThresh": "2", "DetectionStride": -1, "TargetTypes": " Person, boat", "MinBboxWidth": "50", "FilterSmallObject": True, "TileDetectionSize": "1, 2", "DetectionRegion": "1,2,3"})
    s = settings.parse(doc)
    d = s["Detector"]
    assert (d["ConfThresh"], d["DetectionStride"], d["TargetTypes"], d["MinBboxWidth"], d["FilterSmallObject"], d["TileDetectionSize"], d["DetectionRegion"]) == (0.25, 1, ["person", "boat"], 50, True, (1, 2), (0, 0, 1, 1))
    assert s["Algorithms"][0]["LocalEventIntervalSec"] == 1 and s["Snapshot"]["MaxSnapshots"] == 10 and s.lifetime == 50
    assert settings.preferences({"EventSuppressionIntervals": "a:10, b:x"}, settings.PREFERENCES["MessagePoster"])["EventSuppressionIntervals"] == {"a": 10}
    assert settings.preferences({"EventSuppressionIntervals": "{}"}, settings.PREFERENCES["MessagePoster"])["EventSuppressionIntervals"] == {}
    for name in doc:
        with pytest.raises(settings.ConfigError):
            settings.parse({k: v for k, v in doc.items() if k != name})


def test_a_configured_tracker_is_used(spark):
    doc = shipped.document([("ObjectDensity", {"MaxCountThreshold": 0, "CountRegionName": "watch"})])
    doc["Tracker"] = {"FullQualifiedClassName": "Any.SortTracker", "Preferences": {"IouThreshold": 0.2}}
    f = pipelines.frames(views.detections(spark, SF), doc, shipped._FILES)
    want = folds.sort_tracks(views.detections(spark, SF), 0.2, 3).select(F.substring_index("track_id", "_", -1).cast("int").alias("t")).groupBy("t").count()
    assert sorted(map(tuple, f.dets.groupBy("tracking_id").count().collect())) == sorted(map(tuple, want.collect()))
    doc["Tracker"] = {"Class": "Unknown"}
    with pytest.raises(settings.ConfigError):
        pipelines.frames(views.detections(spark, SF), doc, shipped._FILES)


def test_suppression_of_named_events(spark):
    rows = [("s", "A", 0), ("s", "A", 5), ("s", "A", 10), ("s", "B", 0), ("s", "B", 1), ("t", "A", 1)]
    df = spark.createDataFrame([(s, e, datetime(2024, 1, 1, 0, 0, t)) for s, e, t in rows], "source_id string, event_name string, ts timestamp")
    got = lambda out: sorted((r.source_id, r.event_name, r.ts.second) for r in out.collect())
    assert got(folds.suppressed(df, {"A": 10})) == sorted([("s", "A", 0), ("s", "A", 10), ("s", "B", 0), ("s", "B", 1), ("t", "A", 1)])
    assert got(folds.suppressed(df, {"A": 10}, enabled=False)) == got(df) == got(folds.suppressed(df, {}))


def test_boxes_of_bad_arguments_are_null(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.1, 0.2), (float("nan"), 0.5, 0.1, 0.1), (0.5, 0.5, -0.1, 0.1), (0.5, 0.5, 1e-9, 0.1), (0.5, float("inf"), 0.1, 0.1)], "a double, b double, c double, d double")
    b = Box.of_yolo_normalised(*map(F.col, "abcd"), 100, 100)
    assert [tuple(r) for r in df.select(b.x, b.y, b.w, b.h).collect()] == [(45, 40, 10, 20), *[(None,) * 4] * 4]
    e = spark.createDataFrame([(5, 5, 0, 3, 9, 9, 0, 0)], "x int, y int, w int, h int, o_x int, o_y int, o_w int, o_h int")
    assert e.select(Box.of().diou(Box.of("o_")), Box.of().joined(Box.of("o_")).w).first() == (0.0, 0)
    with pytest.raises(Exception, match="nothing of the box"):
        spark.createDataFrame([(50, 50, 5, 5)], "x int, y int, w int, h int").select(Box.of().clip_or_raise(10, 10).x).collect()


def test_styles_and_answers(spark):
    one = spark.range(1).select(shapes.merged_style(shapes.style(color="#111111", opacity=0.5), shapes.style(color="#222222", font_size=9)).alias("s"), scalars.decoded(F.lit("```json\n{\"isObjOccurred\": true}\n```"), scalars.OCCURRED).alias("a"), scalars.decoded(F.lit("[1"), scalars.OCCURRED).alias("b"), scalars.name_list(F.lit(" A, ,b ")).alias("n"), scalars.file_safe(F.lit('a:b/c?"d')).alias("f")).first()
    assert (one.s.color, one.s.opacity, one.s.font_size, one.s.dash) == ("#111111", 0.5, 9, None) and one.a.isObjOccurred and one.b is None
    assert (one.n, one.f) == (["a", "b"], "a_b_c__d")


def test_stored_days_are_loaded_and_deleted(spark, tmp_path):
    rows = [(f"e{i}", datetime(2024, 1, 1 + i % 3), "s", "n", "Alg One") for i in range(9)]
    e = spark.createDataFrame(rows, "event_id string, ts timestamp, source_id string, event_name string, algorithm_name string")
    path = f"{tmp_path}/ev"
    held = sinks.DayFolders(spark, path)
    assert held.read() is None and held.delete(e.select("event_id")) == 0
    held.append(sinks.stored_events(e))
    assert held.load("e4").first().bucket_name == "algone20240102"
    held.delete(spark.createDataFrame([("e4",), ("e8",)], "event_id string"))
    assert sorted(r.event_id for r in held.read().collect()) == ["e0", "e1", "e2", "e3", "e5", "e6", "e7"]
    assert held.expire(date(2024, 1, 9), 7) == 1
    assert {r.day for r in held.read().select("day").distinct().collect()} == {"20240102", "20240103"}


def test_sources_open_loop_and_retry(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        lifecycle.open_source(spark, f"{tmp_path}/none")
    spark.range(3).selectExpr("id as frame_id").coalesce(1).write.parquet(f"{tmp_path}/f")
    assert lifecycle.open_source(spark, f"{tmp_path}/f").count() == 3
    assert sorted(r.frame_id for r in lifecycle.looped(spark.read.parquet(f"{tmp_path}/f"), 2).collect()) == list(range(6))
    pauses, calls = [], []

    def fails(times):
        def run():
            calls.append(1)
            if len(calls) <= times:
                raise OSError("gone")
            return "up"

        return run

    assert lifecycle.retry(fails(3), 3, 200, sleep=pauses.append) == "up" and pauses == [0.2, 0.2]  # at once, then with pauses
    calls.clear()
    with pytest.raises(OSError):
        lifecycle.retry(fails(9), 3, 0, sleep=lambda _: None)
    assert len(calls) == 4
    calls.clear()
    assert lifecycle.retry(fails(9), 3, 0, progressed=lambda: True, sleep=lambda _: None) == "up"


def test_replay_keeps_its_time():
    now = [0.0]
    waits = []

    def sleep(s):
        waits.append(s)
        now[0] += s

    assert list(lifecycle.paced([0, 50, 400], clock=lambda: now[0], sleep=sleep)) == [0, 50, 400]
    assert max(waits) <= 0.1 and abs(now[0] - 0.4) < 1e-9
    assert lifecycle.pause_ms(10, 30) == 0


def test_player_pauses_and_goes_on_where_it_was(spark, tmp_path):
    write = lambda i: spark.range(i, i + 1).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    write(0)
    seen, tapped = [], []
    p = lifecycle.Player(lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in/part=*"), lambda df, n: seen.extend(r.id for r in df.collect()), f"{tmp_path}/c", taps=[lambda df, n: tapped.append(n)])
    p.play_to_end()
    p.pause()
    write(1)
    p.resume().awaitTermination()
    assert seen == [0, 1] and len(tapped) == 2 and p.stop()


def test_dispatch_keeps_its_order_and_stops_at_a_failure():
    done = []
    d = lifecycle.Dispatcher(lambda e: done.append("artefacts"), lambda e: done.append("store") if e else 1 / 0, lambda e: done.append("poster"))
    assert d(True) and not d(False)
    assert done == ["artefacts", "store", "poster", "artefacts"]
    hold = threading.Event()
    slow = lifecycle.Dispatcher(lambda e: hold.wait(5))
    t = threading.Thread(target=slow, args=(1,))
    t.start()
    while not slow.running:
        pass
    assert not slow.close(0.05) and not slow(1)
    hold.set()
    t.join()
    assert slow.close(1)
    bus, got = lifecycle.Bus(), []
    end = bus.subscribe("expired", got.append)
    bus.publish("expired", 1)
    end()
    bus.publish("expired", 2)
    assert got == [1]


def test_datagrams_and_logged_events(spark):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(5)
        assert sinks.send_datagrams(spark.createDataFrame([("a",)], "value string"), *s.getsockname()) == 1
        assert s.recv(10) == b"a"
    lifecycle.log_events(spark.createDataFrame([("said",), (None,)], "message string"))


def test_rows_are_compared_whole():
    assert rows_of is not None and frames.modal_size([3, 5, 5, 3, 3]) == 3
    assert frames.stitch_groups([(0, 0, 130, 50), (90, 0, 110, 50)], ["a", "a"], ([100], []), 60, 0.5) == [0, 1]  # they overlap over the seam
    assert frames.stitch_groups([(0, 0, 98, 50), (101, 0, 99, 50)], ["a", "a"], ([100], []), 3, 0.5) == [0, 0]


def whole_requests(spark):
    names = ["latest_per_source", "best_per_object", "anchored", "drop_oldest"]
    rows = [r.asDict() for r in spark.read.parquet(f"{BIG}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).collect()]
    rows.sort(key=lambda r: (r["us"], r["event_id"]))
    return [(f"queue-{r['user_id'] % 8}", r["event_id"], names[r["event_id"] % 4], r["event_type"], str(r["user_id"]), r["value"], r["us"]) for r in rows]


def test_request_schedule_equals_a_loop(spark):
    """Over the whole table: a list of waiting requests a queue."""
    day, want, queues = 86_400_000_000, {}, {}
    for queue, i, policy, source, oid, quality, us in whole_requests(spark):
        waiting = queues.setdefault(queue, [])
        for w in [w for w in waiting if w["us"] + day <= us]:
            waiting.remove(w)
            want[w["i"]] = "expired"
        mine = {"latest_per_source": ("s", source), "best_per_object": ("o", oid)}.get(policy, ("i", i))
        same = [w for w in waiting if w["place"] == mine]
        if len(waiting) >= 20 and policy == "drop_oldest":
            oldest = min(waiting, key=lambda w: w["us"])
            waiting.remove(oldest)
            want[oldest["i"]] = "dropped"
        elif len(waiting) >= 20 and not same:
            want[i] = "rejected"
            continue
        if same:
            if policy == "best_per_object" and quality <= same[0]["quality"]:
                want[i] = "not_better"
                continue
            waiting.remove(same[0])
            want[same[0]["i"]] = "replaced"
        waiting.append({"i": i, "us": us, "place": mine, "quality": quality})
    want |= {w["i"]: "waiting" for ws in queues.values() for w in ws}
    assert {r.request_id: r.outcome for r in QUERIES["request_schedule"](spark, BIG).collect()} == want


def test_evidence_admission_equals_a_loop(spark):
    day, want, stores = 86_400_000_000, {}, {}
    for store, i, _, source, _, _, us in whole_requests(spark):
        held = stores.setdefault(store, {})
        for k in [k for k, (_, _, at) in held.items() if at + day <= us]:
            del held[k]
        size = i * 7919 % 4_000_000
        want[i] = sum(s == source for s, _, _ in held.values()) < 30 and sum(b for _, b, _ in held.values()) + size <= 64 << 20
        if want[i]:
            held[i] = (source, size, us)
    assert {r.request_id: r.admitted for r in QUERIES["evidence_admission"](spark, BIG).collect()} == want


def test_appearance_tracks_of_whole_sources_equal_one_tracker_each(spark):
    from vigil.operators.appearance import AppearanceTracker

    looks = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = []
    for source, found in by_source(spark, SF):
        tracker = AppearanceTracker(threshold=0.3, streak=3)
        for frame, rows in found:
            rows = [r for r in rows if r["tracking_id"] in looks]
            if rows:
                ids = tracker.step(np.array([[r[c] for c in "xywh"] for r in rows], float), np.array([looks[r["tracking_id"]] for r in rows], float))
                want += [(frame, *(r[c] for c in "xywh"), f"{source}_{i}") for r, i in zip(rows, ids, strict=True) if i]
    got = [tuple(r) for r in QUERIES["appearance_tracking"](spark, SF).select("frame_id", "x", "y", "w", "h", "track_id").collect()]
    assert sorted(got) == sorted(want)


def test_pixel_inclusive_overlap(spark):
    """As the tracker counts it."""
    df = spark.createDataFrame([(0, 0, 9, 9, 0, 0, 9, 9), (0, 0, 9, 9, 5, 0, 9, 9), (0, 0, 9, 9, 50, 50, 9, 9)], "x int, y int, w int, h int, o_x int, o_y int, o_w int, o_h int")
    got = [r[0] for r in df.select(Box.of().iou_plus_one(Box.of("o_"))).collect()]
    assert got == pytest.approx([100 / (100 + 1e-5), 50 / (150 + 1e-5), 0])


def test_posting_sends_each_row_once_from_the_executors(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/sent"

    def send(texts):
        with open(out, "a") as f:
            f.writelines(t + "\n" for t in texts)

    stateful.post_each(spark.readStream.schema("k string, n long").parquet(f"{tmp_path}/in"), send, f"{tmp_path}/c").awaitTermination()
    assert sorted(open(out).read().split()) == ['{"k":"a","n":1}', '{"k":"b","n":2}']

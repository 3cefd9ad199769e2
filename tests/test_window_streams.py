"""Windows as streams: over several micro-batches, on from a stop, and equal to the batch forms."""

import random
from datetime import datetime, timedelta

import pytest

from vigil.operators import windows as batch
from vigil.plans.streams import better_evidence
from vigil.streaming import stateful, windows

ROWS = "source_id string, frame_id long, object_id string"


def stream(spark, path, parts, schema=ROWS, first=0):
    for i, part in enumerate(parts, first):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/in/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/part=*")


def test_window_of_two_frames(spark, tmp_path):
    """The oldest frame and its objects expire when the window is full; an object that is seen again doesn't; what is left expires when the source ends."""
    parts = [[("s", 1, "101"), ("s", 1, "103")], [("s", 2, "102"), ("s", 2, "103")], [("s", 3, None)], [("s", None, None), (None, 1, "x")]]
    got = stateful.drain(windows.sliding(stream(spark, tmp_path, parts), 2), "t", windows.STORE)
    assert sorted((r.object_id or "", r.frame_id, r.expired_at) for r in got.collect()) == sorted([("", 1, 3), ("101", 1, 3), ("", 2, 3), ("102", 2, 3), ("103", 2, 3), ("", 3, 3)])


def test_expiry_goes_on_from_a_stop_and_equals_the_batch_form(spark, tmp_path):
    rnd = random.Random(5)
    rows = sorted({(s, f, f"{s}_{rnd.randrange(12)}") for s in ("a", "b") for f in range(300) for _ in range(rnd.choice([0, 0, 1]))} | {(s, f, f"{s}_x") for s in ("a", "b") for f in (0, 299)}, key=lambda r: r[1])
    cuts = [0, 57, 58, 130, 200]
    parts = [rows[a:b] for a, b in zip(cuts, [*cuts[1:], len(rows)])]
    at = f"file://{tmp_path}/out"
    for i in range(len(parts)):  # a new run each time
        table = stateful.proceed(windows.sliding(stream(spark, tmp_path, parts[i : i + 1], first=i), 20), at, windows.STORE)
    got = sorted((r.source_id, r.object_id, r.frame_id, r.expired_at) for r in table.collect() if r.object_id)
    df = spark.createDataFrame(rows, ROWS)
    want = batch.expiry(df, 20, df.groupBy("source_id").agg({"frame_id": "max"}).withColumnRenamed("max(frame_id)", "last_frame"))
    assert got == sorted((r.source_id, r.object_id, r.frame_id, r.expired_at) for r in want.collect())


def test_frames_over_batches_late_rows_and_rows_out_of_order(spark, tmp_path):
    parts = [[("s", 5, "a"), ("s", 4, "b")], [("s", 5, "c"), ("s", 4, "b"), ("s", 1, "late")], [("s", 8, "a")], [("s", 20, None)]]
    got = stateful.drain(windows.sliding(stream(spark, tmp_path, parts), 3), "t", windows.STORE)
    assert sorted((r.object_id, r.frame_id, r.expired_at) for r in got.collect() if r.object_id) == [("a", 5, 8), ("a", 8, 11), ("b", 4, 7), ("c", 5, 8)]


def test_evidence_is_given_when_its_object_expires(spark, tmp_path):
    schema = "source_id string, frame_id long, object_id string, known boolean, confidence double, area long, seen_at long"
    at = lambda f, o, k, c, a: ("s", f, o, k, c, a, f)
    parts = [[at(0, "o", False, 0.9, 10), at(1, "o", True, 0.1, 5)], [at(2, "o", True, 0.2, 5), at(2, "o", True, 0.9, 1), at(3, "p", False, 0.5, 7)], [at(4, "p", False, 0.5, 9), at(20, None, None, None, None)]]
    gone = windows.sliding(stream(spark, tmp_path, parts, schema), 10, ["known", "confidence", "area", "seen_at"], ["confidence"], better_evidence(2))
    got = {r.object_id: tuple(r)[3:] for r in stateful.drain(gone, "t", windows.STORE).collect() if r.object_id}
    assert got == {"o": (12, True, 0.9, 1, 2), "p": (14, False, 0.5, 9, 4)}  # of an object's rows in one frame the surest; only every second frame is looked at


@pytest.mark.parametrize("size,stride", [(3, 1), (2, 2), (5, 3)])
def test_batches_of_frames(spark, tmp_path, size, stride):
    rnd = random.Random(size)
    frames = {s: sorted(rnd.sample(range(200), 50)) for s in ("a", "b")}
    rows = sorted(((s, f, "o") for s, fs in frames.items() for f in fs for _ in range(2)), key=lambda r: r[1])
    got = windows.tumbling(stream(spark, tmp_path, [rows[:30], rows[30:31], rows[31:150], rows[150:]]), size, stride)
    want = []
    for s, fs in frames.items():
        kept = fs[::stride]
        want += [(s, i, kept[i * size], kept[i * size + size - 1]) for i in range(len(kept) // size)]
    assert sorted(tuple(r) for r in stateful.drain(got, "t", windows.STORE).collect()) == sorted(want)


def test_access_states_are_equal_in_batch_and_stream(spark, tmp_path):
    """Unknown geometry, and none, leaves the state; the row stays."""
    from vigil.operators import folds

    rows = [("a", i, g) for i, g in enumerate(["in", "in", None, "beyond", "mixed_out", None, "out", "in"])] + [("b", 0, None), ("b", 1, "out"), (None, 1, "in")]
    schema = "k string, at long, g string"
    got = stateful.drain(stateful.access_states(stream(spark, tmp_path, [rows[:5], rows[5:]], schema), "k", "at", "g"), "t").collect()
    want = folds.access_states(spark.createDataFrame(rows, schema).dropna(subset=["k"]), "k", "at", "g").collect()
    assert sorted((r.k, r["at"], r.state) for r in got) == sorted((r.k, r["at"], r.state) for r in want)


def test_answers_meet_their_requests(spark, tmp_path):
    """The first answer in time counts, whatever comes first; late ones and those of no request count for nothing; without an answer a request comes out once its deadline is past."""
    rnd = random.Random(7)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    requests = [(i, day(rnd.randrange(100))) for i in range(60)]
    answers = [(100 * i + k, rnd.randrange(70), day(rnd.randrange(120)), rnd.random() < 0.5) for i in range(60) for k in range(2)]
    want = {}
    for c, created in requests:
        mine = sorted((t, r, o) for r, a, t, o in answers if a == c and created <= t < created + timedelta(days=10))
        want[c] = (mine[0][1], mine[0][2]) if mine else (None, None)
    for name, rows, schema in (("requests", sorted(requests, key=lambda r: r[1]), "candidate_id int, created timestamp"), ("answers", sorted(answers, key=lambda r: r[2]), "request_id int, candidate_id int, completed timestamp, occurred boolean")):
        half = len(rows) // 2
        last = [(999, day(400))] if name == "requests" else [(99_999, 998, day(400), True)]
        for i, part in enumerate([rows[:half], rows[half:], last]):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/part={i}")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/part=*")
    met = windows.reconciled(read("requests", "candidate_id int, created timestamp"), read("answers", "request_id int, candidate_id int, completed timestamp, occurred boolean"), "10 days")
    got = {r.candidate_id: (r.request_id, r.occurred) for r in stateful.drain(met, "t", windows.STORE).collect()}
    assert got == want and any(v[0] is None for v in got.values())

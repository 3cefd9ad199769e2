"""Chains of varying intervals, candidates that are made again once decided, and averages by blocks, against plain loops; small blocks and spans, so that chains go over many of them."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import folds, windows


def chain(rows, late_too):
    """rows: (place, until, late, run) in order; the places taken."""
    out, due, late, run = [], None, False, None
    for place, until, is_late, r in rows:
        if r != run:
            run, due, late = r, None, False
        if due is not None:
            if place < due:
                continue
            if late:  # the row that finds out
                due, late = place + 1, False
                continue
        out.append(place)
        due, late = max(until, place + 1), is_late and late_too
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(folds, "BLOCK_ROWS", 7)


@pytest.mark.parametrize("late_too", [False, True])
@pytest.mark.parametrize("with_runs", [False, True])
def test_chains_equal_a_loop(spark, small_blocks, late_too, with_runs):
    rnd = random.Random(10 * late_too + with_runs)
    rows, want = [], []
    for key in ("a", "b", "c"):
        places = sorted(rnd.sample(range(1000), 300)) if key != "c" else list(range(40))
        runs, run = [], 0
        for p in places:
            run = p if rnd.random() < 0.04 else run
            runs.append(run)
        mine = [(p, p + rnd.choice([1, 2, 5, 30, 200]), rnd.random() < 0.3, r if with_runs else 0) for p, r in zip(places, runs)]
        rows += [(key, *m) for m in mine]
        want += [(key, p) for p in chain(mine, late_too)]
    rows += [(None, 1, 2, False, 0), ("a", None, 2, False, 0)]
    df = spark.createDataFrame(rows, "k string, place long, until long, late boolean, run long")
    got = folds.chained(df, "k", "place", F.col("until"), 64, F.col("late") if late_too else None, "run" if with_runs else None)
    assert got.columns == df.columns and sorted((r.k, r.place) for r in got.collect()) == sorted(want)


def test_without_an_until_nothing_follows_and_ties_go_by_the_least(spark):
    df = spark.createDataFrame([("a", 1, None, "y"), ("a", 1, None, "x"), ("a", 5, None, "z")], "k string, place long, until long, t string")
    assert [tuple(r) for r in folds.chained(df, "k", "place", F.col("until"), 10, ties=["t"]).collect()] == [("a", 1, None, "x")]
    assert folds.chained(df.limit(0), "k", "place", F.col("until"), 10).count() == 0


def test_candidates_are_made_again_in_one_run(spark, small_blocks):
    """A fire that burns on is asked about again: after an answer from its frame on, after a timeout from the frame behind the one that finds out."""
    rnd = random.Random(4)
    rows, want = [], []
    for source in ("s", "t"):
        held, mine = 0, []
        for f in range(400):
            met = rnd.random() < 0.93
            held = held + 1 if met else 0
            mine.append((source, f, met, f + rnd.choice([1, 4, 40]), rnd.random() < 0.4, held))
        active = None  # decided at, late
        for _, f, met, until, late, held in mine:
            if not met:
                active = None
                continue
            if active and f >= active[0] and not active[1]:
                active = None
            if held >= 3 and active is None:
                want.append((source, f, held))
                active = (until, late)
            elif active and active[1] and f >= active[0]:
                active = None
        rows += [m[:5] for m in mine]
    df = spark.createDataFrame(rows, "source_id string, frame_id long, met boolean, until long, late boolean")
    got = folds.candidates(df, "source_id", "frame_id", F.col("met"), 3, F.col("until"), F.col("late"), size=32)
    got = sorted((r.source_id, r.frame_id, r.run_length) for r in got.collect())
    assert got == sorted(want) and len(got) > len({(s, f - n) for s, f, n in got})  # several in one run
    once = folds.candidates(df, "source_id", "frame_id", F.col("met"), 3)
    assert all(r.run_length == 3 for r in once.collect())


def test_averages_by_blocks_equal_a_loop(spark):
    rnd = random.Random(6)
    rows = [(k, t, rnd.random()) for k in "abc" for t in rnd.sample(range(5000), 200)] + [("one", 3, 0.5)]
    want = {}
    for k, _, v in sorted(rows):
        want[k] = v if k not in want else want[k] * 0.9 + v * 0.1
    got = {r.k: r.ema for r in folds.ema_by(spark.createDataFrame(rows, "k string, t long, v double"), "k", "t", "v", 0.1, size=64).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0].count("FileScan parquet")


def test_tables_are_read_once_or_twice(spark):
    from vigil.plans import more, rules, shipped  # noqa: F401  (they register their queries)
    from vigil.plans.queries import QUERIES

    for name, most in (("score_ema", 2), ("ttl_flags", 2), ("occurrence_runs", 2), ("density_running_max", 2), ("suppressed_events", 3), ("pipeline_smuggling", 4)):
        assert scans(QUERIES[name](spark, "/root/testdata/sf0.001")) <= most, name
    df = QUERIES["pipeline_smuggling"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString()  # the tagged frames are read, not the table
    assert windows.BLOCK == 4096


def test_a_throttled_span_holds_many_intervals(spark):
    """A group is a block of up to a thousand intervals, not of 64; the answer is the greedy one, across spans too."""
    assert folds.SPAN >= 1024
    n, interval = 6000, 3
    rows = spark.range(n).select(F.lit("s").alias("k"), (F.col("id") * 7 % 11 + F.col("id") * 2).alias("us"))
    want, last = [], None
    for us in sorted({i * 7 % 11 + i * 2 for i in range(n)}):
        if last is None or us >= last + interval:
            want, last = [*want, us], us
    assert sorted(r.us for r in folds.throttle(rows, "k", "us", interval).collect()) == want

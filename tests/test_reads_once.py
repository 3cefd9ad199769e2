"""What a pipeline stores and asks: no more than its algorithms read."""

import pytest
from pyspark.sql import functions as F

from vigil.operators import keyed
from vigil.plans import pipelines, shipped
from vigil.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def stored_by(monkeypatch, spark, name):
    names, store = [], pipelines.stored_table
    monkeypatch.setattr(pipelines, "stored_table", lambda df, n: names.append((n, df.columns)) or store(df, n))
    QUERIES[name](spark, SF)
    return names


@pytest.mark.parametrize("name, most", [("pipeline_ship_labels_verified", {"lives"}), ("smuggling_alarms", {"boats", "people", "gatherings"})])
def test_no_detection_is_stored_with_its_regions(spark, monkeypatch, name, most):
    names = stored_by(monkeypatch, spark, name)
    assert {n for n, _ in names} == most and not any("areas" in columns for _, columns in names)


def test_verified_ships_need_no_join_with_the_answers(spark):
    """The only joins are those with the frames that are looked at and with the ends of sources."""
    plan = QUERIES["pipeline_ship_labels_verified"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "candidate_id" not in [j.split("=")[0] for j in plan.split("Join ")[1:]]


def events(spark, odd=False):
    """The events of a boat of a source whose name has an @, with answers to requests that nobody made."""
    source = "c@m-0"
    d = shipped.document([("LabelsByLLM", {"EventName": "ship", "Stride": 2, "ObjectExpiredWaitSeconds": 8})])
    d["VideoLoaders"] = [{"Class": "Table", "Preferences": {"SourceId": source}}]
    d["RegionManager"] = [{"Class": "Definition", "Preferences": {"SourceId": source, "RegionDefinitionFile": "none.json"}}]
    rows = [(source, i, "boat" if i < 20 else "car", 1, 0.5, 10, 10, 30, 30) for i in range(0, 200)]
    dets = spark.createDataFrame(rows, "source_id string, frame_id long, label string, tracking_id int, confidence double, x int, y int, w int, h int")

    def answers(requests):
        a = shipped._answers(shipped._ship(F.col("frame_id") + 1))(requests)
        more = spark.createDataFrame([("r1", f"{source}_boat_1#0@1000", 5, '{"ShipTypeDetail": "kind-9"}'), ("r2", "nobody", 5, "{}"), ("r3", f"{source}_boat_1#0@00", 5, "{}"), ("r4", None, 5, "{}")], "request_id string, candidate_id string, completed_us long, result string")
        return a.unionByName(more) if odd else a

    return [tuple(r) for r in pipelines.events(dets, d, ".", pipelines.Hooks(answers=answers)).select("source_id", "frame_id", "message").collect()]


def test_answers_that_nobody_asked_for_change_nothing(spark):
    plain = events(spark)
    assert len(plain) == 1 and plain[0][:2] == ("c@m-0", 69) and events(spark, odd=True) == plain


def test_verified_goes_on_from_batch_to_batch(spark):
    """Lives over many batches come out as the rule's own answers, row by row."""
    rows = spark.range(3000).select(F.concat(F.lit("s_boat_"), F.col("id") % 7, F.lit("#0")).alias("life"), F.lit("s").alias("source_id"), F.concat(F.lit("s_boat_"), F.col("id") % 7).alias("object_id"), (F.col("id") / 7).cast("long").alias("frame_id"))
    rows = rows.withColumns({"us": F.col("frame_id") * 100_000, "turn": F.lit(1), "looked": F.col("frame_id") % 3 == 0, "quality": F.col("frame_id") * 31 % 97 / 97.0, "result": F.lit(None).cast("string")})
    back = rows.withColumns({"turn": F.lit(0), "us": F.col("us") + (3 + F.col("frame_id") * 7 % 50) * 100_000, "result": F.when(F.col("frame_id") % 5 > 0, F.concat(F.lit("kind-"), "frame_id"))})
    ends = rows.groupBy("life", "source_id", "object_id").agg((F.max("frame_id") + 10).alias("frame_id")).withColumns({"us": F.col("frame_id") * 100_000, "turn": F.lit(2), "looked": F.lit(False), "quality": F.lit(0.0), "result": F.lit(None).cast("string")})
    all_ = rows.unionByName(ends).unionByName(back)
    want, held = [], all_.collect()
    for life in sorted({r.life for r in held}):
        rule = keyed.Verification(800_000, 100_000)
        for r in sorted((r for r in held if r.life == life), key=lambda r: (r.us, r.turn, r.frame_id)):
            want += rule.row(r.asDict())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sorted(tuple(r) for r in keyed.verified(all_, 800_000, 100_000).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert want and got == sorted(want)

"""Tables fed to a stream in order, by micro-batches of bounded size."""

from pyspark.sql import functions as F

from vigil.plans import streams  # noqa: F401
from vigil.plans.queries import QUERIES
from vigil.streaming import stateful

SF = "/root/testdata/sf0.001"


def test_micro_batches_follow_in_order_and_none_holds_the_table(spark, tmp_path):
    stream, seen = stateful.in_order(spark, SF, "lineitem", F.expr("l_orderkey div 4"), 1000), []

    def batch(df, _):
        seen.append(tuple(df.agg(F.min(F.expr("l_orderkey div 4")), F.max(F.expr("l_orderkey div 4")), F.count("*")).first()))

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert len(seen) == -(-n // 1000) > 3 and sum(s[2] for s in seen) == n and max(s[2] for s in seen) < 2000
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_streams_by_micro_batches_equal_batches(spark, monkeypatch):
    monkeypatch.setattr(stateful, "AT_ONCE", 1500)
    for stream, whole in (("stream_object_expiry", "object_expiry"), ("stream_sequence_batches", "sequence_batches"), ("stream_ship_labels", "pipeline_ship_labels"), ("stream_sort_tracking", "sort_tracking")):
        got = QUERIES[stream](spark, SF)
        columns = [c for c in got.columns if c in QUERIES[whole](spark, SF).columns]
        assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(tuple(r) for r in QUERIES[whole](spark, SF).select(columns).collect()), stream

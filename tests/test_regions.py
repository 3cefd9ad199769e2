"""Regions as a dimension: its size is known, detections aren't shuffled by source, and the grid gives what each source's polygons give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.plans import more, pipelines, shipped  # noqa: F401  (they register their queries)
from vigil.plans.queries import QUERIES, REGIONS, dimension
from vigil.sources import regions, views

SF = "/root/testdata/sf0.001"
BOXES = "source_id string, x int, y int, w int, h int"


def shapes(rnd, n, most=400):
    out = []
    for i in range(n):
        x, y, size = rnd.randrange(1920), rnd.randrange(1080), rnd.choice([3, 20, 64, 128, most])
        points = [{"NormalizedX": (x + rnd.randrange(-size, size + 1)) / 1920, "NormalizedY": (y + rnd.randrange(-size, size + 1)) / 1080} for _ in range(rnd.choice([3, 4, 5, 9]))]
        if i % 7 == 0:  # sides along the grid's lines
            a, b = x // 64 * 64, y // 64 * 64
            points = [{"NormalizedX": p / 1920, "NormalizedY": q / 1080} for p, q in ((a, b), (a + 128, b), (a + 128, b + 64), (a, b + 64))]
        out.append({"Name": f"n{i}", "Index": i, "Type": "t", "Points": points})
    return out


def definition(rnd, n, most=400):
    four = [shapes(rnd, n, most) for _ in range(4)]
    return regions.definition(dict(zip(("AnalysisAreas", "ExcludedAreas", "Lanes", "InterestAreas"), four)) | {"IsObjectAnalyzableRetain": True}, 1920, 1080)


def boxes(spark, rnd, n, sources):
    rows = [(rnd.choice(sources), rnd.randrange(-80, 1900), rnd.randrange(-80, 1070), rnd.randrange(0, 150), rnd.randrange(0, 150)) for _ in range(n)]
    rows += [(sources[0], x, y, 0, 0) for x in range(0, 1920, 64) for y in range(0, 1080, 64)]  # on the grid's corners
    return spark.createDataFrame(rows, BOXES)


def rows_of(df):
    return sorted(map(str, df.select("source_id", "x", "y", "w", "h", "under_analysis", "lane", "areas", "retain").collect()))


@pytest.mark.parametrize("size", [16, 64, 500])
def test_the_grid_equals_the_polygons(spark, size):
    rnd = random.Random(size)
    dim = regions.dimension(spark, [{"source_id": "a", **definition(rnd, 15)}, {"source_id": "b", **definition(rnd, 3)}, {"source_id": "none", **regions.definition({}, 1920, 1080)}])
    dets = boxes(spark, rnd, 1500, ["a", "b", "none"])
    assert rows_of(regions.tagged_by_cells(dets, dim, size=size)) == rows_of(regions.tagged(dets, dim))


def test_a_source_of_ten_thousand_polygons(spark):
    rnd = random.Random(3)
    rows = [{"source_id": "a", **definition(rnd, 2500, 64)}]
    assert regions.many(rows) and not regions.many(REGIONS)
    dim, dets = regions.dimension(spark, rows), boxes(spark, rnd, 60, ["a"])
    assert rows_of(regions.tagged_by_cells(dets, dim)) == rows_of(regions.tagged(dets, dim))
    tested = regions.cells(dim).select(F.size(F.filter("shapes", lambda s: ~s["whole"])).alias("n"))
    assert tested.agg(F.max("n")).first()[0] < 500  # polygons that a point is tested against, of 10,000


def test_sources_without_a_definition(spark):
    dim, dets = regions.dimension(spark, REGIONS), spark.createDataFrame([("cam-0", 1, 1, 1, 1), ("nowhere", 1, 1, 1, 1)], BOXES)
    assert regions.tagged_by_cells(dets, dim, "drop").count() == regions.tagged(dets, dim, "drop").count() == 1
    with pytest.raises(Exception, match="no region definition"):
        regions.tagged_by_cells(dets, dim).collect()


@pytest.mark.parametrize("name", ["region_tagging", "density_events", "region_retain", "label_occurrence", "region_geometry", "count_lines", "pipeline_people_density", "pipeline_fire_smoke"])
def test_detections_are_not_shuffled_by_source(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [source_id#" in plan and not re.search(r"SortMergeJoin \[source_id#\d+\], \[source_id#\d+\]", plan), plan


def test_a_large_dimension_is_a_table_of_known_size(spark):
    small, large = dimension(spark), regions.dimension(spark, REGIONS, local=0)
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(small) < 10 << 20 and size(large) < 10 << 20
    dets = views.detections(spark, SF)
    assert rows_of(regions.tagged(dets, small)) == rows_of(regions.tagged(dets, large))


def test_pipelines_take_the_grid_for_many_polygons(spark, tmp_path, monkeypatch):
    import json

    rnd = random.Random(8)
    for s in shipped.SOURCES:
        areas = [{"Name": "watch", "Points": [{"NormalizedX": x, "NormalizedY": y} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]}]
        (tmp_path / f"{s}.json").write_text(json.dumps({"AnalysisAreas": areas + shapes(rnd, 40, 64), "InterestAreas": areas}))
    dets = views.detections(spark, SF)
    by_cells = sorted(map(str, pipelines.events(dets, shipped.PIPELINES["people_density"], tmp_path).collect()))
    monkeypatch.setattr(regions, "MANY", 10**9)
    assert by_cells and by_cells == sorted(map(str, pipelines.events(dets, shipped.PIPELINES["people_density"], tmp_path).collect()))


def test_a_boat_in_the_corner_has_no_place(spark):
    """Nobody flees from a boat whose centre is (0, 0)."""
    f = pipelines.Frames(spark.createDataFrame([("s", i, "boat", 1, 0.9, 0, 0, 0, 0, True, None, [], True) for i in range(8)] + [("s", i, "person", 2, 0.9, 10 * i, 10, 4, 4, True, None, [], True) for i in range(8)], "source_id string, frame_id long, label string, tracking_id int, confidence double, x int, y int, w int, h int, under_analysis boolean, lane int, areas array<string>, retain boolean"), None, None, pipelines.Hooks())
    assert pipelines.people_and_boat(f, 10, 0.5).count() == 0


def test_a_positioned_scan_reads_only_files_in_its_range(spark, tmp_path):
    """The range of frames is one of the stored key: files and row groups beyond it are skipped."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.repartitionByRange(8, "l_orderkey").sortWithinPartitions("l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["positioned_scan"](spark, str(tmp_path))
    assert sorted(map(str, df.collect())) == sorted(map(str, QUERIES["positioned_scan"](spark, SF).collect()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey,400)" in plan and "LessThanOrEqual(l_orderkey,903)" in plan
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    assert metrics.apply("numOutputRows").value() < lines.count() / 2


def test_the_box_in_a_polygon_never_says_otherwise_than_its_edges(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        points = [{"NormalizedX": rng.randrange(0, 11) / 10, "NormalizedY": rng.randrange(0, 11) / 10} for _ in range(rng.randrange(3, 8))]
        rows.append((i, regions.polygon(points, 20, 20)))
    square = regions.polygon([{"NormalizedX": x, "NormalizedY": y} for x, y in ((0.1, 0.1), (0.9, 0.1), (0.9, 0.8), (0.1, 0.8))], 20, 20)
    assert square["inner"] == {"x0": 2.0, "y0": 2.0, "x1": 18.0, "y1": 16.0}
    assert sum(r["inner"] is not None for _, r in rows) > 10
    df = spark.createDataFrame(rows, f"i int, s struct<{regions.SHAPE}>").crossJoin(spark.range(22 * 22).select((F.col("id") % 22).cast("double").alias("px"), F.floor(F.col("id") / 22).cast("double").alias("py")))
    px, py, s = F.col("px"), F.col("py"), F.col("s")
    assert df.filter(~regions.within_shape(px, py, s).eqNullSafe(regions.within(px, py, s))).count() == 0

"""Boxes that lie apart are merged without the fold."""

import time

import pytest

from vigil.operators import frames


@pytest.mark.parametrize("variant", ["all", "largest", "forward", "first"])
def test_many_boxes_apart_and_two_that_meet(spark, variant):
    grid = [(30 * (i % 20), 30 * (i // 20), 20, 20) for i in range(200)]
    rows = [("s", f, *b) for f in range(8) for b in grid] + [("s", 99, 0, 0, 20, 20), ("s", 99, 2, 2, 20, 20), ("s", 99, 90, 2, 20, 20)]
    df = spark.createDataFrame(rows, "source_id string, frame_id long, x int, y int, w int, h int").coalesce(1)
    began = time.perf_counter()
    got = sorted(tuple(r)[1:] for r in frames.merged(df, variant, 0.15).collect())
    assert got == sorted([(f, *b) for f in range(8) for b in grid] + [(99, 0, 0, 22, 22), (99, 90, 2, 20, 20)])
    if variant == "all":
        assert time.perf_counter() - began < 20

"""The detector hook: one result whole, in batches and in tiles; models are kept; odd pictures."""

import numpy as np

from vigil.operators import detector
from vigil.plans.more import BrightParts

SCHEMA = "source_id string, frame_id long, width int, height int, pixels binary"


def picture(wide, high, *boxes):
    p = np.zeros((high, wide), np.uint8)
    for x, y, w, h in boxes:
        p[y : y + h, x : x + w] = 255
    return p


def rows_of(df):
    return sorted(tuple(r)[:2] + tuple(r)[4:] for r in df.collect())


def test_boxes_over_seams_are_one_and_batches_do_not_matter(spark):
    boxes = [(0, 0, 1, 1), (20, 10, 30, 30), (24, 18, 24, 18), (0, 0, 101, 61), (95, 50, 6, 11), (23, 0, 2, 61)]
    rows = [("s", i, 101, 61, picture(101, 61, b).tobytes()) for i, b in enumerate(boxes)]
    df = spark.createDataFrame([(s, f, w, h, bytearray(p)) for s, f, w, h, p in rows], SCHEMA)
    want = [("s", i, *b) for i, b in enumerate(boxes)]
    assert rows_of(detector.detect(df, "b", BrightParts)) == want
    for tiles in ((4, 3), (1, 5), (7, 1), (50, 40)):
        assert rows_of(detector.detect(df, "b", BrightParts, tiles=tiles, batch_bytes=7000)) == want


def test_pictures_that_show_nothing(spark):
    rows = [("s", 1, 4, 4, None), ("s", 2, 0, 0, b""), ("s", 3, None, 4, b"x"), ("s", 4, 4, 4, b"\x01"), (None, 5, 2, 2, b"\x00\x00\x00\x00"), (None, 6, 2, 2, b"\x00\xff\x00\x00")]
    df = spark.createDataFrame([(s, f, w, h, None if p is None else bytearray(p)) for s, f, w, h, p in rows], SCHEMA)
    assert [tuple(r) for r in detector.detect(df, "b", BrightParts).collect()] == [(None, 6, "bright", 1.0, 1, 0, 1, 1)]
    assert detector.detect(df.limit(0), "b", BrightParts, tiles=(2, 2)).count() == 0


def test_a_model_is_made_once():
    made = []
    for _ in range(3):
        detector.made("once", lambda: made.append(1) or BrightParts())
    assert made == [1]


def test_tiles_cover_a_picture_once():
    p = np.arange(35).reshape(5, 7)
    for columns, rows in ((1, 1), (3, 2), (7, 5), (9, 9)):
        again = np.full((5, 7), -1)
        for x, y, part in detector.cut(p, columns, rows):
            assert part.size and (again[y : y + part.shape[0], x : x + part.shape[1]] == -1).all()
            again[y : y + part.shape[0], x : x + part.shape[1]] = part
        assert (again == p).all()


def test_looks_share_one_pass_and_stacks_say_what_lists_say(spark):
    boxes = [(0, 0, 1, 1), (20, 10, 30, 30), (24, 18, 24, 18), (95, 50, 6, 11)]
    rows = [("s", i, 101, 61, bytearray(picture(101, 61, b).tobytes())) for i, b in enumerate(boxes)] + [("s", 9, 7, 5, bytearray(picture(7, 5, (6, 4, 1, 1)).tobytes() + b"rest")), ("s", 10, 7, 5, bytearray(35))]
    df = spark.createDataFrame(rows, SCHEMA)
    found = detector.looks(df, "b", BrightParts, {"whole": {}, "small": {"batch_bytes": 1}, "tiles": {"tiles": (4, 3), "batch_bytes": 7000}})
    want = [("s", i, *b) for i, b in enumerate(boxes)] + [("s", 9, 6, 4, 1, 1)]
    for look in ("whole", "small", "tiles"):
        assert rows_of(found.filter(found.look == look).drop("look")) == want
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    stack = np.stack([picture(96, 54, b) for b in ((3, 4, 5, 6), (0, 0, 96, 54), (0, 0, 0, 0), (95, 53, 1, 1))])
    listed = [(i, *f) for i, boxes in enumerate(BrightParts().detect(list(stack))) for f in boxes]
    for s in (stack, np.repeat(np.repeat(stack, 2, 1), 2, 2)[:, ::2, ::2]):
        assert [tuple(r) for r in zip(*BrightParts().detect_stack(s), strict=True)] == listed

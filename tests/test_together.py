"""Pieces of a source that go on together give what one tracker gives, and take few steps of it."""

import random

import numpy as np
import pytest

from vigil.operators import appearance, folds, together


class Counted(folds._Sort):
    def __init__(self, *settings):
        super().__init__(*settings)
        self.steps = 0

    def __call__(self, frame, boxes):
        self.steps += 1
        return super().__call__(frame, boxes)


def made(seed, n, lasting):
    """Frames with gaps, whose boxes drift for a while and overlap; lasting: one is in all of them."""
    rnd, alive, frames, rows = random.Random(seed), [], [], []
    for f in range(n):
        if f % 97 > 90 or rnd.random() < 0.05 and not lasting:
            continue
        alive = [[x + dx, y + dy, w, h, dx, dy] for x, y, w, h, dx, dy in alive if rnd.random() > 0.1]
        alive += [[rnd.randrange(300), rnd.randrange(300), rnd.randrange(5, 90), rnd.randrange(5, 90), rnd.randrange(-4, 5), rnd.randrange(-4, 5)] for _ in range(rnd.randrange(3))]
        here = sorted(a[:4] for a in alive) + ([[1000 + f % 3, 1000, 50, 50]] if lasting else [])
        if here:
            frames.append(f)
            rows.append(here)
    begins = np.cumsum([0, *map(len, rows)])[:-1]
    return np.array(frames), np.array([b for r in rows for b in r], float), begins


@pytest.mark.parametrize("lasting", [False, True])
def test_pieces_equal_one_tracker_over_two_micro_batches(lasting):
    one, many = folds._Sort(0.3, 3), Counted(0.3, 3)
    for seed, shift in ((1, 0), (2, 2000), (3, 3500)):  # the last one begins before the second one has ended
        frames, boxes, begins = made(seed, 2000, lasting)
        want = [i for f, b in zip(frames.tolist(), np.split(boxes, begins[1:]), strict=True) for i in one(f + shift, b)]
        many.steps = 0
        assert together.sort_ids(many, frames + shift, boxes, begins, 100, 40).tolist() == want
        assert lasting or many.steps < len(frames) / 4
        assert np.array_equal(one.tracker.x, many.tracker.x) and np.array_equal(one.tracker.of, many.tracker.of) and (one.tracker.next, one.last) == (many.tracker.next, many.last)


def test_few_frames_go_through_the_tracker():
    one, many = folds._Sort(0.3, 3), folds._Sort(0.3, 3)
    frames, boxes, begins = made(4, 50, False)
    assert together.sort_ids(many, frames, boxes, begins).tolist() == [i for f, b in zip(frames.tolist(), np.split(boxes, begins[1:]), strict=True) for i in one(f, b)]


@pytest.mark.parametrize("lasting", [False, True])
def test_pieces_of_boxes_with_looks_equal_one_tracker(lasting):
    kinds = np.array([[1.0, 0, 0], [0.6, 0.8, 0], [0, 0, 1.0], [0, 0, 0]])
    settings = {"threshold": 0.3, "streak": 2, "misses": 5, "smooth": 4}
    one, many, reported = appearance._Seen(settings), CountedLooks(settings), 0
    for seed in (1, 2):
        frames, boxes, begins = made(seed, 1000 if lasting else 3000, lasting)
        looks = kinds[(boxes[:, 2] + boxes[:, 3]).astype(int) % 4]
        want = [i for f, b, k in zip(frames.tolist(), np.split(boxes, begins[1:]), np.split(looks, begins[1:]), strict=True) for i in one(f, b, k)]
        many.steps = 0
        assert appearance.look_ids(many, boxes, looks, begins, 300, 200).tolist() == want
        assert lasting or many.steps < len(frames) / 4
        assert one.tracker.digest() == many.tracker.digest() and one.tracker.of.tolist() == many.tracker.of.tolist() and one.tracker.next == many.tracker.next
        reported += sum(map(bool, want))
    assert reported


class CountedLooks(appearance._Seen):
    def __call__(self, *row):
        self.steps += 1
        return super().__call__(*row)

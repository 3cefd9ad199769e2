"""A source's frames through one tracker, as many pieces that go on together: a step of numpy takes a frame of each piece, so that its fixed cost is shared."""

from __future__ import annotations

import numpy as np

from vigil.operators.folds import Tracker, _Sort, assign, ranges, renumbered

#: Frames of a piece, and of those before it that it begins with.
PIECE, BEFORE = 512, 128

#: Of a tracker: tracks, what is kept of them, the next number.
State = tuple[np.ndarray, np.ndarray, int]


class _Pieces(Tracker):
    """The tracks of all pieces, in order of pieces; within a piece they stand, and are worked on, as in a Tracker of its own."""

    def __init__(self, overlap: float, misses: int, count: int, first: State):
        super().__init__(overlap, misses)
        self.x, self.of, self.piece = first[0].copy(), first[1].copy(), np.zeros(len(first[0]), np.int64)
        self.nexts = np.ones(count, np.int64)
        self.nexts[0] = first[2]
        self.gain(misses + 1)  # a track's first update comes before it has missed more frames
        self.table = np.array(self._gains[: misses + 1])

    def state(self, k: int) -> State:
        i, j = np.searchsorted(self.piece, [k, k + 1])
        return self.x[i:j].copy(), self.of[i:j].copy(), int(self.nexts[k])

    def drop(self, gone: np.ndarray) -> None:
        stay = ~gone[self.piece]
        self.x, self.of, self.piece = self.x[stay], self.of[stay], self.piece[stay]

    def _matched(self, boxes: np.ndarray, of_piece: np.ndarray, tracks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes and tracks that belong together."""
        x, y, w, h = tracks
        first = np.searchsorted(self.piece, np.arange(len(self.nexts) + 1))
        reps = (first[1:] - first[:-1])[of_piece]
        i, j = np.repeat(np.arange(len(boxes)), reps), ranges(first[of_piece], reps)
        bx, by, bw, bh = boxes.T
        wide = np.minimum((bx + bw)[i], (x + w)[j]) - np.maximum(bx[i], x[j]) + 1
        some = wide > 0
        i, j, wide = i[some], j[some], wide[some]
        both = np.minimum((by + bh)[i], (y + h)[j]) - np.maximum(by[i], y[j]) + 1
        some = both > 0
        i, j, wide, both = i[some], j[some], wide[some], both[some]
        cost = np.trunc(-100 * wide * both / (((bw + 1) * (bh + 1))[i] + ((w + 1) * (h + 1))[j] - wide * both + 1e-5))
        least, some = int(-100 * self.overlap), cost < 0
        i, j, cost = i[some], j[some], cost[some]
        near = cost <= least
        crowd = (np.bincount(i, minlength=len(boxes))[i] > 1) | (np.bincount(j, minlength=len(x))[j] > 1)
        hard = np.intersect1d(of_piece[i[crowd]], of_piece[i[near]])
        if not len(hard):
            return i[near], j[near]
        easy = near & ~np.isin(of_piece[i], hard)
        more = [[], []]
        for k in hard.tolist():
            a, b = np.searchsorted(of_piece, [k, k + 1])
            full, here = np.zeros((b - a, first[k + 1] - first[k])), of_piece[i] == k
            full[i[here] - a, j[here] - first[k]] = cost[here]
            for m, n in assign(full):
                if full[m, n] <= least:
                    more[0].append(m + a)
                    more[1].append(n + first[k])
        return np.concatenate([i[easy], more[0]]).astype(int), np.concatenate([j[easy], more[1]]).astype(int)

    def steps(self, boxes: np.ndarray, of_piece: np.ndarray) -> np.ndarray:
        """The track of each box of the next frame of each piece; boxes stand in order of pieces."""
        of, ids = self.of, np.zeros(len(boxes), np.int64)
        tracks = self._predict()
        of[:, 1:3] += 1
        states = self._states(boxes)
        if len(of) and len(boxes):
            i, j = self._matched(boxes, of_piece, tracks)
            of[j, 3] = np.where(of[j, 3] > 0, of[j, 3], of[j, 2])
            self.x[j] = self.moved(self.x[j], self.table[of[j, 3] - 1], states[i])
            of[j, 1], ids[i] = 0, of[j, 0]
        stay, new = of[:, 1] <= self.misses, np.flatnonzero(ids == 0)
        at = of_piece[new]
        ids[new] = self.nexts[at] + np.arange(len(new)) - np.searchsorted(at, at)
        self.nexts += np.bincount(at, minlength=len(self.nexts))
        piece = np.concatenate([self.piece[stay], at])
        order = np.argsort(piece, kind="stable")
        born = np.zeros((len(new), of.shape[1]), np.int64)
        born[:, 0] = ids[new]
        self.piece, self.x, self.of = piece[order], np.concatenate([self.x[stay], states[new]])[order], np.concatenate([of[stay], born])[order]
        return ids


def sort_ids(track: _Sort, frames: np.ndarray, boxes: np.ndarray, begins: np.ndarray, size: int = PIECE, before: int = BEFORE) -> np.ndarray:
    """The track of each box, as track would give them frame by frame, and track goes on to the end. frames: ascending, begins: where the boxes of each stand.

    Each piece but the first begins some frames before its own, without tracks. Where it comes to its own frames with the very tracks that the piece before it ended with, its answers are those of one tracker,
    but for the numbers; where it doesn't, that piece goes through the tracker itself."""
    n, t = len(frames), track.tracker
    ends = np.concatenate([begins[1:], [len(boxes)]])

    def alone(i: int, j: int) -> list[int]:
        return [k for f, a, b in zip(frames[i:j].tolist(), begins[i:j].tolist(), ends[i:j].tolist(), strict=True) for k in track(f, boxes[a:b])]

    count = n // max(size, before, 1)
    if count < 2 or t.overlap < 0.01:  # so low a bound lets boxes that don't meet belong together
        return np.array(alone(0, n), np.int64)
    own = np.linspace(0, n, count + 1).astype(int)
    from_ = np.concatenate([[0], np.maximum(own[1:-1] - before, 0)])
    # all steps of the source, with those of frames without boxes
    none = np.minimum(np.diff(frames, prepend=frames[0] if track.last is None else track.last) - 1, track.forgets).clip(0)
    place = np.cumsum(none + 1) - 1
    lo, length = np.zeros(place[-1] + 1, int), np.zeros(place[-1] + 1, int)
    lo[place], length[place] = begins, ends - begins
    start = np.concatenate([[0], place[from_[1:]]])
    steps, mark = place[own[1:] - 1] + 1 - start, np.concatenate([[0], place[own[1:-1] - 1] + 1 - start[1:]])
    pieces, out = _Pieces(t.overlap, t.misses, count, (t.x, t.of, t.next)), np.zeros(len(boxes), np.int64)
    entered: dict[int, State] = {}
    left: dict[int, State] = {}
    for s in range(int(steps.max()) + 1):
        entered.update({k: pieces.state(k) for k in np.flatnonzero(mark == s).tolist()})
        if (over := steps == s).any():
            left.update({k: pieces.state(k) for k in np.flatnonzero(over).tolist()})
            pieces.drop(over)
        live = np.flatnonzero(steps > s)
        if len(live):
            at = start[live] + s
            rows, of_piece = ranges(lo[at], length[at]), np.repeat(live, length[at])
            ids, mine = pieces.steps(boxes[rows], of_piece), mark[of_piece] <= s
            out[rows[mine]] = ids[mine]
    for k in range(count):
        a, b = int(own[k]), int(own[k + 1])
        rows = slice(begins[a], ends[b - 1])
        (x, of, first), (end_x, end_of, end) = entered[k], left[k]
        if np.array_equal(x, t.x) and np.array_equal(of[:, 1:], t.of[:, 1:]):
            out[rows], end_of[:, 0] = (renumbered(ids, of[:, 0], first, t.of[:, 0], t.next) for ids in (out[rows], end_of[:, 0]))
            t.x, t.of, t.next, track.last = end_x, end_of, end + t.next - first, int(frames[b - 1])
        else:
            out[rows] = alone(a, b)
    return out

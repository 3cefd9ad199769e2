"""Tracking by appearance and place: the cost of a pair blends the cosine distance of appearances with the boxes' overlap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.folds import WARM_UP, Tracker, assign, ranges, renumbered, tracked

#: Frame numbers of a block, of which many pieces go on together; frames of a piece, and of those before it that it begins with.
LOOK_BLOCK, PIECE, BEFORE = 32_768, 768, 384


class AppearanceTracker(Tracker):
    """Boxes with a vector each. A track's appearance is the mean of its last smooth vectors, weighs more once it has lived so long, and the track is
    reported from its streak-th match in a row on. The gain is computed anew at each update; a track predicted out of the picture ends."""

    KEPT = ("id", "misses", "streak", "life")

    def __init__(self, weight: float = 0.8, smooth_weight: float = 0.875, smooth: int = 40, threshold: float = 0.5, misses: int = 50, streak: int = 8):
        super().__init__(threshold, misses)
        self.weight, self.smooth_weight, self.smooth, self.streak, self.next = weight, smooth_weight, smooth, streak, 2
        self.box, self.P, self.looks, self.known = np.zeros((4, 0)), np.zeros((0, 7, 7)), [], np.zeros((0, 0))

    def _rests_on(self) -> list[np.ndarray]:
        return [*super()._rests_on(), self.P, np.array([len(k) for k in self.looks]), *[v for k in self.looks for v in k]]

    def _keep(self, stay: np.ndarray) -> None:
        if not stay.all():
            self.x, self.of, self.box, self.P, self.known = self.x[stay], self.of[stay], self.box[:, stay], self.P[stay], self.known[stay]
            self.looks = [k for k, s in zip(self.looks, stay.tolist(), strict=True) if s]

    def _move(self) -> None:
        of, P = self.of, self.P
        of[of[:, 1] > 0, 2] = 0
        of[:, 1] += 1
        self.box = self._predict()
        P[:, :3] += P[:, 4:]  # F P F' + Q
        P[:, :, :3] += P[:, :, 4:]
        P += self.Q_
        self._keep((self.box[0] >= 0) & (self.box[1] >= 0))

    def _costs(self, boxes: np.ndarray, looks: np.ndarray) -> np.ndarray:
        """[boxes, tracks]"""
        norms = np.linalg.norm(looks, axis=1)[:, None] * np.linalg.norm(self.known, axis=1)[None]
        far = np.maximum(1 - np.divide(looks @ self.known.T, norms, out=np.zeros_like(norms), where=norms > 0), 0)
        (ax, ay, aw, ah), (bx, by, bw, bh) = boxes.T[:, :, None], self.box
        w = np.maximum(0, np.minimum(ax + aw, bx + bw) - np.maximum(ax, bx))
        h = np.maximum(0, np.minimum(ay + ah, by + bh) - np.maximum(ay, by))
        union = aw * ah + bw * bh - w * h
        overlap = np.divide(w * h, union, out=np.zeros_like(union), where=union > 0)
        weight = np.where(self.of[:, 3] < self.smooth, self.weight, self.smooth_weight)
        return weight * far + (1 - weight) * (1 - overlap)

    def _update(self, j: np.ndarray, seen: np.ndarray) -> None:
        P = self.P[j]
        gain = P[:, :, :4] @ np.linalg.inv(P[:, :4, :4] + self.R_)
        self.x[j] = self.moved(self.x[j], gain, seen)
        self.P[j] = (np.eye(7) - gain @ self.H_) @ P
        self.of[j, 1] = 0
        self.of[j, 2:] += 1

    def _look(self, j: int, look: np.ndarray) -> None:
        self.looks[j] = [*self.looks[j][1 - self.smooth :], look] if self.smooth > 1 else [look]
        self.known[j] = np.array(self.looks[j]).sum(0) / len(self.looks[j])

    def step(self, boxes: np.ndarray, looks: np.ndarray) -> list[int]:
        """The reported track of each box of the next frame that has boxes; 0 where there is none."""
        n, found = len(boxes), {}
        if len(self.of):
            self._move()
        if len(self.of) and n:
            cost = self._costs(boxes, looks)
            near = 1 - cost >= self.overlap
            states = self._states(boxes)
            for i, j in assign(cost) if near.any() else ():  # no pair is alike enough: none is matched, whatever is assigned
                if near[i, j]:
                    self._update(np.array([j]), states[[i]])
                    self._look(j, looks[i])
                    found[i] = j
        out = [int(self.of[found[i], 0]) if i in found and self.of[found[i], 2] >= self.streak else 0 for i in range(n)]
        self._keep(self.of[:, 1] <= self.misses)
        new = [i for i in range(n) if i not in found]
        if new:
            self.x = np.concatenate([self.x, self._states(boxes[new])])
            self.of = np.concatenate([self.of, [[self.next + k, 0, 0, 0] for k in range(len(new))]])
            self.P = np.concatenate([self.P, np.broadcast_to(self.P_, (len(new), 7, 7))])
            self.box = np.concatenate([self.box, boxes[new].T], axis=1)
            self.looks += [[looks[i]] for i in new]
            self.known = np.concatenate([self.known.reshape(-1, looks.shape[1]), looks[new]])
            self.next += len(new)
        return out


class _Seen:
    def __init__(self, settings: dict):
        self.tracker = AppearanceTracker(**settings)

    def __call__(self, frame: int, boxes: np.ndarray, looks: np.ndarray) -> list[int]:
        return self.tracker.step(boxes, looks)

    def many(self, frames: np.ndarray, boxes: np.ndarray, begins: np.ndarray, looks: np.ndarray) -> list[int]:
        return look_ids(self, boxes, looks, begins).tolist()


class _Pieces(AppearanceTracker):
    """The tracks of all pieces of a source's frames, in order of pieces; within a piece they stand, and are worked on, as in a tracker of its own."""

    def __init__(self, first: AppearanceTracker, count: int):
        super().__init__(first.weight, first.smooth_weight, first.smooth, first.overlap, first.misses, first.streak)
        self.x, self.of, self.P, self.known, self.looks, self.box = first.x.copy(), first.of.copy(), first.P.copy(), first.known.copy(), list(first.looks), np.zeros((4, len(first.of)))
        self.piece, self.nexts = np.zeros(len(first.of), np.int64), np.full(count, 2)
        self.nexts[0] = first.next

    def _keep(self, stay: np.ndarray) -> None:
        self.piece = self.piece[stay]
        super()._keep(stay)

    def state(self, k: int) -> AppearanceTracker:
        i, j = np.searchsorted(self.piece, [k, k + 1])
        t = AppearanceTracker(self.weight, self.smooth_weight, self.smooth, self.overlap, self.misses, self.streak)
        t.x, t.of, t.P, t.known, t.looks, t.box, t.next = self.x[i:j].copy(), self.of[i:j].copy(), self.P[i:j].copy(), self.known[i:j].copy(), self.looks[i:j], self.box[:, i:j].copy(), int(self.nexts[k])
        return t

    def steps(self, boxes: np.ndarray, looks: np.ndarray, of_piece: np.ndarray) -> np.ndarray:
        """The reported track of each box of the next frame of each piece; boxes stand in order of pieces."""
        if len(self.of):
            self._move()
        ids, found, states = np.zeros(len(boxes), np.int64), np.zeros(len(boxes), bool), self._states(boxes)
        if len(self.of):
            i, j = self._matched(boxes, looks, of_piece)
            if len(i):
                self._update(j, states[i])
                for m, n in zip(i.tolist(), j.tolist(), strict=True):
                    self._look(n, looks[m])
                found[i], ids[i] = True, np.where(self.of[j, 2] >= self.streak, self.of[j, 0], 0)
        self._keep(self.of[:, 1] <= self.misses)
        new = np.flatnonzero(~found)
        at = of_piece[new]
        born = np.zeros((len(new), self.of.shape[1]), np.int64)
        born[:, 0] = self.nexts[at] + np.arange(len(new)) - np.searchsorted(at, at)
        self.nexts += np.bincount(at, minlength=len(self.nexts))
        piece = np.concatenate([self.piece, at])
        order = np.argsort(piece, kind="stable")
        both = lambda a, b: np.concatenate([a, b])[order]
        self.piece, self.x, self.of, self.P = piece[order], both(self.x, states[new]), both(self.of, born), both(self.P, np.broadcast_to(self.P_, (len(new), 7, 7)))
        self.box, self.known = both(self.box.T, boxes[new]).T, both(self.known.reshape(-1, looks.shape[1]), looks[new])
        held = [*self.looks, *[[looks[n]] for n in new.tolist()]]
        self.looks = [held[n] for n in order.tolist()]
        return ids

    def _matched(self, boxes: np.ndarray, looks: np.ndarray, of_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = np.arange(len(self.nexts) + 1)
        row, first = np.searchsorted(of_piece, pieces), np.searchsorted(self.piece, pieces)
        tracks = first[1:] - first[:-1]
        reps = tracks[of_piece]
        i, j = np.repeat(np.arange(len(boxes)), reps), ranges(first[of_piece], reps)
        dots = [(looks[a:b] @ self.known[c:d].T).ravel() for a, b, c, d in zip(row[:-1].tolist(), row[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True) if a < b and c < d]
        norms = np.linalg.norm(looks, axis=1)[i] * np.linalg.norm(self.known, axis=1)[j]
        far = np.maximum(1 - np.divide(np.concatenate([np.zeros(0), *dots]), norms, out=np.zeros_like(norms), where=norms > 0), 0)
        (ax, ay, aw, ah), (bx, by, bw, bh) = boxes.T, self.box
        w = np.maximum(0, np.minimum((ax + aw)[i], (bx + bw)[j]) - np.maximum(ax[i], bx[j]))
        h = np.maximum(0, np.minimum((ay + ah)[i], (by + bh)[j]) - np.maximum(ay[i], by[j]))
        union = (aw * ah)[i] + (bw * bh)[j] - w * h
        overlap = np.divide(w * h, union, out=np.zeros_like(union), where=union > 0)
        weight = np.where(self.of[:, 3] < self.smooth, self.weight, self.smooth_weight)[j]
        cost = weight * far + (1 - weight) * (1 - overlap)
        near = 1 - cost >= self.overlap
        begin = np.concatenate([[0], np.cumsum((row[1:] - row[:-1]) * tracks)])
        out = [[], []]
        for k in np.unique(of_piece[i[near]]).tolist():
            at, n = begin[k], tracks[k]
            for r, c in assign(cost[at : begin[k + 1]].reshape(-1, n)):
                if near[at + r * n + c]:
                    out[0].append(r + row[k])
                    out[1].append(c + first[k])
        return np.array(out[0], int), np.array(out[1], int)


def look_ids(track: _Seen, boxes: np.ndarray, looks: np.ndarray, begins: np.ndarray, size: int = PIECE, before: int = BEFORE) -> np.ndarray:
    """The reported track of each box (0: none), as track would give them frame by frame, and track goes on to the end. begins: where the boxes of each frame stand. Pieces of the frames go on together, as in
    together.sort_ids: each but the first begins some frames before its own, and goes through the tracker itself, unless it comes to its own with the very tracks that the piece before it ended with."""
    n, out = len(begins), np.zeros(len(boxes), np.int64)
    ends = np.concatenate([begins[1:], [len(boxes)]])

    def alone(i: int, j: int) -> None:
        for a, b in zip(begins[i:j].tolist(), ends[i:j].tolist(), strict=True):
            out[a:b] = track(0, boxes[a:b], looks[a:b])

    count = n // max(size, before, 1)
    if count < 2:
        alone(0, n)
        return out
    own = np.linspace(0, n, count + 1).astype(int)
    start = np.concatenate([[0], own[1:-1] - before])
    steps, mark = own[1:] - start, own[:-1] - start
    pieces, entered, left = _Pieces(track.tracker, count), {}, {}
    for s in range(int(steps.max()) + 1):
        entered.update({k: pieces.state(k) for k in np.flatnonzero(mark == s).tolist()})
        over = steps == s
        if over.any():
            left.update({k: pieces.state(k) for k in np.flatnonzero(over).tolist()})
            pieces._keep(~over[pieces.piece])
        live = np.flatnonzero(steps > s)
        if len(live):
            at = start[live] + s
            rows, of_piece = ranges(begins[at], (ends - begins)[at]), np.repeat(live, (ends - begins)[at])
            ids, mine = pieces.steps(boxes[rows], looks[rows], of_piece), mark[of_piece] <= s
            out[rows[mine]] = ids[mine]
    for k in range(count):
        a, b, t = int(own[k]), int(own[k + 1]), track.tracker
        if entered[k].digest() == t.digest():
            rows = slice(begins[a], ends[b - 1])
            out[rows], left[k].of[:, 0] = (renumbered(ids, entered[k].of[:, 0], entered[k].next, t.of[:, 0], t.next) for ids in (out[rows], left[k].of[:, 0]))
            left[k].next += t.next - entered[k].next
            track.tracker = left[k]
        else:
            alone(a, b)
    return out


def appearance_tracks(dets: DataFrame, look: str, size: int = LOOK_BLOCK, warm_up: int = WARM_UP, **settings) -> DataFrame:
    """The detections that belong to a reported track, with track_id. A source's frames stream through trackers by blocks, as in folds.tracked."""
    return tracked(dets.filter(F.col(look).isNotNull()), lambda: _Seen(settings), look, size, warm_up)

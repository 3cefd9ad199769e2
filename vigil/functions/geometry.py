"""Column functions on boxes (integers, half open) and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(*values: Column) -> Column:
    bad = [F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")) for v in values]
    out = ~bad[0]
    for b in bad[1:]:
        out = out & ~b
    return out


class Box:
    """A box of four columns; its methods give columns."""

    def __init__(self, x, y, w, h):
        self.x, self.y, self.w, self.h = (F.col(c) if isinstance(c, str) else c for c in (x, y, w, h))

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*(f"{prefix}{c}{suffix}" for c in "xywh"))

    xmax = property(lambda s: s.x + s.w)
    ymax = property(lambda s: s.y + s.h)
    cx = property(lambda s: s.x + s.w / 2.0)
    cy = property(lambda s: s.y + s.h / 2.0)
    area = property(lambda s: s.w.cast("long") * s.h)
    perimeter = property(lambda s: 2 * (s.w + s.h))

    def intersection(self, o: Box) -> Column:
        """Area; boxes that touch share none."""
        zero = F.lit(0)
        return F.greatest(zero, F.least(self.xmax, o.xmax) - F.greatest(self.x, o.x)).cast("long") * F.greatest(zero, F.least(self.ymax, o.ymax) - F.greatest(self.y, o.y))

    def iou(self, o: Box) -> Column:
        i = self.intersection(o)
        u = self.area + o.area - i
        return F.when(u == 0, F.lit(0.0)).otherwise(i / u)

    def giou(self, o: Box) -> Column:
        """Overlap less the share of the box around both that neither covers; 0 where that box is empty."""
        hull, i = self.merged(o).area, self.intersection(o)
        union = self.area + o.area - i
        return F.when((hull == 0) | (union == 0), F.lit(0.0)).otherwise(i / union - (hull - union) / hull)

    def diou(self, o: Box) -> Column:
        """Overlap less the squared distance of the centres over the squared diagonal of the box around both."""
        m = self.merged(o)
        diagonal = m.w.cast("double") * m.w + m.h.cast("double") * m.h
        return F.when((diagonal == 0) | (self.area + o.area - self.intersection(o) == 0), F.lit(0.0)).otherwise(self.iou(o) - (F.pow(self.cx - o.cx, 2) + F.pow(self.cy - o.cy, 2)) / diagonal)

    def iof(self, o: Box) -> Column:
        least = F.least(self.area, o.area)
        return F.when(least == 0, F.lit(0.0)).otherwise(self.intersection(o) / least)

    def iou_plus_one(self, o: Box) -> Column:
        """The tracker's pixel-inclusive variant."""
        i = F.greatest(F.lit(0.0), F.least(self.xmax, o.xmax) - F.greatest(self.x, o.x) + 1.0) * F.greatest(F.lit(0.0), F.least(self.ymax, o.ymax) - F.greatest(self.y, o.y) + 1.0)
        return i / ((self.w + 1.0) * (self.h + 1.0) + (o.w + 1.0) * (o.h + 1.0) - i + 1e-5)

    def overlaps(self, o: Box, threshold: float = 0.0) -> Column:
        """The overlap is over the threshold."""
        return self.iou(o) > threshold

    def contains_point(self, px: Column, py: Column) -> Column:
        return (px >= self.x) & (px < self.xmax) & (py >= self.y) & (py < self.ymax)

    def contains(self, o: Box) -> Column:
        return (o.w > 0) & (o.h > 0) & (o.x >= self.x) & (o.y >= self.y) & (o.xmax <= self.xmax) & (o.ymax <= self.ymax)

    def centre_distance(self, o: Box) -> Column:
        return F.sqrt(F.pow(self.cx - o.cx, 2) + F.pow(self.cy - o.cy, 2))

    def edge_distance(self, o: Box) -> Column:
        dx = F.greatest(F.lit(0), self.x - o.xmax, o.x - self.xmax)
        dy = F.greatest(F.lit(0), self.y - o.ymax, o.y - self.ymax)
        return F.sqrt(dx.cast("double") * dx + dy.cast("double") * dy)

    @property
    def empty(self) -> Column:
        return (self.w <= 0) | (self.h <= 0)

    def merged(self, o: Box) -> Box:
        """The box around both."""
        x, y = F.least(self.x, o.x), F.least(self.y, o.y)
        return Box(x, y, F.greatest(self.xmax, o.xmax) - x, F.greatest(self.ymax, o.ymax) - y)

    def joined(self, o: Box) -> Box:
        """merged(), of which an empty box has no part; two empty ones make one at the origin."""
        both, none = self.merged(o), F.lit(0)
        return Box(*(F.when(self.empty & o.empty, none).when(self.empty, theirs).when(o.empty, own).otherwise(m) for own, theirs, m in zip((self.x, self.y, self.w, self.h), (o.x, o.y, o.w, o.h), (both.x, both.y, both.w, both.h), strict=True)))

    def translated(self, dx: Column | int, dy: Column | int) -> Box:
        """Of a part of a picture to the whole: a tile or region begins at (dx, dy)."""
        return Box(self.x + dx, self.y + dy, self.w, self.h)

    def unscaled(self, factor: Column | float) -> Box:
        """Of a smaller working picture to the original: each number over the factor, truncated."""
        return Box(*((c / factor).cast("int") for c in (self.x, self.y, self.w, self.h)))

    def normalised(self, width: int, height: int) -> Box:
        """Shares of the picture."""
        return Box(self.x / float(width), self.y / float(height), self.w / float(width), self.h / float(height))

    def yolo_normalised(self, width: int, height: int) -> tuple[Column, Column, Column, Column]:
        """Centre and size as shares of the picture."""
        return self.cx / float(width), self.cy / float(height), self.w / float(width), self.h / float(height)

    @classmethod
    def _checked(cls, x: Column, y: Column, w: Column, h: Column, ok: Column) -> Box:
        """Null where the arguments don't make a box."""
        good = F.coalesce(ok & (w > 0) & (h > 0), F.lit(False))
        return cls(*(F.when(good, c) for c in (x, y, w, h)))

    @classmethod
    def of_corners(cls, x1: Column, y1: Column, x2: Column, y2: Column) -> Box:
        """Of two opposite corners, in any order."""
        x, y = F.least(x1, x2), F.least(y1, y2)
        return cls._checked(x, y, F.greatest(x1, x2) - x, F.greatest(y1, y2) - y, F.lit(True))

    @classmethod
    def of_rect(cls, x: Column, y: Column, w: Column, h: Column) -> Box:
        return cls._checked(x, y, w, h, F.lit(True))

    @classmethod
    def of_yolo(cls, cx: Column, cy: Column, w: Column, h: Column) -> Box:
        """Of a centre and size in pixels; half a side is a whole number."""
        half = lambda c: F.floor(c / 2).cast("int")
        return cls._checked(cx - half(w), cy - half(h), w, h, F.lit(True))

    @classmethod
    def of_normalised(cls, x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Box:
        """Of shares of the picture, rounded away from zero; null where one isn't finite."""
        ok = _finite(x, y, w, h) & (w > 0) & (h > 0)
        px, py, pw, ph = (F.when(ok, F.round(c * n)).cast("int") for c, n in ((x, width), (y, height), (w, width), (h, height)))
        return cls._checked(px, py, pw, ph, ok)

    @classmethod
    def of_yolo_normalised(cls, cx: Column, cy: Column, w: Column, h: Column, width: int, height: int) -> Box:
        """Of a centre and size as shares of the picture."""
        ok = _finite(cx, cy, w, h) & (w > 0) & (h > 0)
        px, py, pw, ph = (F.when(ok, F.round(c * n)).cast("int") for c, n in ((cx, width), (cy, height), (w, width), (h, height)))
        b = cls.of_yolo(px, py, pw, ph)
        return cls(b.x, b.y, b.w, b.h)

    def clipped(self, width: int, height: int) -> Box:
        """Null where nothing is left."""
        x, y = F.greatest(self.x, F.lit(0)), F.greatest(self.y, F.lit(0))
        w, h = F.least(self.xmax, F.lit(width)) - x, F.least(self.ymax, F.lit(height)) - y
        ok = (w > 0) & (h > 0)
        return Box(*(F.when(ok, c) for c in (x, y, w, h)))

    def clip_or_raise(self, width: int, height: int) -> Box:
        """clipped(); the query fails where nothing is left."""
        return Box(*(F.coalesce(c, F.raise_error(F.lit("nothing of the box is left")).cast("int")) for c in (lambda b: (b.x, b.y, b.w, b.h))(self.clipped(width, height))))

    def snapshot(self, width: int, height: int, expansion: float = 1.0) -> Box:
        """The crop of a box scaled about its centre: an origin beyond the picture moves to its edge with the size kept, then the far sides are cut.
        Null where nothing is left."""
        b = self.scaled(expansion) if expansion != 1.0 else self
        x, y = F.greatest(F.lit(0), b.x), F.greatest(F.lit(0), b.y)
        w, h = F.least(b.w, F.lit(width) - x), F.least(b.h, F.lit(height) - y)
        return Box._checked(x, y, w, h, F.lit(True))

    def scaled(self, factor: float) -> Box:
        """About the centre; sides rounded away from zero, 1 at least; the origin truncated."""
        w, h = F.greatest(F.lit(1), F.round(self.w * factor).cast("int")), F.greatest(F.lit(1), F.round(self.h * factor).cast("int"))
        return Box((self.cx - w / 2.0).cast("int"), (self.cy - h / 2.0).cast("int"), w, h)

    def padded(self, ratio: float, width: int, height: int) -> Box:
        """A crop with a margin, clamped on all sides."""
        px, py = F.bround(self.w * ratio).cast("int"), F.bround(self.h * ratio).cast("int")
        x, y = F.greatest(F.lit(0), self.x - px), F.greatest(F.lit(0), self.y - py)
        return Box(x, y, F.least(F.lit(width), self.xmax + px) - x, F.least(F.lit(height), self.ymax + py) - y)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.w.alias("w"), self.h.alias("h"))


def in_known_polygon(px: Column, py: Column, points: list[tuple[float, float]]) -> Column:
    """in_polygon() of a polygon known when the plan is made: its edges are literals, all of it is compiled, and most points outside
    are told by the box around it alone."""
    points = [(float(x), float(y)) for x, y in points]
    xs, ys = zip(*points, strict=True)
    border, odd = F.lit(False), F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        on = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) == 0
        border = border | (on & px.between(min(x1, x2), max(x1, x2)) & py.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            odd = odd != ((py < y1) != (py < y2)) & (px < (x2 - x1) * (py - y1) / F.lit(y2 - y1) + x1)
    return px.between(min(xs), max(xs)) & py.between(min(ys), max(ys)) & (border | odd)


def in_polygon(px: Column, py: Column, points: Column) -> Column:
    """Even-odd rule; a point on the border is inside. points: array of (x, y)."""
    n = F.size(points)
    edges = F.transform(points, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(points, (i + 1) % n)["x"].alias("x2"), F.get(points, (i + 1) % n)["y"].alias("y2")))
    cross = lambda e: (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
    border = F.exists(edges, lambda e: (cross(e) == 0) & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
    crossed = F.filter(edges, lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return border | (F.size(crossed) % 2 == 1)


def crosses(ax: Column, ay: Column, bx: Column, by: Column, line: tuple) -> Column:
    """The step from a to b meets the line (numbers or columns); parallel steps never do. Where the line's start lies on the straight line of the
    step, it counts if the step passes that point's x or y."""
    x1, y1, x2, y2 = (v if isinstance(v, Column) else F.lit(float(v)) for v in line)
    side = lambda px, py: (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    own = lambda px, py: (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    parallel = (x2 - x1) * (by - ay) - (y2 - y1) * (bx - ax) == 0
    passes = ((x1 < ax) != (x1 < bx)) | ((y1 < ay) != (y1 < by))
    return F.when(own(x1, y1) == 0, passes).otherwise(~parallel & (side(ax, ay) * side(bx, by) <= 0) & (own(x1, y1) * own(x2, y2) <= 0))


def heading(a: Box, b: Box) -> tuple[Column, Column]:
    """The direction from b's centre to a's, of length one; zero where they are the same."""
    dx, dy = a.cx - b.cx, a.cy - b.cy
    n = F.sqrt(dx * dx + dy * dy)
    return F.when(n == 0, F.lit(0.0)).otherwise(dx / n), F.when(n == 0, F.lit(0.0)).otherwise(dy / n)


def evidence_quality(confidence: Column, box: Box, width: int, height: int) -> Column:
    """0.60 of confidence, 0.25 of the area's share, 0.15 of nearness to the centre, each within 0..1."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    off = F.sqrt(F.pow(box.cx - width / 2, 2) + F.pow(box.cy - height / 2, 2)) / ((width / 2) ** 2 + (height / 2) ** 2) ** 0.5
    return 0.60 * clamp(confidence) + 0.25 * clamp(box.area / float(width * height)) + 0.15 * clamp(1 - off)

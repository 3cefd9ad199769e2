"""Rules over the boxes of one frame in which order matters: merging of boxes, and stitching over the seams of tiles.

Each rule is a fold over the small array of a frame's boxes, on the JVM; plain versions over lists stand beside them for use outside Spark and
for tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.geometry import Box

Rect = tuple[int, int, int, int]  # x, y, w, h


def iou(a: Rect, b: Rect) -> float:
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = w * h if w > 0 and h > 0 else 0
    total = a[2] * a[3] + b[2] * b[3] - both
    return both / total if total else 0.0


def around(*boxes: Rect) -> Rect:
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    return x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y


def merge_first(boxes: list[Rect], threshold: float) -> list[Rect]:
    """One pass: a box joins the first merged box that it overlaps by threshold or more."""
    out: list[Rect] = []
    for b in boxes:
        at = next((i for i, m in enumerate(out) if iou(m, b) >= threshold), None)
        if at is None:
            out.append(b)
        else:
            out[at] = around(out[at], b)
    return out


def merge_forward(boxes: list[Rect], threshold: float) -> list[Rect]:
    """Each box left takes in, in order, the later ones that overlap what it has grown to by more than threshold."""
    left, out = list(boxes), []
    while left:
        grown, rest = left[0], []
        for b in left[1:]:
            if iou(grown, b) > threshold:
                grown = around(grown, b)
            else:
                rest.append(b)
        out.append(grown)
        left = rest
    return out


def merge_largest(boxes: list[Rect], threshold: float) -> list[Rect]:
    """merge_forward from the largest box down; of equal areas the earlier one first."""
    return merge_forward(sorted(boxes, key=lambda b: -b[2] * b[3]), threshold)


def merge_all(boxes: list[Rect], threshold: float) -> list[Rect]:
    """merge_forward until nothing merges any more."""
    while len(merged := merge_forward(boxes, threshold)) < len(boxes):
        boxes = merged
    return merged


MERGES = {"first": merge_first, "forward": merge_forward, "largest": merge_largest, "all": merge_all}


def _box(r: Column) -> Box:
    return Box(r["x"], r["y"], r["w"], r["h"])


def _around(a: Column, b: Column) -> Column:
    return _box(a).merged(_box(b)).struct()


def _rest(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def _apart(boxes: Column, meets) -> Column:
    """No two boxes meet: then none is merged, and the fold isn't needed."""
    return ~F.exists(F.transform(boxes, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda p: F.exists(F.slice(boxes, p["i"] + 2, F.size(boxes)), lambda q: meets(_box(p["b"]).iou(_box(q)))))


def first_merged(boxes: Column, threshold: float) -> Column:
    """merge_first() of an array of boxes."""

    def step(out: Column, b: Column) -> Column:
        hits = F.transform(out, lambda m: _box(m).iou(_box(b)) >= threshold)
        at = F.array_position(hits, True) - 1
        return F.when(at < 0, F.concat(out, F.array(b))).otherwise(F.transform(out, lambda m, i: F.when(i == at, _around(m, b)).otherwise(m)))

    return F.when(F.size(boxes) < 2, boxes).when(_apart(boxes, lambda iou: iou >= threshold), boxes).otherwise(F.aggregate(boxes, F.slice(boxes, 1, 0), step))


def forward_merged(boxes: Column, threshold: float) -> Column:
    """merge_forward() of an array of boxes: as many rounds as there are boxes, the last ones with nothing left."""

    def grow(acc: Column, b: Column) -> Column:
        meets = _box(acc["grown"]).iou(_box(b)) > threshold
        return F.struct(F.when(meets, _around(acc["grown"], b)).otherwise(acc["grown"]).alias("grown"), F.when(meets, acc["rest"]).otherwise(F.concat(acc["rest"], F.array(b))).alias("rest"))

    def round_(state: Column, _: Column) -> Column:
        left = state["left"]
        grown = F.aggregate(_rest(left), F.struct(F.get(left, F.lit(0)).alias("grown"), F.slice(left, 1, 0).alias("rest")), grow)
        new = F.aggregate(F.array(grown), F.struct(left.alias("left"), state["out"].alias("out")), lambda _, g: F.struct(g["rest"].alias("left"), F.concat(state["out"], F.array(g["grown"])).alias("out")))
        return F.when(F.size(left) == 0, state).otherwise(new)

    start = F.struct(boxes.alias("left"), F.slice(boxes, 1, 0).alias("out"))
    return F.when(F.size(boxes) < 2, boxes).when(_apart(boxes, lambda iou: iou > threshold), boxes).otherwise(F.aggregate(boxes, start, round_, lambda s: s["out"]))


def largest_merged(boxes: Column, threshold: float) -> Column:
    by_area = F.transform(F.array_sort(F.transform(boxes, lambda b, i: F.struct((-_box(b).area).alias("a"), i.alias("i"), b.alias("b")))), lambda x: x["b"])
    return F.get(F.transform(F.array(by_area), lambda b: forward_merged(b, threshold)), F.lit(0))  # sorted once


def all_merged(boxes: Column, threshold: float) -> Column:
    """merge_all(): a round that merges nothing changes nothing (and costs no fold), so rounds go on as long as there are boxes."""
    return F.when(F.size(boxes) < 2, boxes).when(_apart(boxes, lambda iou: iou > threshold), boxes).otherwise(F.aggregate(F.slice(F.transform(boxes, lambda _, i: i), 2, F.size(boxes)), boxes, lambda now, _: F.transform(F.array(now), lambda b: forward_merged(b, threshold))[0]))


#: The rules by name, over columns.
MERGED = {"first": first_merged, "forward": forward_merged, "largest": largest_merged, "all": all_merged}


def merged(rows: DataFrame, variant: str, threshold: float) -> DataFrame:
    """source_id, frame_id, x, y, w, h of the merged boxes of each frame, by one of MERGED; boxes come from left to right, then down."""
    g = rows.dropna(subset=["source_id", "frame_id"]).groupBy("source_id", "frame_id").agg(F.sort_array(F.collect_list(F.struct("x", "y", "w", "h"))).alias("b"))
    return g.select("source_id", "frame_id", F.explode(MERGED[variant](F.col("b"), threshold)).alias("m")).select("source_id", "frame_id", "m.*")


def tile_seams(size: int, tiles: int) -> list[int]:
    """Where the tiles of an image side meet; the last tile takes the remainder."""
    return [size // tiles * i for i in range(1, tiles)]


def tiles(width: Column, height: Column, columns: int, rows: int) -> Column:
    """The tiles of a picture, row by row: an array of column_no, row_no, x, y, w, h; the last of a row or column takes the remainder."""
    w, h = F.floor(width / columns).cast("int"), F.floor(height / rows).cast("int")

    def tile(n: Column) -> Column:
        c, r = (n % columns).cast("int"), F.floor(n / columns).cast("int")
        return F.struct(c.alias("column_no"), r.alias("row_no"), (c * w).alias("x"), (r * h).alias("y"), F.when(c == columns - 1, width - c * w).otherwise(w).alias("w"), F.when(r == rows - 1, height - r * h).otherwise(h).alias("h"))

    return F.transform(F.sequence(F.lit(0), F.lit(columns * rows - 1)), tile)


def modal_size(sizes: list[int]) -> int:
    """The most frequent one; of equally frequent ones the first."""
    return max(dict.fromkeys(sizes), key=lambda s: sizes.count(s))


def shares_seam(a: Rect, b: Rect, seams: tuple[list[int], list[int]], gap: int, overlap: float) -> bool:
    """The boxes lie on opposite sides of a seam, at most gap apart, and have at least overlap of the shorter one in common along it."""
    for axis, other in ((0, 1), (1, 0)):
        common = max(0, min(a[other] + a[other + 2], b[other] + b[other + 2]) - max(a[other], b[other]))
        shorter = min(a[other + 2], b[other + 2])
        if shorter <= 0 or common / shorter < overlap:
            continue
        for one, two in ((a, b), (b, a)):
            if any(one[axis] + one[axis + 2] <= s <= two[axis] for s in seams[axis]) and two[axis] - one[axis] - one[axis + 2] <= gap:
                return True
    return False


def stitch_groups(boxes: list[Rect], labels: list[str], seams: tuple[list[int], list[int]], gap: int, overlap: float) -> list[int]:
    """The group of each box: its least member. Boxes of one label that meet at a seam belong together, also by way of others."""
    group = list(range(len(boxes)))
    for i in range(len(boxes)):
        for j in range(i):
            if labels[i] == labels[j] and shares_seam(boxes[i], boxes[j], seams, gap, overlap):
                least, most = sorted((group[i], group[j]))
                group = [least if g == most else g for g in group]
    return group


def _share_seam(a: Box, b: Box, seams: tuple[list[int], list[int]], gap: int, overlap: float) -> Column:
    """shares_seam() over columns."""
    found = F.lit(False)
    for lines, (begin, end, low, high, size) in zip(seams, (("x", "xmax", "y", "ymax", "h"), ("y", "ymax", "x", "xmax", "w")), strict=True):
        of = lambda box, name: getattr(box, name)
        shorter = F.least(of(a, size), of(b, size))
        common = F.greatest(F.lit(0), F.least(of(a, high), of(b, high)) - F.greatest(of(a, low), of(b, low))) / F.nullif(shorter, F.lit(0))
        for one, two in ((a, b), (b, a)):
            apart = F.lit(False)
            for s in lines:
                apart = apart | ((of(one, end) <= s) & (of(two, begin) >= s))
            found = found | (apart & (of(two, begin) - of(one, end) <= gap) & (common >= overlap))
    return F.coalesce(found, F.lit(False))


def stitched(dets: DataFrame, width: int, height: int, columns: int, rows: int, gap: int = 2, overlap: float = 0.9, confidence: str = "max", keep_track: bool = True, same_label: bool = True) -> DataFrame:
    """Detections whose boxes meet at the seams of a tile grid become one: the label of most of them (then of most area), the box around those of
    that label, the highest (or with "mean" the mean) confidence, the least track other than 0 (0 if there is none, or tracks aren't
    kept), and how many parts it has. A frame's boxes are labelled with the least of those they meet until nothing changes."""
    seams = tile_seams(width, columns), tile_seams(height, rows)
    names = ["x", "y", "w", "h", "label", "tracking_id", "confidence"]
    g = dets.dropna(subset=["source_id", "frame_id"]).groupBy("source_id", "frame_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("b"))
    meets = lambda p, q: _share_seam(_box(p), _box(q), seams, gap, overlap) & ((p["label"] == q["label"]) if same_label else F.lit(True))
    places = F.transform("b", lambda _, i: i)
    near = F.transform("b", lambda p, i: F.filter(places, lambda j: (j == i) | meets(p, F.get("b", j))))
    g = g.withColumn("near", F.when(F.size("b") == 1, F.array(F.array(F.lit(0)))).otherwise(near))
    group = F.aggregate(places, places, lambda now, _: F.transform("near", lambda js: F.array_min(F.transform(js, lambda j: F.get(now, j)))))
    g = g.withColumn("group", F.when(F.exists("near", lambda js: F.size(js) > 1), group).otherwise(places))
    members = F.transform(F.array_distinct("group"), lambda k: F.filter("b", lambda _, i: F.get("group", i) == k))
    m = g.select("source_id", "frame_id", F.explode(members).alias("m"))
    area = lambda rs: F.aggregate(rs, F.lit(0).cast("long"), lambda s, r: s + _box(r).area)
    of = lambda label: F.filter("m", lambda r: r["label"].eqNullSafe(label))
    ranked = F.transform(F.array_distinct(F.transform("m", lambda r: r["label"])), lambda label: F.struct((-F.size(of(label))).alias("n"), (-area(of(label))).alias("a"), label.alias("label")))
    m = m.withColumn("label", F.array_min(ranked)["label"]).withColumn("own", F.filter("m", lambda r: r["label"].eqNullSafe(F.col("label"))))
    hull = F.aggregate("own", F.get("own", F.lit(0)), lambda a, r: F.struct(_box(a).merged(_box(r)).x.alias("x"), _box(a).merged(_box(r)).y.alias("y"), _box(a).merged(_box(r)).w.alias("w"), _box(a).merged(_box(r)).h.alias("h"), a["label"].alias("label"), a["tracking_id"].alias("tracking_id"), a["confidence"].alias("confidence")))
    scores = F.transform("m", lambda r: r["confidence"])
    sure = F.array_max(scores) if confidence == "max" else F.aggregate(scores, F.lit(0.0), lambda s, c: s + c) / F.size("m")
    track = F.coalesce(F.array_min(F.filter(F.transform("m", lambda r: r["tracking_id"]), lambda t: t > 0)), F.lit(0)) if keep_track else F.lit(0)
    m = m.withColumn("hull", hull)
    return m.select("source_id", "frame_id", "label", track.alias("tracking_id"), sure.alias("confidence"), "hull.x", "hull.y", "hull.w", "hull.h", F.size("m").alias("parts"))

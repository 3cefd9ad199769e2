"""Annotation shapes as structs of one type, styles, and the order in which shapes are drawn; property bags as maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.geometry import Box

#: The fields of a style.
STYLE = "stroke_color string, fill_color string, stroke_width int, opacity double, dash array<int>, z_index int, visible boolean, color string, font_size int, font_family string, font_weight string, background_color string"
POINTS = "array<struct<x:int,y:int>>"


def style(**fields) -> Column:
    """A style of the fields given; the others are null."""
    return F.struct(*[F.lit(fields.get(name)).cast(kind).alias(name) for name, kind in (f.split() for f in STYLE.split(", "))])


def merged_style(user: Column, default: Column) -> Column:
    """Field by field, the user's value or else the default."""
    return F.struct(*[F.coalesce(user[n], default[n]).alias(n) for n in (f.split()[0] for f in STYLE.split(", "))])


def _shape(id: Column, kind: str, look: Column, z: Column | None = None, box: Box | None = None, points: Column | None = None, radius: Column | None = None, text: Column | None = None) -> Column:
    null = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    x, y, w, h = (box.x, box.y, box.w, box.h) if box else (None,) * 4
    return F.struct(id.alias("id"), F.lit(kind).alias("type"), null(z, "int").alias("z"), null(x, "int").alias("x"), null(y, "int").alias("y"), null(w, "int").alias("w"), null(h, "int").alias("h"), null(points, POINTS).alias("points"), null(radius, "int").alias("radius"), null(text, "string").alias("text"), look.alias("style"))


def box_shape(object_id: Column, box: Box, colour: str = "#8fce00", width: int = 1, z: Column | None = None) -> Column:
    return _shape(F.concat(F.lit("bbox_"), object_id), "rect", style(stroke_color=colour, stroke_width=width), z, box)


def object_text(label: Column | None, track: Column | None, confidence: Column | None) -> Column:
    """The parts asked for, joined by _, without _ at the end; the confidence as a float, so that its own digits are rounded."""
    parts = [c for c in (label, track.cast("string") if track is not None else None, F.format_string("%.2f", confidence.cast("float").cast("double")) if confidence is not None else None) if c is not None]
    return F.rtrim(F.concat_ws("_", *parts), F.lit("_")) if parts else F.lit("")


def text_shape(object_id: Column, box: Box, text: Column, colour: str = "#ffff00", size: int = 20, z: Column | None = None) -> Column:
    """Text that stands above the box."""
    return _shape(F.concat(F.lit("text_"), object_id), "text", style(color=colour, font_size=size), z, Box(box.x, box.y - size, F.lit(None), F.lit(None)), text=text)


def circle_shape(id: Column, x: Column, y: Column, radius: int, look: Column, z: Column | None = None) -> Column:
    return _shape(id, "circle", look, z, Box(F.bround(x), F.bround(y), F.lit(None), F.lit(None)), radius=F.lit(radius))


def area_shapes(areas: Column, name: str, look: Column, first: int = 1) -> Column:
    """A polygon name_n for each array of points, numbered from first."""
    return F.transform(areas, lambda p, i: _shape(F.concat(F.lit(name + "_"), (i + first).cast("string")), "polygon", look, points=p))


def line_shapes(pairs: Column, name: str, look: Column) -> Column:
    """Of each pair of lines two polylines: name_1 and name_2, name_3 and name_4, and so on."""
    lines = F.flatten(F.transform(pairs, lambda p: F.array(p["one"], p["other"])))
    return F.transform(lines, lambda p, i: _shape(F.concat(F.lit(name + "_"), (i + 1).cast("string")), "polyline", look, points=p))


def drawn(shapes: Column) -> Column:
    """Visible shapes by their own z, else their style's (none: 0); of equal ones in the order they were added. Each shape is sorted along with its place, so that the array is worked out once."""
    seen = F.filter(shapes, lambda s: F.coalesce(s["style"]["visible"], F.lit(True)))
    keyed = F.transform(seen, lambda s, i: F.struct(F.coalesce(s["z"], s["style"]["z_index"], F.lit(0)).alias("z"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def bag_set(bag: Column, name: str, value: Column) -> Column:
    """The property bag (a map) with the property set, whether or not it was there."""
    return F.map_concat(F.map_filter(bag, lambda k, _: k != name), F.create_map(F.lit(name), value))


def bag_get(bag: Column, name: str, default: Column | None = None) -> Column:
    got = F.try_element_at(bag, F.lit(name))
    return got if default is None else F.coalesce(got, default)


def bag_require(bag: Column, name: str) -> Column:
    """The property; the query fails where it is missing."""
    return F.when(F.map_contains_key(bag, name), F.try_element_at(bag, F.lit(name))).otherwise(F.raise_error(F.lit(f"no property {name}")))


def bag_remove(bag: Column, name: str) -> Column:
    return F.map_filter(bag, lambda k, _: k != name)


def top_labels(scores: Column, threshold: float = 0.5) -> Column:
    """Labels whose score is over the threshold, else the one of the highest score (the first of equal ones). scores: array of (label, score)."""
    over = F.filter(scores, lambda s: s["score"] > threshold)
    best = F.filter(scores, lambda s: s["score"] == F.array_max(F.transform(scores, lambda x: x["score"])))
    return F.transform(F.when(F.size(over) > 0, over).otherwise(F.slice(best, 1, 1)), lambda s: s["label"])


def best_allowed(scores: Column, allowed: Column) -> Column:
    """The label of the highest score among those allowed; null if none is."""
    return F.get(F.transform(F.array_sort(F.transform(F.filter(scores, lambda s: F.array_contains(allowed, s["label"])), lambda s, i: F.struct((-s["score"]).alias("s"), i.alias("i"), s["label"].alias("label")))), lambda s: s["label"]), F.lit(0))

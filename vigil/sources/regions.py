"""Region definitions as a dimension: one row per source, joined on source_id; and what detections get from it.

A definition is a JSON file: analysis and excluded areas, lanes, interest areas, pairs of count lines, in points from 0 to 1. It is read by
the driver, as configuration is; a file that is missing or broken gives way to the default file. Points become pixels, rounded half to even.
The driver holds the rows, so it knows their size: up to LOCAL bytes they are a local relation, beyond a Parquet table; Spark knows the size of both, sends a small one to all tasks, and so
doesn't shuffle detections by source.

A source of many polygons has them laid out on a grid (cells): a detection meets the polygons of its cell alone, by an equi join on source and cell; those that hold the whole cell aren't tested.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vigil.functions.geometry import Box
from vigil.operators import windows
from vigil.sources.shared import stored

EDGES = "array<struct<ax:double,ay:double,bx:double,by:double>>"
SHAPE = f"x0:double,y0:double,x1:double,y1:double,inner:struct<x0:double,y0:double,x1:double,y1:double>,edges:{EDGES}"
AREA = f"array<struct<name:string,{SHAPE}>>"
LINE = "struct<ax:double,ay:double,bx:double,by:double>"
DIMENSION = (
    f"source_id string, name string, retain boolean, double_line boolean, analysis {AREA}, excluded {AREA}, "
    f"lanes array<struct<name:string,index:int,type:string,forbidden:array<string>,{SHAPE}>>, "
    f"interest array<struct<name:string,type:string,relative_types:array<string>,{SHAPE}>>, lines array<struct<enter:{LINE},leave:{LINE}>>"
)


#: Bytes of a dimension that may be sent with the plan.
LOCAL = 4 << 20
#: Pixels of a side of a cell, and polygons of a source from which they are laid out on the grid.
CELL, MANY = 64, 32
KINDS = ("analysis", "excluded", "lanes", "interest")


class RegionError(ValueError):
    pass


def _pixel(point: Mapping[str, float], width: int, height: int) -> tuple[float, float]:
    x, y = float(point["NormalizedX"]), float(point["NormalizedY"])
    if not (math.isfinite(x) and math.isfinite(y)):
        raise RegionError("a point isn't finite")
    return float(round(x * width)), float(round(y * height))


def inner(at: list[tuple[float, float]], most: int = 6) -> dict[str, float] | None:
    """The largest box between a polygon's own columns and rows (so many of them) that lies wholly in the polygon, border included: no edge runs through it, and its centre is inside. None if there is none."""
    edges = list(zip(at, at[1:] + at[:1], strict=True))
    some = lambda v: [v[i * (len(v) - 1) // (most - 1)] for i in range(most)] if len(v) > most else v
    xs, ys = (some(sorted(set(v))) for v in zip(*at, strict=True))

    def free(l: float, t: float, r: float, b: float) -> bool:
        for (ax, ay), (bx, by) in edges:
            sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (l, r) for y in (t, b)]
            if min(ax, bx) < r and max(ax, bx) > l and min(ay, by) < b and max(ay, by) > t and min(sides) < 0 < max(sides):
                return False
        x, y = (l + r) / 2, (t + b) / 2
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in edges) % 2 == 1

    boxes = sorted(((r - l) * (b - t), l, t, r, b) for i, l in enumerate(xs) for r in xs[i + 1 :] for j, t in enumerate(ys) for b in ys[j + 1 :])
    best = next((box for _, *box in reversed(boxes) if free(*box)), None)
    return dict(zip(("x0", "y0", "x1", "y1"), best, strict=True)) if best else None


def polygon(points: list[Mapping[str, float]], width: int, height: int, boxed: bool = True) -> dict[str, Any]:
    """The box around a polygon, a box within it (if boxed), and its edges."""
    at = [_pixel(p, width, height) for p in points]
    if len(at) < 3:
        raise RegionError("a polygon has three points or more")
    xs, ys = zip(*at, strict=True)
    return {"x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "inner": inner(at) if boxed and len(at) <= 64 else None, "edges": [{"ax": a[0], "ay": a[1], "bx": b[0], "by": b[1]} for a, b in zip(at, at[1:] + at[:1], strict=True)]}


def definition(document: Mapping[str, Any], width: int, height: int) -> dict[str, Any]:
    """A row of the dimension, but for its source."""
    boxed = sum(len(document.get(k) or []) for k in ("AnalysisAreas", "ExcludedAreas", "Lanes", "InterestAreas")) <= MANY  # beyond that the grid tells
    area = lambda a: {"name": a.get("Name"), **polygon(a["Points"], width, height, boxed)}
    line = lambda s: dict(zip(("ax", "ay", "bx", "by"), (*_pixel(s["Start"], width, height), *_pixel(s["Stop"], width, height)), strict=True))
    return {
        "name": document.get("Name"),
        "retain": bool(document.get("IsObjectAnalyzableRetain", False)),
        "double_line": bool(document.get("IsDoubleLineCounting", False)),
        "analysis": [area(a) for a in document.get("AnalysisAreas") or []],
        "excluded": [area(a) for a in document.get("ExcludedAreas") or []],
        "lanes": [{**area(a), "index": a.get("Index", 0), "type": a.get("Type", ""), "forbidden": list(a.get("ForbiddenTypes") or [])} for a in document.get("Lanes") or []],
        "interest": [{**area(a), "type": a.get("Type", ""), "relative_types": list(a.get("RelativeTypes") or [])} for a in document.get("InterestAreas") or []],
        "lines": [{"enter": line(c["Item1"]), "leave": line(c["Item2"])} for c in document.get("CountLines") or []],
    }


def load(path: str | Path, width: int, height: int, default: str | Path | None = None) -> dict[str, Any]:
    """The definition of a file, else that of the default file, else one without any area."""
    for place in (path, default):
        if place is None:
            continue
        try:
            return definition(json.loads(Path(place).read_text(encoding="utf-8-sig")), width, height)
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            continue
    return definition({}, width, height)


def rows_of(files: Mapping[str, str | Path], width: int, height: int, default: str | Path | None = None) -> list[dict[str, Any]]:
    return [{"source_id": source, **load(path, width, height, default)} for source, path in files.items()]


def dimension(spark: SparkSession, rows: list[dict[str, Any]], local: int = LOCAL) -> DataFrame:
    held = pa.Table.from_pylist(rows, to_arrow_schema(StructType.fromDDL(DIMENSION)))
    df = spark.createDataFrame(held, StructType.fromDDL(DIMENSION))
    return df if held.nbytes <= local else stored(df, "regions")


def many(rows: list[dict[str, Any]]) -> bool:
    """Has any source so many polygons that they are better laid out on the grid?"""
    return any(sum(len(r[k]) for k in KINDS) > MANY for r in rows)


def within(px: Column, py: Column, shape: Column) -> Column:
    """Even-odd rule; a point on the border is inside. Most points outside are told by the box around the polygon."""
    e = shape["edges"]
    on = lambda s: ((s["bx"] - s["ax"]) * (py - s["ay"]) == (s["by"] - s["ay"]) * (px - s["ax"])) & px.between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"])) & py.between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"]))
    crossed = lambda s: ((s["ay"] > py) != (s["by"] > py)) & (px < (s["bx"] - s["ax"]) * (py - s["ay"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0)) + s["ax"])
    return px.between(shape["x0"], shape["x1"]) & py.between(shape["y0"], shape["y1"]) & ((F.size(F.filter(e, crossed)) % 2 == 1) | F.exists(e, on))


def within_shape(px: Column, py: Column, shape: Column) -> Column:
    """within(), of a shape of the dimension: most points inside are told by the box in the polygon, and need none of its edges."""
    box = shape["inner"]
    sure = px.between(box["x0"], box["x1"]) & py.between(box["y0"], box["y1"])
    return F.coalesce(sure, F.lit(False)) | within(px, py, shape)


def placed(rows: DataFrame, regions: DataFrame, missing: str = "error") -> DataFrame:
    """rows with `region`, the definition of their source. A source without one raises, or with missing="drop" its rows go."""
    dim = regions.select("source_id", F.struct(*[c for c in regions.columns if c != "source_id"]).alias("region"))
    if missing == "drop":
        return rows.join(dim, "source_id")
    df = rows.join(dim, "source_id", "left")
    return df.withColumn("region", F.coalesce("region", F.raise_error(F.concat(F.lit("no region definition of source "), F.coalesce("source_id", F.lit("null")))).cast(df.schema["region"].dataType)))


def centre(box: Box) -> tuple[Column, Column]:
    """The pixel of a box's centre, truncated."""
    return box.cx.cast("int").cast("double"), box.cy.cast("int").cast("double")


def tagged(dets: DataFrame, regions: DataFrame, missing: str = "error") -> DataFrame:
    """Adds under_analysis (the centre is in an analysis area and in no excluded one), lane (of those under analysis: the last lane that holds the
    centre) and areas (names of the interest areas that hold it)."""
    px, py = centre(Box.of())
    df = placed(dets, regions, missing).withColumns({"__x": px, "__y": py})
    inside = lambda shape: within_shape(F.col("__x"), F.col("__y"), shape)
    df = df.withColumn("under_analysis", F.exists("region.analysis", inside) & ~F.exists("region.excluded", inside))
    lane = F.try_element_at(F.filter("region.lanes", inside), F.lit(-1))["index"]
    areas = F.transform(F.filter("region.interest", inside), lambda a: a["name"])
    return df.withColumns({"lane": F.when(F.col("under_analysis"), lane), "areas": areas, "retain": F.col("region.retain")}).drop("__x", "__y", "region")


def cells(regions: DataFrame, size: int = CELL) -> DataFrame:
    """source_id, cx, cy and shapes: the polygons of each cell of the grid, with those edges alone that a test in the cell needs; whole: the polygon holds all of the cell. Cells
    outside all polygons have no row."""
    shape = lambda kind: F.transform(kind, lambda a, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), a["name"].alias("name"), (a["index"] if kind == "lanes" else F.lit(None).cast("int")).alias("index"), *[a[c].alias(c) for c in ("x0", "y0", "x1", "y1", "edges")]))
    each = regions.select("source_id", F.explode(F.concat(*map(shape, KINDS))).alias("s"))
    steps = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    at = each.select("source_id", "s", steps("s.x0", "s.x1").alias("cx")).select("source_id", "s", "cx", steps("s.y0", "s.y1").alias("cy"))
    at = at.withColumns({"l": (F.col("cx") * size).cast("double"), "t": (F.col("cy") * size).cast("double")}).withColumns({"r": F.col("l") + size, "b": F.col("t") + size})

    def touches(e: Column) -> Column:
        """Does the edge meet the closed cell: their boxes do, and the cell's corners don't lie all on one side of the edge."""
        side = lambda x, y: F.signum((e["bx"] - e["ax"]) * (F.col(y) - e["ay"]) - (e["by"] - e["ay"]) * (F.col(x) - e["ax"]))
        corners = side("l", "t") + side("r", "t") + side("l", "b") + side("r", "b")
        boxes = (F.least(e["ax"], e["bx"]) <= F.col("r")) & (F.greatest(e["ax"], e["bx"]) >= F.col("l")) & (F.least(e["ay"], e["by"]) <= F.col("b")) & (F.greatest(e["ay"], e["by"]) >= F.col("t"))
        return boxes & (F.abs(corners) < 4)

    at = at.withColumn("whole", ~F.exists("s.edges", touches))
    at = at.filter(~F.col("whole") | within(F.col("l"), F.col("t"), F.col("s")))
    level = F.filter("s.edges", lambda e: (F.least(e["ay"], e["by"]) <= F.col("b")) & (F.greatest(e["ay"], e["by"]) >= F.col("t")))
    edges = F.when(F.col("whole"), F.array().cast(EDGES)).otherwise(level)
    kept = F.struct(*[F.col(f"s.{c}").alias(c) for c in ("kind", "place", "name", "index", "x0", "y0", "x1", "y1")], edges.alias("edges"), F.col("whole").alias("whole"))
    return at.groupBy("source_id", "cx", "cy").agg(F.collect_list(kept).alias("shapes"))


def tagged_by_cells(dets: DataFrame, regions: DataFrame, missing: str = "error", size: int = CELL) -> DataFrame:
    """tagged(), by the grid."""
    px, py = centre(Box.of())
    df = placed(dets, regions.select("source_id", "retain"), missing).withColumn("retain", F.col("region.retain")).drop("region")
    df = df.withColumns({"__x": px, "__y": py}).withColumns({"__cx": F.floor(F.col("__x") / size), "__cy": F.floor(F.col("__y") / size)})
    grid = cells(regions, size).select(F.col("source_id").alias("__s"), F.col("cx").alias("__gx"), F.col("cy").alias("__gy"), "shapes")
    df = df.join(grid, (F.col("source_id") == F.col("__s")) & (F.col("__cx") == F.col("__gx")) & (F.col("__cy") == F.col("__gy")), "left")
    held = F.filter(F.coalesce("shapes", F.array().cast(df.schema["shapes"].dataType)), lambda s: s["whole"] | within(F.col("__x"), F.col("__y"), s))
    df = df.withColumn("__held", held)
    of = lambda kind: F.filter("__held", lambda s: s["kind"] == kind)
    df = df.withColumn("under_analysis", (F.size(of("analysis")) > 0) & (F.size(of("excluded")) == 0))
    lane = F.array_max(F.transform(of("lanes"), lambda s: F.struct(s["place"].alias("p"), s["index"].alias("i"))))["i"]
    areas = F.transform(F.array_sort(F.transform(of("interest"), lambda s: F.struct(s["place"].alias("p"), s["name"].alias("n")))), lambda s: s["n"])
    df = df.withColumns({"lane": F.when(F.col("under_analysis"), lane), "areas": areas})
    return df.select(*dets.columns, "under_analysis", "lane", "areas", "retain")


def in_area(name: str) -> Column:
    """Of tagged(): the centre lies in the interest area of that name; false where the source has none."""
    return F.array_contains("areas", name)


def geometry(rows: DataFrame, regions: DataFrame, area: str, missing: str = "error") -> DataFrame:
    """Adds geometry: how a box lies to its source's interest area (in, out, mixed_in, mixed_out by corners and centre); null without such an area."""
    b = Box.of()
    df = placed(rows, regions, missing).withColumn("__a", F.get(F.filter("region.interest", lambda a: a["name"] == area), F.lit(0))).drop("region")
    corner = lambda x, y: within_shape(x.cast("double"), y.cast("double"), F.col("__a")).cast("int")
    df = df.withColumn("__n", corner(b.x, b.y) + corner(b.xmax, b.y) + corner(b.xmax, b.ymax) + corner(b.x, b.ymax))
    n = F.col("__n")
    found = F.when(F.col("__a").isNull(), None).when(n == 4, "in").when(n == 0, "out").when(within_shape(*centre(b), F.col("__a")), "mixed_in").otherwise("mixed_out")
    return df.withColumn("geometry", found).drop("__a", "__n")


def retained(sightings: DataFrame, frames: int) -> DataFrame:
    """tagged() sightings in which an object once under analysis stays so until it has been out of sight for so many frames, where its source's
    definition says that it shall. Expiry needs no clean-up: an object that comes back is in a new session."""
    s = windows.sessions(sightings, frames)
    held = F.max(F.col("under_analysis").cast("int")).over(windows.over(["object_id", "session_no"], "frame_id").rowsBetween(windows.Window.unboundedPreceding, 0)) == 1
    return s.withColumn("under_analysis", F.col("under_analysis") | (F.col("retain") & held))


# ---- the same, said in SQL for an independent engine

def edges_sql(rows: list[dict[str, Any]]) -> str:
    """edge: one row per edge of each polygon: source, kind, place in its list, name, lane index, ends. retain_of: one row per source."""
    out = []
    for r in rows:
        for kind in ("analysis", "excluded", "lanes", "interest"):
            for place, a in enumerate(r[kind]):
                name = (a["name"] or "").replace("'", "''")
                out += [f"('{r['source_id']}', '{kind}', {place}, '{name}', {a.get('index') if a.get('index') is not None else 'NULL::INT'}, {e['ax']}::DOUBLE, {e['ay']}::DOUBLE, {e['bx']}::DOUBLE, {e['by']}::DOUBLE)" for e in a["edges"]]
    keep = ", ".join(f"('{r['source_id']}', {str(r['retain']).lower()})" for r in rows)
    return f"edge(source_id, kind, place, name, idx, ax, ay, bx, by_) AS (VALUES {', '.join(out)}), retain_of(source_id, retain) AS (VALUES {keep})"


def pip_sql(points: str, name: str) -> str:
    """name: which polygons hold each of the points (source_id, px, py)."""
    return f"""{name} AS (SELECT source_id, px, py, kind, place, any_value(name) AS name, any_value(idx) AS idx FROM {points} JOIN edge USING (source_id) GROUP BY ALL
 HAVING bool_or((bx - ax) * (py - ay) = (by_ - ay) * (px - ax) AND px BETWEEN least(ax, bx) AND greatest(ax, bx) AND py BETWEEN least(ay, by_) AND greatest(ay, by_))
 OR count(*) FILTER ((ay > py) <> (by_ > py) AND px < (bx - ax) * (py - ay) / nullif(by_ - ay, 0) + ax) % 2 = 1)"""


def tagged_sql(table: str, out: str) -> str:
    """out: the rows of table (x, y, w, h) with under_analysis, lane, areas and retain. Needs edges_sql() before it."""
    at = "trunc(x + w / 2.0)::DOUBLE AS px, trunc(y + h / 2.0)::DOUBLE AS py"
    return f"""{out}_pt AS (SELECT DISTINCT source_id, {at} FROM {table}), {pip_sql(out + '_pt', out + '_in')},
{out}_flag AS (SELECT source_id, px, py, bool_or(kind = 'analysis') AND NOT bool_or(kind = 'excluded') AS u, max_by(idx, place) FILTER (kind = 'lanes') AS l, list(name ORDER BY place) FILTER (kind = 'interest') AS a FROM {out}_in GROUP BY ALL),
{out} AS (SELECT t.*, coalesce(u, false) AS under_analysis, CASE WHEN u THEN l END AS lane, coalesce(a, []) AS areas, retain FROM (SELECT *, {at} FROM {table}) t LEFT JOIN {out}_flag USING (source_id, px, py) JOIN retain_of USING (source_id))"""

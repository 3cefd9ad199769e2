"""Column functions on vectors, text and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def mean_cosine_distance(known: Column, look: Column) -> Column:
    """Of the vectors of an array to one vector; null for an empty array."""
    return F.aggregate(known, F.lit(0.0), lambda s, v: s + 1 - cosine(v, look)) / F.nullif(F.size(known), F.lit(0))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, factor: Column | float) -> Column:
    return F.transform(a, lambda x: x * factor)


def over(a: Column, divisor: Column | float) -> Column:
    return F.transform(a, lambda x: x / divisor)


def l2_normalised(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(a, lambda x: F.exp(x - top) / total)


def strip_fences(text: Column) -> Column:
    """One leading and one trailing code fence go, and white space around what they hold."""
    bare = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.when(text.startswith("{") & text.endswith("}"), text).otherwise(bare(F.regexp_replace(F.regexp_replace(bare(text), "^(?:```|''')(?:json)?", ""), "(?:```|''')$", "")))  # most have none


def flexible_string(json: Column, path: str) -> Column:
    """null: empty; an array: joined by '; '; anything else: its text."""
    raw = F.get_json_object(json, path)
    return F.coalesce(F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), "; ")).otherwise(raw), F.lit(""))


def name_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "")


def key_values(text: Column) -> Column:
    """key:value parts, split at commas, as a map of whole numbers; a part without a number goes, of equal keys the last stays."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.substring_index(p, ":", -1)).try_cast("bigint").alias("value"), F.contains(p, F.lit(":")).alias("whole")))
    good = F.filter(parts, lambda p: p["whole"] & p["value"].isNotNull() & (p["key"] != ""))
    return F.aggregate(good, F.expr("map()").cast("map<string,bigint>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))))


def number_or(text: Column, default: float, least: float | None = None, most: float | None = None) -> Column:
    """The number, if it is one and within bounds, else the default."""
    n = F.trim(text).try_cast("double")
    ok = n.isNotNull() & ~F.isnan(n)
    ok = ok & (n >= least) if least is not None else ok
    return F.when(ok & (n <= most) if most is not None else ok, n).otherwise(F.lit(float(default)))


def pair(text: Column) -> Column:
    """a,b as a struct of whole numbers; null unless there are two."""
    n = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("int"))
    return F.when((F.size(n) == 2) & ~F.exists(n, lambda v: v.isNull()), F.struct(F.get(n, F.lit(0)).alias("a"), F.get(n, F.lit(1)).alias("b")))


def flag_or(text: Column, default: bool) -> Column:
    """true or false in any case, else the default."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "false"), t == "true").otherwise(F.lit(default))


def base64_image(jpeg: Column) -> Column:
    return F.base64(jpeg)


def decoded(text: Column, schema: str) -> Column:
    """A model's answer: fences stripped, then read by the schema; null where it is no JSON object, and so is a field of another type."""
    read = lambda t: F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), F.from_json(t, schema))
    return F.get(F.transform(F.array(strip_fences(text)), read), F.lit(0))


def readable(text: Column) -> Column:
    """Is decoded() of the text anything but null, whatever the schema: a JSON object is read to a struct, if to one of nulls."""
    return F.coalesce(F.get(F.transform(F.array(strip_fences(text)), lambda t: F.try_parse_json(t).isNotNull() & t.startswith("{")), F.lit(0)), F.lit(False))


#: Fields of the models' answers.
OCCURRED = "isObjOccurred boolean, occurredObjects array<struct<type:string,conf:double,bbox_2d:array<int>>>"
ACTION = "Conclusion string, Action string"
SHIP = "ShipTypeGroup string, ShipTypeDetail string, ShipColor array<string>, ShipDraught string, ShipViewAngle string, ShipLoadTypes array<string>, ShipPaintedText array<struct<Text:string,Bbox:array<int>>>"


def rectangle(text: Column) -> Column:
    """x,y,w,h as a struct of whole numbers; null unless there are four."""
    n = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("int"))
    return F.when((F.size(n) == 4) & ~F.exists(n, lambda v: v.isNull()), F.struct(*[F.get(n, F.lit(i)).alias(c) for i, c in enumerate("xywh")]))


def file_safe(text: Column) -> Column:
    return F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_")


def server_url(url: Column) -> Column:
    """No trailing slash; an empty path becomes /v1."""
    bare = F.rtrim(F.trim(url), F.lit("/"))
    return F.when(bare.rlike("^[a-z]+://[^/]+$"), F.concat(bare, F.lit("/v1"))).otherwise(bare)


def mask_password(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)((?:password|pwd)\s*=\s*)[^;]*", "$1***")


def colour(text: Column) -> Column:
    """#rrggbb or rgba(r,g,b,a) as a struct of r, g, b, alpha (0..1); anything else null."""
    hexed = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("int")
    part = lambda i: F.regexp_extract(text, r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,\s*([0-9.]+)\s*)?\)$", i)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    plain = F.struct(hexed(2).alias("r"), hexed(4).alias("g"), hexed(6).alias("b"), F.lit(1.0).alias("alpha"))
    full = F.struct(*[part(i).cast("int").alias(n) for i, n in ((1, "r"), (2, "g"), (3, "b"))], clamp(F.coalesce(F.try_to_number(F.nullif(part(4), F.lit("")), F.lit("9.99")).cast("double"), F.lit(1.0))).alias("alpha"))
    return F.when(text.rlike("^#[0-9a-fA-F]{6}$"), plain).when(text.rlike(r"^rgba?\("), full)


def event_bucket(algorithm: Column, ts: Column) -> Column:
    return F.concat(F.lower(F.replace(algorithm, F.lit(" "), F.lit(""))), F.date_format(ts, "yyyyMMdd"))


def artefact_path(folder: str, stable_id: Column, ts: Column, number: Column) -> Column:
    return F.concat_ws("_", F.concat(F.lit(folder + "/"), file_safe(stable_id)), F.date_format(ts, "yyyyMMddHHmmssSSS"), F.lpad(number.cast("string"), 6, "0"))


def snapshot_path(folder: str, source: Column, object_id: Column, ts: Column, width: Column, height: Column, least: tuple[int, int]) -> Column:
    """Where an object's best picture goes; null unless it is wider and higher than the least size."""
    day, at = F.date_format(ts, "yyyyMMdd"), F.date_format(ts, "yyyyMMddHHmmssSSS")
    path = F.concat(F.concat_ws("/", F.lit(folder), F.lit("Best"), day, file_safe(source), file_safe(object_id)), F.lit("_"), at, F.lit(".jpg"))
    return F.when((width > least[0]) & (height > least[1]), path)


def score_factor(by: str, confidence: Column, width: Column, height: Column) -> Column:
    """What snapshots are ranked by: confidence, area, width or height."""
    return {"confidence": confidence.cast("double"), "area": (width.cast("long") * height).cast("double"), "width": width.cast("double"), "height": height.cast("double")}[by.strip().lower()]


def four_digits(x: Column) -> Column:
    return F.format_string("%.4f", x.cast("double"))

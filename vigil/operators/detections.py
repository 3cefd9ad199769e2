"""What is done to detections before anything else: validity, labels by number, evidence of an object, and boxes of one part of a picture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.geometry import Box


def valid(ts: bool = True) -> Column:
    """A detection that may be worked on: source and label aren't blank, numbers aren't negative, the confidence is finite and in 0..1, the box isn't
    empty, the time is known."""
    number = lambda c: F.coalesce(F.col(c) >= 0, F.lit(False))
    text = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    sure = F.coalesce(~F.isnan(F.col("confidence").cast("double")) & F.col("confidence").between(0, 1), F.lit(False))
    box = F.coalesce(~Box.of().empty, F.lit(False))
    parts = [text("source_id"), number("frame_id"), number("label_id"), text("label"), sure, box, number("tracking_id")]
    return reduce(lambda a, b: a & b, parts + ([F.col("ts").isNotNull()] if ts else []))


def quarantined(dets: DataFrame, ts: bool = True) -> tuple[DataFrame, DataFrame]:
    """The valid detections, and the others."""
    ok = dets.withColumn("__ok", valid(ts))
    return ok.filter("__ok").drop("__ok"), ok.filter("not __ok").drop("__ok")


def labelled(dets: DataFrame, names: DataFrame) -> DataFrame:
    """Adds label from label_id by the table names (label_id, label); a number without a name goes, as the detector knows no such class."""
    return dets.join(names, "label_id")


def evidence(object_id: Column | str = "object_id") -> Column:
    """The ten fields that a request carries of an object."""
    local = F.concat_ws("_", "label", F.col("tracking_id").cast("string"))
    return F.struct(F.col(object_id).alias("object_id") if isinstance(object_id, str) else object_id.alias("object_id"), local.alias("local_id"), "label", "label_id", "tracking_id", "confidence", "x", "y", F.col("w").alias("width"), F.col("h").alias("height"))


def of_areas(parts: list[DataFrame]) -> DataFrame:
    """Detections of several areas of one picture, each with the offset (dx, dy) of its area, in the picture's own pixels; where areas overlap, duplicates stay."""
    b = Box.of().translated(F.col("dx"), F.col("dy"))
    return reduce(DataFrame.unionByName, [p.withColumns({"x": b.x, "y": b.y}).drop("dx", "dy") for p in parts])

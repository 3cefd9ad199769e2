"""Messages of events, one function for each class; what they say is fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def density(label: Column, count: Column, region: Column, most: Column) -> Column:
    return _text(label, " number: ", count, " in detection region:", region, ", exceed max thresh: ", most, ".")


def occurrence(labels: Column, region: Column, seconds: Column) -> Column:
    return _text("Objects: ", F.array_join(labels, ", "), " have occurred in region:", region, " for ", seconds, " seconds.")


def occurrence_confirmed(labels: Column, region: Column, seconds: Column) -> Column:
    return _text("Objects: ", F.array_join(labels, ", "), " have occurred in region:", region, " for ", seconds, " seconds and were confirmed by LLM.")


def region_access(state: Column, object_id: Column, region: Column, ts: Column) -> Column:
    """Entering, Inside or Leaving; null for any other state."""
    verb = F.when(state == "Entering", "entering").when(state == "Inside", "in").when(state == "Leaving", "leaving")
    return _text("'", object_id, "' ", verb, " region '", region, "' at '", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), "'.")


def smuggling(gatherings: Column, people: Column, frame: Column) -> Column:
    return _text("Smuggling detected. Gatherings:", gatherings, ", people:", people, ", frame:", frame, ".")


def motion(boxes: Column) -> Column:
    return _text("Motion detected with ", boxes, " boxes.")


def classified(object_id: Column, label: Column, confidence: Column) -> Column:
    return _text("Object:'", object_id, "' classified as ", label, ", with conf:", F.format_string("%.2f", confidence.cast("double")))


def ship(object_id: Column, group: Column, detail: Column, colours: Column) -> Column:
    return _text(object_id, " labels -> TypeGroup:", group, ", TypeDetail:", detail, ", Colors:", F.array_join(colours, ","))


def ship_verified(object_id: Column, label: Column) -> Column:
    """label: a struct by scalars.SHIP."""
    return _text(object_id, " labels -> Type:", label["ShipTypeGroup"], "|", label["ShipTypeDetail"], ", Colors:", F.array_join(label["ShipColor"], ","), ", Draught:", label["ShipDraught"], ", ViewAngle:", label["ShipViewAngle"], ", LoadTypes:", F.array_join(label["ShipLoadTypes"], ","))


def sequence(sequence_id: Column, first: Column, last: Column, layout: str, length: Column, model: str) -> Column:
    return _text("Sequence image ", sequence_id, " (", first, "-", last, ", ", layout, ", ", length, " frames) was analyzed by LLM '", model, "'.")


def inference(model: str, elapsed: Column, result: Column) -> Column:
    return _text("LLM '", model, "', Elapse: ", elapsed, ", Result: ", result, ".")

"""The pipelines that are in use, as settings, one query each: annotations, crowds, boats, fire and smoke, fights, guarded zones, smuggling, ship labels,
classes, plates and motion. Models' answers are made up from the tables by a rule that SQL can say too."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import scalars
from vigil.operators import rules
from vigil.plans import pipelines
from vigil.plans.queries import _FILES, _GEOMETRY_SQL, _TAGGED_SQL, _TSIGHT_SQL, query
from vigil.plans.rules import _CHAIN
from vigil.sources import regions, views
from vigil.sources.views import DETECTIONS_SQL, SIGHTINGS_SQL

SOURCES = [f"cam-{i}" for i in range(4)]
LIFETIME = 50


def document(algorithms: list[tuple[str, dict[str, Any]]], detector: dict[str, Any] | None = None) -> dict[str, Any]:
    none = {"Class": "", "Preferences": {}}
    return {
        "Pipeline": {"FrameLifetime": LIFETIME},
        "VideoLoaders": [{"Class": "Table", "Preferences": {"SourceId": s}} for s in SOURCES],
        "RegionManager": [{"Class": "Definition", "Preferences": {"SourceId": s, "RegionDefinitionFile": f"{s}.json"}} for s in SOURCES],
        "InputFrameBuffer": none, "OutputFrameBuffer": none, "Detector": {"Class": "Table", "Preferences": {"ConfThresh": 0, **(detector or {})}}, "Tracker": none,
        "Snapshot": none, "MessagePoster": none, "EventRepository": none, "AnnotationSender": none, "AnnotationRender": none,
        "Algorithms": [{"Class": name, "Preferences": p} for name, p in algorithms],
    }


def _answers(result: Column):
    """An answer to each request: after 3 to 202 frames."""

    def of(requests: DataFrame) -> DataFrame:
        at = (F.col("frame_id") + 3 + F.col("frame_id") * 7 % 200) * 100_000
        return requests.select(F.concat("candidate_id", F.lit("/r")).alias("request_id"), "candidate_id", at.alias("completed_us"), result.alias("result"))

    return of


def _yes(f: Column) -> Column:
    said = F.when(f % 3 == 0, "false").otherwise("true")
    return F.when(f % 11 == 0, "no {json").otherwise(F.concat(F.lit('```json\n{"isObjOccurred": '), said, F.lit(', "occurredObjects": [{"type": "boat", "conf": 0.5, "bbox_2d": [1, 2, 3, 4]}]}\n```')))


def _ship(f: Column) -> Column:
    text = F.concat(F.lit('{"ShipTypeGroup": "cargo", "ShipTypeDetail": "kind-'), (f % 5).cast("string"), F.lit('", "ShipColor": ["red", "blue"], "ShipDraught": "deep", "ShipViewAngle": "left", "ShipLoadTypes": ["coal"]}'))
    return F.when(f % 13 == 0, "none").otherwise(text)


def _labels() -> Column:
    detail = F.when(F.col("w") % 2 == 0, F.concat(F.lit("type-"), (F.col("h") % 3).cast("string"))).otherwise("Unknown")
    return F.struct(F.lit("ship").alias("group"), detail.alias("detail"), F.array(F.lit("red"), F.lit("white")).alias("colours"))


def hooks(name: str = "") -> pipelines.Hooks:
    """What models say to a pipeline. Made when a query runs, as columns need a session."""
    f = F.col("frame_id")
    if name == "ship_labels_verified":
        return pipelines.Hooks(answers=_answers(_ship(f)))
    return pipelines.Hooks(
        labels=_labels(),
        classes=F.struct(F.concat(F.lit("class-"), (F.col("w") % 4).cast("string")).alias("label"), (F.col("h") % 100 / 100.0).alias("confidence")),
        text=F.struct(F.concat(F.lit("T"), f.cast("string")).alias("text"), F.col("part_confidence").alias("score")),
        answers=_answers(_yes(f)),
    )


_WATCHED = {"OccurrenceCheckRegionName": "watch", "TargetObjectNames": "boat, car"}
#: The algorithms of each pipeline in use.
PIPELINES: dict[str, dict[str, Any]] = {
    "people_density": document([("ObjectDensity", {"EventName": "crowd", "ObjectToBeCount": "person", "CountRegionName": "watch", "MaxCountThreshold": 1, "LocalEventIntervalSec": 3})]),
    "boat_density": document([("ObjectDensity", {"EventName": "boats", "ObjectToBeCount": "boat", "CountRegionName": "watch", "MaxCountThreshold": 2, "LocalEventIntervalSec": 3})], {"FilterSmallObject": True, "MinBboxWidth": 30, "MinBboxHeight": 30}),
    "fire_smoke": document([("ObjectOccurrence", {"EventName": "fire", **_WATCHED, "OccurrenceCondition": "or", "MinDurationSec": 1, "LocalEventIntervalSec": 3})]),
    "fire_smoke_confirmed": document([("ObjectOccurrenceByLLM", {"EventName": "fire", **_WATCHED, "OccurrenceCondition": "or", "MinDurationFrames": 3, "LocalEventIntervalSec": 3})]),
    "fight": document([("SequenceToImage", {"EventName": "fight", "TargetObjectNames": "person", "SequenceLength": 5, "FrameStride": 2, "ModelName": "m", "RequestTtlSeconds": 12})]),
    "guard_zone": document([("RegionAccess", {"EventName": "access", "RegionName": "watch", "RegionRelativeTypes": "boat", "StateStabilityThreshold": 2})], {"WillMapObjectTypes": True, "SourceObjectTypeNames": "car", "DestinationObjectTypeName": "boat"}),
    "smuggling": document([("SmugglingDetection", {"EventName": "smuggling", "WidthBasedApproachFactor": 3, "MaxGatheringCount": 2, "EventSustainSec": 10, "HistoryLengthThresh": 10, "DistanceIncreasePercentThresh": 0.5, "MovingAwayPercentThresh": 0.6})]),
    "ship_labels": document([("Labels", {"EventName": "ship", "Stride": 5, "MinImageAreaOfLabelEvent": 6000})]),
    "ship_labels_verified": document([("LabelsByLLM", {"EventName": "ship", "Stride": 10, "ObjectExpiredWaitSeconds": 8})]),
    "classify": document([("Classify", {"EventName": "class", "LocalEventIntervalSec": 1})]),
    "boat_plate": document([("GenerateDebugAnnotations", {}), ("OCR", {"EventName": "plate", "OcrType": "car", "OcrBearerType": "boat", "ScoreThresh": 0.5})]),
    "motion": document([("MotionDetection", {"EventName": "motion", "LocalEventIntervalSec": 5, "MinArea": 4000, "MaxArea": 30000, "AspectRatio": 4})]),
}


def _throttled(events: str, frames: int) -> str:
    """passed: of the events, one a source and frame (the least message), those that a throttle of so many frames lets through."""
    return f"""e1 AS (SELECT source_id, frame_id, min(message) AS message FROM {events} GROUP BY ALL),
r(source_id, f) AS (SELECT source_id, min(frame_id) FROM e1 GROUP BY 1 UNION ALL SELECT r.source_id, (SELECT min(frame_id) FROM e1 WHERE e1.source_id = r.source_id AND e1.frame_id >= r.f + {frames}) FROM r WHERE r.f IS NOT NULL),
passed AS (SELECT source_id, frame_id, message FROM e1 JOIN r USING (source_id) WHERE f = frame_id)"""


def _density_sql(label: str, most: int, where: str = "true") -> str:
    return f"WITH RECURSIVE {DETECTIONS_SQL}, {_TAGGED_SQL}, n AS (SELECT source_id, frame_id, count(*) FILTER (label = '{label}' AND under_analysis AND list_contains(areas, 'watch')) AS n FROM tagged WHERE {where} GROUP BY ALL), ev AS (SELECT source_id, frame_id, '{label} number: ' || n || ' in detection region:watch, exceed max thresh: {most}.' AS message FROM n WHERE n > {most}), {_throttled('ev', 30)} SELECT * FROM passed"


_MET = f"{DETECTIONS_SQL}, {_TAGGED_SQL}, t AS (SELECT *, under_analysis AND label IN ('boat', 'car') AND list_contains(areas, 'watch') AS hit FROM tagged), o AS (SELECT source_id, frame_id, bool_or(hit) AS met, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (hit)), ', '), 'boat, car') AS labels FROM t GROUP BY ALL), i AS (SELECT *, sum((NOT met)::INT) OVER (PARTITION BY source_id ORDER BY frame_id) AS g FROM o), run AS (SELECT *, row_number() OVER (PARTITION BY source_id, g ORDER BY frame_id) AS k, frame_id - min(frame_id) OVER (PARTITION BY source_id, g) AS lasted FROM i WHERE met)"
_LIFE = f"g AS (SELECT *, coalesce((frame_id - lag(frame_id) OVER (PARTITION BY object_id ORDER BY frame_id) >= {LIFETIME})::INT, 0) AS ng FROM tsight), life AS (SELECT *, sum(ng) OVER (PARTITION BY object_id ORDER BY frame_id) AS no FROM g), ends AS (SELECT source_id, max(frame_id) AS last_frame FROM det GROUP BY 1)"
_SHIPS = f"""{_LIFE}, k AS (SELECT source_id, frame_id, row_number() OVER (PARTITION BY source_id ORDER BY frame_id) - 1 AS k FROM (SELECT DISTINCT source_id, frame_id FROM det)),
b AS (SELECT life.*, k % 5 = 0 OR row_number() OVER (PARTITION BY object_id, no ORDER BY frame_id) = 1 AS looked, max(frame_id) OVER (PARTITION BY object_id, no) AS seen FROM life JOIN k USING (source_id, frame_id) WHERE label = 'boat'),
ev AS (SELECT *, CASE WHEN w % 2 = 0 THEN 'type-' || (h % 3) ELSE 'Unknown' END AS detail FROM b WHERE looked QUALIFY row_number() OVER (PARTITION BY object_id, no ORDER BY w % 2, confidence DESC, CASE WHEN w % 2 = 0 THEN 0 ELSE w::BIGINT * h END DESC, frame_id) = 1)"""
_PARTS = f"""life2 AS (SELECT *, sum(ng) OVER (PARTITION BY object_id ORDER BY frame_id) AS no FROM (SELECT *, coalesce((frame_id - lag(frame_id) OVER (PARTITION BY object_id ORDER BY frame_id) >= {LIFETIME})::INT, 0) AS ng FROM tsight WHERE under_analysis AND label = 'boat')),
pair AS (SELECT a.source_id, a.frame_id, a.object_id AS bearer, a.no, a.confidence AS bearer_confidence, b.object_id AS part, b.confidence AS part_confidence FROM life2 a JOIN tsight b ON a.source_id = b.source_id AND a.frame_id = b.frame_id AND b.label = 'car' AND b.under_analysis AND b.x >= a.x AND b.y >= a.y AND b.x + b.w <= a.x + a.w AND b.y + b.h <= a.y + a.h)"""

SQL: dict[str, str] = {
    "people_density": _density_sql("person", 1),
    "boat_density": _density_sql("boat", 2, "w >= 30 AND h >= 30"),
    "fire_smoke": f"WITH RECURSIVE {_MET}, ev AS (SELECT source_id, frame_id, 'Objects: ' || labels || ' have occurred in region:watch for ' || round_even(lasted / 10.0, 0)::INT || ' seconds.' AS message FROM run WHERE lasted >= 10), {_throttled('ev', 30)} SELECT * FROM passed",
    "fire_smoke_confirmed": f"WITH RECURSIVE {_MET}, held AS (SELECT source_id, g, frame_id, k FROM run WHERE k >= 3), {_CHAIN}, ev AS (SELECT source_id, frame_id + 3 + frame_id * 7 % 200 AS frame_id, 'Objects: boat, car have occurred in region:watch for ' || k || ' seconds and were confirmed by LLM.' AS message FROM chain WHERE frame_id % 11 <> 0 AND frame_id % 3 <> 0 AND 3 + frame_id * 7 % 200 < 120), {_throttled('ev', 30)} SELECT * FROM passed",
    "fight": f"WITH {DETECTIONS_SQL}, f AS (SELECT source_id, frame_id, row_number() OVER (PARTITION BY source_id ORDER BY frame_id) - 1 AS n FROM (SELECT DISTINCT source_id, frame_id FROM det WHERE label = 'person')), c AS (SELECT source_id, frame_id, n // 2 // 5 AS b FROM f WHERE n % 2 = 0), s AS (SELECT source_id, b, min(frame_id) AS a, max(frame_id) AS frame_id FROM c GROUP BY ALL HAVING count(*) = 5) SELECT source_id, frame_id, 'Sequence image seq_' || source_id || '_' || b || ' (' || a || '-' || frame_id || ', Horizontal, 5 frames) was analyzed by LLM ''m''.' AS message FROM s WHERE frame_id % 11 <> 0 AND frame_id % 3 <> 0 AND 3 + frame_id * 7 % 200 < 120",
    "guard_zone": f"""WITH RECURSIVE det0 AS (SELECT * FROM (WITH {DETECTIONS_SQL} SELECT * FROM det)), det AS (SELECT * REPLACE (CASE WHEN label = 'car' THEN 'boat' ELSE label END AS label) FROM det0),
sight AS (SELECT *, source_id || '_' || label || '_' || tracking_id AS object_id FROM det QUALIFY row_number() OVER (PARTITION BY source_id, frame_id, label, tracking_id ORDER BY confidence DESC, w DESC, h DESC, x DESC, y DESC) = 1),
{_GEOMETRY_SQL}, {regions.tagged_sql('sight', 'tsight')}, o AS (SELECT source_id, object_id, frame_id, geometry, row_number() OVER (PARTITION BY object_id ORDER BY frame_id) AS n FROM geom JOIN tsight USING (object_id, frame_id) WHERE label = 'boat' AND under_analysis),
s(source_id, object_id, frame_id, n, state, stay) AS (SELECT source_id, object_id, frame_id, n, CASE WHEN geometry IN ('in', 'mixed_in') THEN 'Entering' ELSE 'Outside' END, 1 FROM o WHERE n = 1
 UNION ALL SELECT source_id, object_id, frame_id, n, new, CASE WHEN new = old THEN stay + 1 ELSE 1 END FROM (SELECT o.*, s.state AS old, s.stay, CASE o.geometry WHEN 'in' THEN CASE WHEN s.state IN ('Entering', 'Inside') THEN 'Inside' ELSE 'Entering' END WHEN 'mixed_in' THEN CASE WHEN s.state = 'Inside' THEN 'Inside' ELSE 'Entering' END
 WHEN 'mixed_out' THEN CASE WHEN s.state = 'Outside' THEN 'Outside' ELSE 'Leaving' END ELSE CASE WHEN s.state IN ('Entering', 'Inside') THEN 'Leaving' ELSE 'Outside' END END AS new FROM s JOIN o ON o.object_id = s.object_id AND o.n = s.n + 1))
SELECT source_id, frame_id, '''' || object_id || ''' ' || CASE state WHEN 'Entering' THEN 'entering' WHEN 'Inside' THEN 'in' ELSE 'leaving' END || ' region ''watch'' at ''' || strftime(make_timestamp(frame_id * 100000), '%Y-%m-%d %H:%M:%S') || '''.' AS message FROM s WHERE stay = 2 AND state <> 'Outside'""",
    "ship_labels": f"WITH {SIGHTINGS_SQL}, {_TSIGHT_SQL}, {_SHIPS} SELECT source_id, seen + {LIFETIME} AS frame_id, object_id || ' labels -> TypeGroup:ship, TypeDetail:' || detail || ', Colors:red,white' AS message FROM ev JOIN ends USING (source_id) WHERE w::BIGINT * h >= 6000 AND seen + {LIFETIME} <= last_frame",
    "classify": f"WITH RECURSIVE {SIGHTINGS_SQL}, b AS (SELECT *, max(confidence) OVER (PARTITION BY object_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sight), ev AS (SELECT source_id, frame_id, 'Object:''' || object_id || ''' classified as class-' || (w % 4) || ', with conf:' || printf('%.2f', (h % 100) / 100.0) AS message FROM b WHERE m IS NULL OR confidence > m), {_throttled('ev', 10)} SELECT * FROM passed",
    "boat_plate": f"WITH {SIGHTINGS_SQL}, {_TSIGHT_SQL}, {_PARTS}, q AS (SELECT DISTINCT bearer, no, frame_id, bearer_confidence FROM pair), m AS (SELECT *, max(bearer_confidence) OVER (PARTITION BY bearer, no ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM q) SELECT source_id, frame_id, '''' || bearer || ''' contains ''' || part || ''', content:T' || frame_id AS message FROM pair JOIN m USING (bearer, no, frame_id) WHERE (m IS NULL OR m.bearer_confidence > m) AND part_confidence >= 0.5",
    "motion": f"WITH RECURSIVE {DETECTIONS_SQL}, n AS (SELECT source_id, frame_id, count(*) FILTER (w::BIGINT * h BETWEEN 4000 AND 30000 AND greatest(w, h) / greatest(1, least(w, h)) <= 4) AS n FROM det GROUP BY ALL), ev AS (SELECT source_id, frame_id, 'Motion detected with ' || n || ' boxes.' AS message FROM n WHERE n > 0), {_throttled('ev', 50)} SELECT * FROM passed",
}


def _pipeline_query(name: str) -> None:
    def run(spark, d):
        return pipelines.events(views.detections(spark, d), PIPELINES[name], _FILES, hooks(name)).select("source_id", "frame_id", "message")

    run.__name__ = f"pipeline_{name}"
    query(SQL.get(name))(run)


for _name in PIPELINES:
    _pipeline_query(_name)


_NAMED = "SELECT source_id, string_agg(kind || '_' || n, ' ' ORDER BY o, place) AS ids, count(*) AS n FROM (SELECT DISTINCT source_id, place, place + 1 AS n, CASE kind WHEN 'analysis' THEN 'AnalysisArea' WHEN 'excluded' THEN 'ExcludedArea' WHEN 'lanes' THEN 'Lane' ELSE 'InterestArea' END AS kind, CASE kind WHEN 'analysis' THEN 1 WHEN 'excluded' THEN 2 WHEN 'lanes' THEN 3 ELSE 4 END AS o FROM edge) GROUP BY 1"


@query(f"WITH {SIGHTINGS_SQL}, {_TSIGHT_SQL}, named AS ({_NAMED}), ob AS (SELECT source_id, frame_id, coalesce(string_agg('bbox_' || object_id || ' text_' || object_id, ' ' ORDER BY object_id) FILTER (under_analysis), '') AS ids, 2 * count(*) FILTER (under_analysis) AS n FROM tsight GROUP BY ALL) SELECT source_id, frame_id, (ob.n + named.n + CASE WHEN source_id = 'cam-0' THEN 2 ELSE 0 END)::INT AS n_shapes, trim(named.ids || CASE WHEN source_id = 'cam-0' THEN ' CountLine_1 CountLine_2 ' ELSE ' ' END || ob.ids) AS ids FROM ob JOIN named USING (source_id)")
def pipeline_debug(spark, d):
    """What is drawn on each frame: the source's regions and count lines, then the objects under analysis."""
    f = pipelines.frames(views.detections(spark, d), document([("GenerateDebugAnnotations", {})]), _FILES, hooks())
    a = pipelines.annotations(f, {})
    return a.select("source_id", "frame_id", F.size("shapes").alias("n_shapes"), F.array_join(F.transform("shapes", lambda s: s["id"]), " ").alias("ids"))


@query(f"WITH {SIGHTINGS_SQL}, {_TSIGHT_SQL}, {_PARTS}, l AS (SELECT object_id AS bearer, no, max(frame_id) AS seen FROM life2 GROUP BY ALL), ends AS (SELECT source_id, max(frame_id) AS last_frame FROM det GROUP BY 1), c AS (SELECT source_id, bearer, no, part, max(part_confidence) AS part_confidence FROM pair GROUP BY ALL), s AS (SELECT bearer, no, max(bearer_confidence) AS bearer_confidence FROM pair GROUP BY ALL) SELECT source_id, bearer, no::BIGINT AS session_no, seen + {LIFETIME} AS expired_at, bearer_confidence, row_number() OVER (PARTITION BY bearer, no ORDER BY part_confidence DESC, part) AS place, part, part_confidence FROM c JOIN s USING (bearer, no) JOIN l USING (bearer, no) JOIN ends USING (source_id) WHERE seen + {LIFETIME} <= last_frame QUALIFY place <= 3")
def plate_snapshots(spark, d):
    """At a boat's expiry its surest sighting and its three surest parts."""
    f = pipelines.frames(views.detections(spark, d), PIPELINES["boat_plate"], _FILES, hooks())
    return pipelines.plates(f, "boat", "car").select("source_id", "bearer", "session_no", "expired_at", "bearer_confidence", F.col("place").cast("long").alias("place"), "part", "part_confidence")


def _frames(spark, d, name: str = "smuggling") -> pipelines.Frames:
    return pipelines.frames(views.detections(spark, d), PIPELINES[name], _FILES, hooks())


_AWAY_SQL = f"""WITH {SIGHTINGS_SQL}, {_TSIGHT_SQL}, u AS (SELECT *, round_even(x + w / 2.0, 0) AS rx, round_even(y + h / 2.0, 0) AS ry FROM tsight),
f AS (SELECT source_id, frame_id, first(rx ORDER BY x, y, w, h) FILTER (label = 'boat' AND under_analysis) AS bx, first(ry ORDER BY x, y, w, h) FILTER (label = 'boat' AND under_analysis) AS by_ FROM u GROUP BY ALL),
k AS (SELECT source_id, frame_id, last_value(bx IGNORE NULLS) OVER w AS bx, last_value(by_ IGNORE NULLS) OVER w AS by_ FROM f WINDOW w AS (PARTITION BY source_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT source_id, frame_id, object_id, bx, by_, list({{'x': rx, 'y': ry}}) OVER (PARTITION BY object_id ORDER BY frame_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h FROM u JOIN k USING (source_id, frame_id) WHERE label = 'person' AND under_analysis AND bx IS NOT NULL AND NOT (bx = 0 AND by_ = 0)),
d AS (SELECT *, list_transform(h, lambda q: sqrt(pow(q.x - bx, 2) + pow(q.y - by_, 2))) AS d FROM p)
SELECT source_id, frame_id, object_id, len(d) >= 5 AND len(list_filter(range(1, len(d)), lambda i: d[i + 1] > d[i])) / len(d) >= 0.5 AS moving_away FROM d"""


@query(_AWAY_SQL)
def moving_away(spark, d):
    return pipelines.people_and_boat(_frames(spark, d), 10, 0.5).select("source_id", "frame_id", "object_id", "moving_away")


@query()
def kept_gatherings(spark, d):
    return rules.gatherings(pipelines.people_and_boat(_frames(spark, d), 10, 0.5), 3, 2)


@query()
def smuggling_alarms(spark, d):
    return pipelines.smuggling_alarms(_frames(spark, d), 3, 2, 10, 10, 0.5, 0.6)


@query("WITH e AS (SELECT event_id, event_id % 7 AS k FROM events) SELECT event_id, CASE WHEN k < 5 THEN k % 2 = 0 END AS occurred, CASE WHEN k < 5 THEN 1 END AS objects FROM e")
def decoded_answers(spark, d):
    """Answers with and without fences, broken ones and nulls."""
    e = views.object_stream(spark, d).withColumn("k", F.col("event_id") % 7)
    body = F.concat(F.lit('{"isObjOccurred": '), F.when(F.col("k") % 2 == 0, "true").otherwise("false"), F.lit(', "occurredObjects": [{"type": "fire", "conf": 0.9, "bbox_2d": [1, 2, 3, 4]}]}'))
    text = F.when(F.col("k") < 2, body).when(F.col("k") < 4, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("k") == 4, F.concat(F.lit("'''"), body, F.lit("'''"))).when(F.col("k") == 5, "it occurred")
    got = scalars.decoded(text, scalars.OCCURRED)
    return e.select("event_id", got["isObjOccurred"].alias("occurred"), F.when(got.isNotNull(), F.size(got["occurredObjects"])).alias("objects"))

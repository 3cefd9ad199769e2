"""Pipelines by configuration: settings (see settings) name the sources, detection filters, region files, tracker and algorithms; each algorithm turns
frames into events. Algorithms and trackers are looked up by name, and others can be registered.

Detections run through the filters, then the tracker, then the regions, so that what is retained belongs to tracked objects. Models (detectors,
classifiers, recognisers, language models) stand outside: their answers come in as columns or tables (Hooks)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import messages, scalars, shapes
from vigil.functions.geometry import Box, evidence_quality
from vigil.operators import appearance, folds, keyed, motion, rules, windows
from vigil.plans import settings
from vigil.plans.settings import Component, ConfigError, Settings
from vigil.sources import regions, sinks, views
from vigil.sources.shared import stored as stored_table


@dataclass
class Hooks:
    """What models say. labels: of a box its attributes (a struct of group, detail and colours); classes: of a box its class and confidence; text: of a box its
    text and score; answers: request_id, completed_us, result of language models, to requests of the algorithms that ask for them."""

    labels: Column | None = None
    classes: Column | None = None
    text: Column | None = None
    answers: Callable[[DataFrame], DataFrame] | None = None
    look: str | None = None
    frame_ms: int = 100


@dataclass
class Frames:
    """The detections of a pipeline, and what follows from them. store: what is read many times over stands in the shared folder, worked out once. tag: what adds the regions
    to rows with a source and a box; without it the detections given are tagged."""

    given: DataFrame
    dimension: DataFrame
    settings: Settings
    hooks: Hooks
    store: bool = False
    tag: Callable[[DataFrame], DataFrame] | None = None
    _boats: dict[str, DataFrame] = field(default_factory=dict)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return stored_table(df, name) if self.store else df

    def tagged(self, df: DataFrame) -> DataFrame:
        return self.tag(df) if self.tag else df

    @cached_property
    def dets(self) -> DataFrame:
        """The detections, tagged."""
        return self.kept(self.tag(self.given), "frames") if self.tag else self.given

    def _best(self, rows: DataFrame, *carried: str) -> DataFrame:
        # what regions say of a detection follows from its source and box, so that it never decides which one is best; frames come first, as they tell most rows apart when these are sorted
        best = F.max(F.struct("confidence", "w", "h", "x", "y", *carried)).alias("b")
        s = rows.repartition("source_id", "frame_id").groupBy("frame_id", "source_id", "label", "tracking_id").agg(best)
        return s.select("source_id", "frame_id", "label", "tracking_id", F.concat_ws("_", "source_id", "label", "tracking_id").alias("object_id"), "b.*")

    def seen(self, label: str) -> DataFrame:
        """The sightings of a label, in lower case, not tagged: worked out from these detections alone, for what reads them once."""
        return self._best(self.given.filter(F.lower("label") == label))

    def analysed(self, label: str) -> DataFrame:
        """Those of them that are under analysis. Detections are tagged first, as a filter on what is aggregated isn't pushed into the tagging, which would be done twice."""
        return self._best(self.tagged(self.given.filter(F.lower("label") == label)), "under_analysis").filter("under_analysis")

    @cached_property
    def sightings(self) -> DataFrame:
        return self.kept(self.tagged(self._best(self.given, *[c for c in ("under_analysis", "lane", "areas", "retain") if c in self.given.columns])), "sightings")

    @property
    def numbers(self) -> DataFrame:
        """source_id and frame_id of every detection."""
        return self.given.select("source_id", "frame_id")

    def boats(self, label: str) -> DataFrame:
        """source_id, frame_id, b of every frame: the centre of the least of its boats under analysis; null without one."""
        if label not in self._boats:
            b = Box.of()
            first = self.analysed(label).groupBy("frame_id", "source_id").agg(F.min(F.struct("x", "y", "w", "h")).alias("o")).select("source_id", "frame_id", "o.*")
            first = first.select("source_id", "frame_id", F.struct(F.bround(b.cx).alias("bx"), F.bround(b.cy).alias("by")).alias("b"))
            self._boats[label] = self.kept(self.numbers.distinct().join(first, ["source_id", "frame_id"], "left"), "boats")
        return self._boats[label]

    @cached_property
    def ends(self) -> DataFrame:
        return self.numbers.groupBy("source_id").agg(F.max("frame_id").alias("last_frame"))

    def us(self, frame: str = "frame_id") -> Column:
        return F.col(frame) * self.hooks.frame_ms * 1000

    def ts(self, frame: str = "frame_id") -> Column:
        return F.timestamp_micros(self.us(frame))


#: name -> (frames, preferences) -> source_id, frame_id, message. THROTTLED: those whose events are throttled by source.
ALGORITHMS: dict[str, Callable[[Frames, dict[str, Any]], DataFrame]] = {}
THROTTLED: set[str] = set()
#: Algorithms that read the frames many times over: what they read is stored for them, so that it is tracked, sorted and tagged once.
SEVERAL = {"SmugglingDetection", "Labels", "LabelsByLLM", "RegionAccess", "OCR", "ObjectOccurrenceByLLM"}


def algorithm(name: str, throttled: bool = True):
    def add(f):
        ALGORITHMS[name] = f
        if throttled:
            THROTTLED.add(name)
        return f

    return add


def _sort(dets: DataFrame, c: Component, hooks: Hooks) -> DataFrame:
    return folds.sort_tracks(dets, c["IouThreshold"], c["MaxMisses"])


def _deep_sort(dets: DataFrame, c: Component, hooks: Hooks) -> DataFrame:
    if not hooks.look:
        raise ConfigError("tracking by appearance needs a column of appearances")
    sure = dets.filter(F.col("confidence") >= c["TargetConfidence"])
    return appearance.appearance_tracks(sure, hooks.look, weight=c["AppearanceWeight"], smooth_weight=c["SmoothAppearanceWeight"], smooth=c["FramesToAppearanceSmooth"], threshold=c["IouThreshold"], misses=c["MaxMisses"], streak=c["MinStreak"])


TRACKERS: dict[str, Callable[[DataFrame, Component, Hooks], DataFrame]] = {"SortTracker": _sort, "DeepSortTracker": _deep_sort}


def _pref(a: dict[str, Any], **known: tuple) -> dict[str, Any]:
    return settings.preferences(a, known)


_text, _whole, _number, _any = str, int, float, (lambda _: True)


def filtered(dets: DataFrame, c: Component, strided: DataFrame | None = None) -> DataFrame:
    """By confidence, type, greatest and least size; relabelled and suppressed, in this order."""
    df = dets.filter(F.col("confidence") >= c["ConfThresh"])
    if c["TargetTypes"]:
        df = df.filter(F.lower("label").isin(c["TargetTypes"]))
    if c["FilterLargeObject"]:
        df = df.filter((F.col("w") <= c["MaxBboxWidth"]) & (F.col("h") <= c["MaxBboxHeight"]))
    if c["FilterSmallObject"]:
        df = df.filter((F.col("w") >= c["MinBboxWidth"]) & (F.col("h") >= c["MinBboxHeight"]))
    if c["WillMapObjectTypes"] and c["SourceObjectTypeNames"]:
        df = df.withColumn("label", F.when(F.col("label").isin(c["SourceObjectTypeNames"]), c["DestinationObjectTypeName"]).otherwise(F.col("label")))
    return folds.inner_suppression(df, c["InnerObjectOverlapRatio"]) if c["WillSuppressInnerSameObject"] else df


def _strided(dets: DataFrame, strides: dict[str, int]) -> DataFrame:
    """The frames that each source gives."""
    if all(n == 1 for n in strides.values()):
        return dets
    n = F.create_map(*[F.lit(x) for kv in strides.items() for x in kv])
    kept = windows.ranked(dets.select("source_id", "frame_id").distinct(), "source_id", "frame_id", "n").filter(F.col("n") % F.try_element_at(n, F.col("source_id")) == 0).select("source_id", "frame_id")
    return dets.join(kept, ["source_id", "frame_id"], "left_semi")


def frames(dets: DataFrame, document: dict[str, Any], folder: str | Path = ".", hooks: Hooks | None = None) -> Frames:
    """The detections of the pipeline's sources, tagged. folder: where region files lie."""
    s, hooks, spark = settings.parse(document), hooks or Hooks(), dets.sparkSession
    for a in s["Algorithms"]:
        if a.kind not in ALGORITHMS:
            raise ConfigError(f"no algorithm {a.kind}")
    strides = {v["SourceId"]: v["VideoStride"] for v in s["VideoLoaders"]}
    df = _strided(dets.filter(F.col("source_id").isin(list(strides))), strides)
    df = _strided(df, dict.fromkeys(strides, s["Detector"]["DetectionStride"]))
    df = filtered(df, s["Detector"])
    if s["Tracker"].kind:
        if s["Tracker"].kind not in TRACKERS:
            raise ConfigError(f"no tracker {s['Tracker'].kind}")
        df = TRACKERS[s["Tracker"].kind](df, s["Tracker"], hooks)
        df = df.withColumn("tracking_id", F.substring_index("track_id", "_", -1).cast("int")).drop("track_id")
    rows = regions.rows_of({r["SourceId"]: Path(folder) / r["RegionDefinitionFile"] for r in s["RegionManager"]}, views.WIDTH, views.HEIGHT, Path(folder) / "default.json")
    dim = regions.dimension(spark, rows)
    tag = regions.tagged_by_cells if regions.many(rows) else regions.tagged
    several = len(s["Algorithms"]) > 1 or any(a.kind in SEVERAL for a in s["Algorithms"])
    store = several or bool(s["Tracker"].kind)
    costly = bool(s["Tracker"].kind) or s["Detector"]["WillSuppressInnerSameObject"] or any(n != 1 for n in (*strides.values(), s["Detector"]["DetectionStride"]))
    return Frames(stored_table(df, "detections") if store and costly else df, dim, s, hooks, store, lambda rows: tag(rows, dim))


def events(dets: DataFrame, document: dict[str, Any], folder: str | Path = ".", hooks: Hooks | None = None) -> DataFrame:
    """source_id, frame_id, ts, event_name, algorithm_name, message of all events of a pipeline that aren't throttled."""
    f = frames(dets, document, folder, hooks)
    found = []
    for a in f.settings["Algorithms"]:
        if not a["WillPublishEventMessage"]:
            continue
        e = ALGORITHMS[a.kind](f, a.of).select("source_id", "frame_id", "message").withColumns({"event_name": F.lit(a["EventName"]), "algorithm_name": F.lit(a.kind), "us": f.us()})
        if a.kind in THROTTLED:
            e = folds.throttle(f.kept(e, "events"), "source_id", "us", a["LocalEventIntervalSec"] * 1_000_000, "frame_id", "event_name", "message", "algorithm_name")
        found.append(e.select("source_id", "frame_id", F.timestamp_micros("us").alias("ts"), "event_name", "algorithm_name", "message"))
    if not found:
        return f.dets.select("source_id", "frame_id", f.ts().alias("ts"), F.lit("").alias("event_name"), F.lit("").alias("algorithm_name"), F.lit("").alias("message")).limit(0)
    return reduce(DataFrame.unionByName, found)


def posted(events: DataFrame, s: Settings) -> DataFrame:
    """The events that are sent on: none unless messages are posted; names with an interval are suppressed, if duplicates are looked for."""
    m = s["MessagePoster"]
    return folds.suppressed(events, m["EventSuppressionIntervals"], m["CheckDuplicateEvent"]) if m["WillPostMessage"] else events.limit(0)


def stored(dets: DataFrame, document: dict[str, Any], folder: str | Path = ".", hooks: Hooks | None = None) -> DataFrame:
    return sinks.stored_events(events(dets, document, folder, hooks))


@algorithm("ObjectDensity")
def density(f: Frames, a: dict[str, Any]) -> DataFrame:
    """Frames with over so many objects of a label in an area."""
    p = _pref(a, ObjectToBeCount=(_text, "person", _any), CountRegionName=(_text, "CountRegion", _any), MaxCountThreshold=(_whole, 10, _any))
    n = f.dets.groupBy("source_id", "frame_id").agg(F.count_if((F.lower("label") == p["ObjectToBeCount"]) & F.col("under_analysis") & regions.in_area(p["CountRegionName"])).alias("n"))
    return n.filter(F.col("n") > p["MaxCountThreshold"]).select("source_id", "frame_id", messages.density(F.lit(p["ObjectToBeCount"]), F.col("n"), F.lit(p["CountRegionName"]), F.lit(p["MaxCountThreshold"])).alias("message"))


_OCCURRENCE = dict(OccurrenceCheckRegionName=(_text, "", _any), OccurrenceCondition=(_text, "or", _any), EnableProximityCheck=(settings._flag, False, _any), ProximityObject1Label=(_text, "", _any), ProximityObject2Label=(_text, "", _any), ProximityThresholdRatio=(_number, 1.0, _any), ProximityReferenceObject=(_text, "", _any), ProximityReferenceDimension=(_text, "width", _any))


def occurring(f: Frames, p: dict[str, Any], targets: list[str]) -> DataFrame:
    """source_id, frame_id, met, labels: do any ("or") or all ("and") of the targets under analysis lie in the area, with some of two labels near each
    other, if that is asked for; any other condition is never met."""
    target = F.col("under_analysis") & F.lower("label").isin(targets)
    inside = target & regions.in_area(p["OccurrenceCheckRegionName"])
    box = F.struct(F.lower("label").alias("label"), F.struct("x", "y", "w", "h").alias("r"))
    g = f.dets.groupBy("source_id", "frame_id").agg(F.count_if(target).alias("n"), F.count_if(inside).alias("k"), F.collect_list(F.when(inside, box)).alias("o"))
    met = {"or": F.col("k") > 0, "and": (F.col("n") > 0) & (F.col("k") == F.col("n"))}.get(p["OccurrenceCondition"], F.lit(False))
    if p["EnableProximityCheck"]:
        one, other = p["ProximityObject1Label"].lower(), p["ProximityObject2Label"].lower()
        side = "h" if p["ProximityReferenceDimension"].lower() == "height" else "w"
        by = (lambda a, b: b["r"][side]) if p["ProximityReferenceObject"].lower() == other else (lambda a, b: a["r"][side])
        at = lambda x: Box(x["r"]["x"], x["r"]["y"], x["r"]["w"], x["r"]["h"])
        of = lambda label: F.filter("o", lambda x: x["label"] == label)
        near = F.exists(F.transform(of(one), lambda a, i: F.struct(a.alias("a"), i.alias("i"))), lambda a: F.exists(F.transform(of(other), lambda b, j: F.struct(b.alias("b"), j.alias("j"))), lambda b: (F.lit(one != other) | (a["i"] != b["j"])) & (at(a["a"]).centre_distance(at(b["b"])) < by(a["a"], b["b"]) * p["ProximityThresholdRatio"])))
        met = met & near
    labels = F.array_sort(F.array_distinct(F.transform("o", lambda x: x["label"])))
    return g.select("source_id", "frame_id", met.alias("met"), F.when(F.size("o") > 0, labels).otherwise(F.array(*map(F.lit, targets))).alias("labels"))


@algorithm("ObjectOccurrence")
def occurrence(f: Frames, a: dict[str, Any]) -> DataFrame:
    """Each frame of a run of occurrence that has lasted so many seconds; with 0 there is no event."""
    p = _pref(a, **_OCCURRENCE, TargetObjectNames=(settings._names, [], _any), MinDurationSec=(_whole, 3, _any))
    o = occurring(f, p, p["TargetObjectNames"]).withColumn("ts", f.ts())
    e = windows.lasting(o, "source_id", "frame_id", "ts", F.col("met"), p["MinDurationSec"])
    return e.select("source_id", "frame_id", messages.occurrence(F.col("labels"), F.lit(p["OccurrenceCheckRegionName"]), F.bround("duration").cast("int")).alias("message"))


def answered(f: Frames, requests: DataFrame, policy: str, wait_seconds: int) -> DataFrame:
    """requests (candidate_id, source_id, frame_id, and others) with status and result: the first answer in time decides, by whether it says that the
    objects occurred; a broken answer rejects."""
    if f.hooks.answers is None:
        raise ConfigError("the algorithm needs answers of a language model")
    c = requests.withColumn("deadline", f.us() + wait_seconds * 1_000_000)
    answers = f.hooks.answers(requests).withColumn("occurred", F.coalesce(scalars.decoded(F.col("result"), scalars.OCCURRED)["isObjOccurred"], F.lit(False)))
    r = answers.select("request_id", "candidate_id", F.col("completed_us").alias("completed"), "occurred", F.lit(False).alias("expired"), F.lit(True).alias("handled"))
    done = rules.reconciled(c, r, policy)
    return c.join(done, "candidate_id").join(answers.select("request_id", "completed_us", "result"), "request_id", "left").filter("published is not null")


def decided(f: Frames, frames: DataFrame, wait_seconds: int) -> DataFrame:
    """frames (candidate_id, source_id, frame_id, and others) with deadline and decided_us: when the candidate that a frame could make would be answered; null: not before its
    deadline."""
    if f.hooks.answers is None:
        raise ConfigError("the algorithm needs answers of a language model")
    c = frames.withColumn("deadline", f.us() + wait_seconds * 1_000_000)
    first = f.hooks.answers(frames.filter("met")).groupBy("candidate_id").agg(F.min("completed_us").alias("decided_us"))
    return c.join(first, "candidate_id", "left").withColumn("decided_us", F.when(F.col("decided_us") < F.col("deadline"), F.col("decided_us")))


_POLICIES = {"Drop": "drop", "PublishTraditional": "publish_traditional", "PublishUnknown": "publish_unknown", "Retry": "retry"}


@algorithm("ObjectOccurrenceByLLM")
def occurrence_confirmed(f: Frames, a: dict[str, Any]) -> DataFrame:
    """A candidate once a run has lasted so many frames, and again, in the same run, once the last one is decided: by an answer, from its frame on, or by the first frame past its
    deadline, from the next one on. Published when a language model confirms it, at the frame after its answer (unanswered ones by the policy, at their deadline)."""
    p = _pref(a, **_OCCURRENCE, TargetObjectNames=(settings._names, [], _any), MinDurationFrames=(_whole, 10, _any), CandidateEventTimeoutSeconds=(_whole, 12, _any), OnTimeout=(settings._one_of(*_POLICIES), "Drop", _any))
    o = occurring(f, p, p["TargetObjectNames"])
    wait, at_frame = p["CandidateEventTimeoutSeconds"], lambda c: F.ceil(c / (f.hooks.frame_ms * 1000)).cast("long")
    o = o.select(F.concat_ws("_", F.lit("occ"), "source_id", "frame_id").alias("candidate_id"), "source_id", "frame_id", "met")
    o = decided(f, o, wait).withColumn("decided", at_frame(F.coalesce("decided_us", F.col("deadline"))))
    c = folds.candidates(o, "source_id", "frame_id", F.col("met"), p["MinDurationFrames"], F.col("decided"), F.col("decided_us").isNull())
    done = answered(f, c.select("candidate_id", "source_id", "frame_id", "run_length"), _POLICIES[p["OnTimeout"]], wait)
    at = at_frame(F.coalesce("completed_us", "deadline"))
    targets = F.array(*map(F.lit, p["TargetObjectNames"]))
    return done.select("source_id", at.alias("frame_id"), messages.occurrence_confirmed(targets, F.lit(p["OccurrenceCheckRegionName"]), F.col("run_length")).alias("message"))


@algorithm("SequenceToImage", throttled=False)
def sequences(f: Frames, a: dict[str, Any]) -> DataFrame:
    """Of the frames with a target every stride-th is collected, and every so many make one picture, which a language model looks at."""
    p = _pref(a, TargetObjectNames=(settings._names, [], _any), SequenceLength=(_whole, 5, lambda x: x > 0), FrameStride=(_whole, 1, lambda x: x > 0), Layout=(_text, "Horizontal", _any), ModelName=(_text, "", _any), OnTimeout=(settings._one_of(*_POLICIES), "Drop", _any), RequestTtlSeconds=(_whole, 120, _any))
    has = f.dets.filter(F.col("label").isin(p["TargetObjectNames"])) if p["TargetObjectNames"] else f.dets
    r = windows.ranked(has.select("source_id", "frame_id").distinct(), "source_id", "frame_id", "n").filter((F.col("n") - 1) % p["FrameStride"] == 0).drop("n")
    g = windows.tumbling_count(r, "source_id", "frame_id", p["SequenceLength"]).groupBy("source_id", "batch_no").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("frame_id"))
    c = g.select(F.concat_ws("_", F.lit("seq"), "source_id", "batch_no").alias("candidate_id"), "source_id", "frame_id", "first")
    if f.hooks.answers is not None:
        c = answered(f, c, _POLICIES[p["OnTimeout"]], p["RequestTtlSeconds"])
    return c.select("source_id", "frame_id", messages.sequence(F.col("candidate_id"), F.col("first"), F.col("frame_id"), p["Layout"], F.lit(p["SequenceLength"]), p["ModelName"]).alias("message"))


@algorithm("RegionAccess", throttled=False)
def region_access(f: Frames, a: dict[str, Any]) -> DataFrame:
    """Objects under analysis of some types whose access state to an area has lasted so many frames, once a stay."""
    p = _pref(a, RegionName=(_text, "", _any), RegionRelativeTypes=(settings._names, [], _any), StateStabilityThreshold=(_whole, 3, _any))
    s = f.sightings.filter(F.col("under_analysis") & F.lower("label").isin(p["RegionRelativeTypes"])) if p["RegionRelativeTypes"] else f.sightings.limit(0)
    g = regions.geometry(s, f.dimension, p["RegionName"]).filter("geometry is not null").select("object_id", "source_id", "frame_id", "geometry")
    states = folds.access_states(g, "object_id", "frame_id", "geometry")
    stays = windows.stable(states, "object_id", "frame_id", "state", p["StateStabilityThreshold"]).filter("state <> 'Outside'")
    at = stays.join(g.select("object_id", "frame_id", "source_id"), ["object_id", "frame_id"])
    return at.select("source_id", "frame_id", messages.region_access(F.col("state"), F.col("object_id"), F.lit(p["RegionName"]), f.ts()).alias("message"))


@algorithm("SmugglingDetection")
def smuggling(f: Frames, a: dict[str, Any]) -> DataFrame:
    p = _pref(a, WidthBasedApproachFactor=(_number, 0.2, _any), MaxGatheringCount=(_whole, 3, _any), EventSustainSec=(_whole, 5, _any), HistoryLengthThresh=(_whole, 10, _any), DistanceIncreasePercentThresh=(_number, 0.7, _any), MovingAwayPercentThresh=(_number, 0.5, _any), PersonLabel=(_text, "person", _any), BoatLabel=(_text, "boat", _any))
    got = smuggling_alarms(f, p["WidthBasedApproachFactor"], max(1, p["MaxGatheringCount"]), max(1, p["EventSustainSec"]), max(2, p["HistoryLengthThresh"]), p["DistanceIncreasePercentThresh"], p["MovingAwayPercentThresh"], p["PersonLabel"].lower(), p["BoatLabel"].lower())
    return got.select("source_id", "frame_id", messages.smuggling(F.col("gathering_count"), F.col("person_count"), F.col("frame_id")).alias("message"))


def people_and_boat(f: Frames, history: int, share: float, person: str = "person", boat: str = "boat") -> DataFrame:
    """People under analysis of frames in which a boat's place is known, with moving_away; a boat's place is kept until another is seen. The corner (0, 0) stands for no place."""
    b = Box.of()
    known = rules.last_known(f.boats(boat), "source_id", "frame_id", F.col("b"), "b")
    p = f.analysed(person).join(known.filter("b is not null and not (b.bx = 0 and b.by = 0)"), ["source_id", "frame_id"])
    p = p.select("source_id", "frame_id", "object_id", "tracking_id", "x", "y", "w", "h", F.bround(b.cx).alias("px"), F.bround(b.cy).alias("py"), "b.*")
    return rules.moving_away(p, history, share)


def smuggling_alarms(f: Frames, factor: float, most: int, sustain: int, history: int, share: float, flee: float, person: str = "person", boat: str = "boat") -> DataFrame:
    """Frames at which a gathering, a boat and flight from it have all been seen of late."""
    g = rules.gatherings(f.kept(people_and_boat(f, history, share, person, boat), "people"), factor, most).groupBy("source_id", "frame_id")
    g = g.agg(F.bool_or(F.col("size") > most).alias("g"), F.bool_or(F.col("fleeing") / F.col("size") > flee).alias("a"), F.count("*").alias("gathering_count"), F.sum("size").alias("person_count"))
    s = f.boats(boat).select("source_id", "frame_id", F.col("b").isNotNull().alias("b"))
    s = s.join(f.kept(g, "gatherings"), ["source_id", "frame_id"], "left").fillna({"g": False, "a": False, "gathering_count": 0, "person_count": 0}).withColumn("ts", f.ts())
    last = {n: ("max", F.when(F.col(c), F.col("frame_id"))) for n, c in (("last_g", "g"), ("last_b", "b"), ("last_a", "a"))}
    s = windows.running(s, "source_id", "frame_id", last)
    lasts = lambda c, seconds: F.col("frame_id") * f.hooks.frame_ms < F.col(c) * f.hooks.frame_ms + seconds * 1000
    s = s.filter(lasts("last_g", sustain) & lasts("last_b", 2 * sustain) & lasts("last_a", sustain))
    incident = F.concat_ws("_", F.lit("smg"), "source_id", F.date_format("ts", "yyyyMMddHHmmssSSS"))
    return s.select("source_id", "frame_id", "ts", incident.alias("incident_id"), "gathering_count", "person_count")


def ship_evidence(f: Frames, stride: int, least_area: int) -> DataFrame:
    """Each boat's evidence when it expires: looked at when it is first seen and on every stride-th frame of its source; a known detail beats an unknown
    one, then confidence, then (of unknown ones) area. Small evidence gives no event."""
    labels = f.hooks.labels
    if labels is None:
        raise ConfigError("ship labels need a column of attributes")
    s = windows.sessions(f.sightings.filter(F.lower("label") == "boat"), f.settings.lifetime)
    looked = windows.ranked(f.numbers.distinct(), "source_id", "frame_id", "n").filter((F.col("n") - 1) % stride == 0).select("source_id", "frame_id", F.lit(True).alias("looked"))
    s = s.join(looked, ["source_id", "frame_id"], "left").withColumn("first", F.row_number().over(windows.over(["object_id", "session_no"], "frame_id")) == 1)
    s = s.filter("looked or first").withColumn("labels", labels)
    known = F.lower(F.col("labels")["detail"]) != "unknown"
    s = s.withColumn("life", F.concat_ws("#", "object_id", "session_no"))
    best = rules.best_evidence(s, "life", "frame_id", known, F.col("confidence"), F.col("w").cast("long") * F.col("h"), "source_id", "object_id", "confidence", "labels", "w", "h")
    best = best.withColumnRenamed("frame_id", "evidence_frame").filter(F.col("w").cast("long") * F.col("h") >= least_area)
    lives = windows.sessions(f.sightings.filter(F.lower("label") == "boat"), f.settings.lifetime).groupBy("source_id", "object_id", "session_no").agg(F.max("frame_id").alias("seen"))
    gone = lives.join(f.ends, "source_id").withColumn("frame_id", F.col("seen") + f.settings.lifetime).filter(F.col("frame_id") <= F.col("last_frame"))
    return gone.select(F.concat_ws("#", "object_id", "session_no").alias("life"), "frame_id").join(best, "life").select("source_id", "frame_id", "object_id", "evidence_frame", "confidence", "labels")


@algorithm("Labels", throttled=False)
def ship_labels(f: Frames, a: dict[str, Any]) -> DataFrame:
    p = _pref(a, Stride=(_whole, 5, lambda x: x > 0), MinImageAreaOfLabelEvent=(_whole, 50000, _any))
    e = ship_evidence(f, p["Stride"], p["MinImageAreaOfLabelEvent"])
    return e.select("source_id", "frame_id", messages.ship(F.col("object_id"), F.col("labels.group"), F.col("labels.detail"), F.col("labels.colours")).alias("message"))


@algorithm("LabelsByLLM", throttled=False)
def ship_labels_verified(f: Frames, a: dict[str, Any]) -> DataFrame:
    """A boat's label by a language model, published when the boat expires, or when a late answer comes in time after that."""
    p = _pref(a, Stride=(_whole, 10, lambda x: x > 0), ObjectExpiredWaitSeconds=(_whole, 8, _any))
    got = verified(f, p["Stride"], p["ObjectExpiredWaitSeconds"])
    return got.select("source_id", "frame_id", messages.ship_verified(F.col("object_id"), scalars.decoded(F.col("result"), scalars.SHIP)).alias("message"))


def verified(f: Frames, stride: int, wait_seconds: int) -> DataFrame:
    """source_id, object_id, frame_id, request_id, result of each boat's life that ends with a verified label."""
    if f.hooks.answers is None:
        raise ConfigError("the algorithm needs answers of a language model")
    looked = windows.ranked(f.numbers.distinct(), "source_id", "frame_id", "n").filter((F.col("n") - 1) % stride == 0).select("source_id", "frame_id", F.lit(True).alias("looked"))
    quality = evidence_quality(F.col("confidence"), Box.of(), views.WIDTH, views.HEIGHT)
    s = f.seen("boat").select("source_id", "object_id", "frame_id", quality.alias("quality")).join(looked, ["source_id", "frame_id"], "left")
    gap = F.lead("frame_id").over(windows.over("object_id", "frame_id")) - F.col("frame_id")
    s = windows.sessions(s.withColumn("last", F.coalesce(gap >= f.settings.lifetime, F.lit(True))), f.settings.lifetime)
    s = f.kept(s.select(F.concat_ws("#", "object_id", "session_no").alias("life"), "source_id", "object_id", "frame_id", F.coalesce("looked", F.lit(False)).alias("looked"), "quality", "last"), "lives")
    none = F.lit(None).cast("string")
    seen = s.select("life", "source_id", "object_id", "frame_id", f.us().alias("us"), F.lit(1).alias("turn"), "looked", "quality", none.alias("result"))
    ends = s.filter("last").join(f.ends, "source_id").withColumn("frame_id", F.col("frame_id") + f.settings.lifetime).filter(F.col("frame_id") <= F.col("last_frame"))
    ends = ends.select("life", none.alias("source_id"), none.alias("object_id"), "frame_id", f.us().alias("us"), F.lit(2).alias("turn"), F.lit(False).alias("looked"), F.lit(0.0).alias("quality"), none.alias("result"))
    # an answer's life and frame stand in the id of its candidate, so that it needs no join
    answers = f.hooks.answers(s.select(F.concat_ws("@", "life", "frame_id").alias("candidate_id"), "source_id", "frame_id")).select("candidate_id", "completed_us", "result")
    answers = answers.withColumn("asked", F.substring_index("candidate_id", "@", -1)).withColumn("life", F.left("candidate_id", F.length("candidate_id") - F.length("asked") - 1))
    answers = answers.withColumn("frame_id", F.col("asked").try_cast("long")).filter(F.concat_ws("@", "life", "frame_id") == F.col("candidate_id"))
    back = answers.select("life", none.alias("source_id"), none.alias("object_id"), "frame_id", F.col("completed_us").alias("us"), F.lit(0).alias("turn"), F.lit(False).alias("looked"), F.lit(0.0).alias("quality"), F.when(scalars.readable(F.col("result")), F.col("result")).alias("result"))
    return keyed.verified(seen.unionByName(ends).unionByName(back), wait_seconds * 1_000_000, f.hooks.frame_ms * 1000)


@algorithm("Classify")
def classified(f: Frames, a: dict[str, Any]) -> DataFrame:
    """Each new best snapshot of an object is classified."""
    if f.hooks.classes is None:
        raise ConfigError("the algorithm needs a column of classes")
    by = f.settings["Snapshot"]["BestSnapshotBy"]
    s = f.sightings.withColumn("score", scalars.score_factor(by, F.col("confidence"), F.col("w"), F.col("h"))).withColumn("class", f.hooks.classes)
    best = windows.running_best(s.select("source_id", "object_id", "frame_id", "score", "class"), "object_id", "frame_id", "score")
    return best.select("source_id", "frame_id", messages.classified(F.col("object_id"), F.col("class.label"), F.col("class.confidence")).alias("message"))


def bearers(f: Frames, bearer: str, part: str) -> DataFrame:
    """Pairs of a bearer under analysis and a part under analysis within it, of one frame, with the bearer's life."""
    s = f.sightings.filter("under_analysis")
    a = windows.sessions(s.filter(F.col("label") == bearer).select("source_id", "frame_id", F.col("object_id"), "confidence", "x", "y", "w", "h"), f.settings.lifetime)
    a = a.withColumnsRenamed({"object_id": "bearer", "confidence": "bearer_confidence"})
    b = s.filter(F.col("label") == part).select("source_id", "frame_id", F.col("object_id").alias("part"), F.col("confidence").alias("part_confidence"), *[F.col(c).alias(f"p_{c}") for c in "xywh"])
    return a.join(b, ["source_id", "frame_id"]).filter(Box.of().contains(Box.of("p_")) & (F.col("bearer") != F.col("part")))


def recognised(f: Frames, bearer: str, part: str, least: float) -> DataFrame:
    """Parts that are read: those of frames at which their bearer, with a part in it, is surer than ever before; text and score of each that is sure enough."""
    if f.hooks.text is None:
        raise ConfigError("the algorithm needs a column of texts")
    pairs = bearers(f, bearer, part)
    best = windows.running_best(pairs.select("bearer", "session_no", "frame_id", "bearer_confidence").distinct().withColumn("life", F.concat_ws("#", "bearer", "session_no")), "life", "frame_id", "bearer_confidence")
    read = pairs.join(best.select("bearer", "session_no", "frame_id"), ["bearer", "session_no", "frame_id"]).withColumn("read", f.hooks.text)
    return read.filter(F.col("read.score") >= least).select("source_id", "frame_id", "bearer", "part", "read.text", "read.score")


def plates(f: Frames, bearer: str, part: str, most: int = 3) -> DataFrame:
    """At each bearer's expiry its surest sighting and its surest parts, best first, then by id."""
    pairs = bearers(f, bearer, part)
    lives = windows.sessions(f.sightings.filter((F.col("label") == bearer) & F.col("under_analysis")).select("source_id", "object_id", "frame_id"), f.settings.lifetime).groupBy("source_id", F.col("object_id").alias("bearer"), "session_no").agg(F.max("frame_id").alias("seen"))
    gone = lives.join(f.ends, "source_id").withColumn("expired_at", F.col("seen") + f.settings.lifetime).filter(F.col("expired_at") <= F.col("last_frame"))
    sure = pairs.groupBy("bearer", "session_no").agg(F.max("bearer_confidence").alias("bearer_confidence"))
    parts = pairs.groupBy("bearer", "session_no", "part").agg(F.max("part_confidence").alias("part_confidence"))
    parts = parts.withColumn("place", F.row_number().over(windows.over(["bearer", "session_no"], F.desc("part_confidence"), "part"))).filter(F.col("place") <= most)
    return parts.join(sure, ["bearer", "session_no"]).join(gone.select("source_id", "bearer", "session_no", "expired_at"), ["bearer", "session_no"])


@algorithm("OCR", throttled=False)
def ocr(f: Frames, a: dict[str, Any]) -> DataFrame:
    p = _pref(a, OcrType=(_text, "sign", _any), OcrBearerType=(_text, "ship", _any), ScoreThresh=(_number, 0.5, _any))
    r = recognised(f, p["OcrBearerType"], p["OcrType"], p["ScoreThresh"])
    return r.select("source_id", "frame_id", F.concat(F.lit("'"), "bearer", F.lit("' contains '"), "part", F.lit("', content:"), "text").alias("message"))


@algorithm("MotionDetection")
def motion_events(f: Frames, a: dict[str, Any]) -> DataFrame:
    """Frames with any region of motion. Detections stand for the regions."""
    p = _pref(a, MinArea=(_whole, 0, _any), MaxArea=(_whole, 1 << 31, _any), AspectRatio=(_number, 1e9, _any), MaxContours=(_whole, 60, _any))
    g = f.dets.groupBy("source_id", "frame_id").agg(F.sort_array(F.collect_list(F.struct("x", "y", "w", "h"))).alias("r"))
    g = g.withColumn("n", F.size(motion.plausible(F.col("r"), p["MinArea"], p["MaxArea"], p["AspectRatio"], limit=p["MaxContours"])))
    return g.filter("n > 0").select("source_id", "frame_id", messages.motion(F.col("n")).alias("message"))


@algorithm("GenerateDebugAnnotations", throttled=False)
def debug_annotations(f: Frames, a: dict[str, Any]) -> DataFrame:
    """No event; annotations() gives what is drawn."""
    return f.dets.select("source_id", "frame_id", F.lit("").alias("message")).limit(0)


def annotations(f: Frames, a: dict[str, Any]) -> DataFrame:
    """source_id, frame_id and the shapes of each frame in drawing order: the source's regions, then every object under analysis with its text, as flags ask."""
    p = {"GenerateBBox": True, "GenerateObjText": True, "ObjTextShowLabel": True, "ObjTextShowTrackingId": True, "ObjTextShowConfidence": False, "GenerateAnalysisAreas": True, "GenerateExcludeAreas": True, "GenerateLanes": True, "GenerateInterestAreas": True, "GenerateCountLines": True}
    p = settings.preferences(a, {k: (settings._flag, v, _any) for k, v in p.items()})
    oid, b = F.col("object_id"), Box.of()
    text = shapes.object_text(F.col("label") if p["ObjTextShowLabel"] else None, F.col("tracking_id") if p["ObjTextShowTrackingId"] else None, F.col("confidence") if p["ObjTextShowConfidence"] else None)
    own = ([shapes.box_shape(oid, b)] if p["GenerateBBox"] else []) + ([shapes.text_shape(oid, b, text)] if p["GenerateObjText"] else [])
    none = F.filter(F.array(shapes.box_shape(F.lit(""), Box(*map(F.lit, (0, 0, 0, 0))))), lambda _: F.lit(False))
    objects = F.array(*own) if own else none
    each = F.when(F.col("under_analysis"), F.struct("object_id", objects.alias("s")))
    g = regions.placed(f.sightings.groupBy("source_id", "frame_id").agg(F.array_sort(F.collect_list(each)).alias("o")), f.dimension)
    points = lambda areas: F.transform(areas, lambda r: F.transform(r["edges"], lambda e: F.struct(e["ax"].cast("int").alias("x"), e["ay"].cast("int").alias("y"))))
    drawn = []
    for flag, part, name, colour in (("GenerateAnalysisAreas", "analysis", "AnalysisArea", "#7dda58"), ("GenerateExcludeAreas", "excluded", "ExcludedArea", "#e36667"), ("GenerateLanes", "lanes", "Lane", "#e8e8e8"), ("GenerateInterestAreas", "interest", "InterestArea", "#ffeca1")):
        if p[flag]:
            drawn.append(shapes.area_shapes(points(F.col(f"region.{part}")), name, shapes.style(stroke_color=colour)))
    if p["GenerateCountLines"]:
        ends = lambda s: F.array(F.struct(s["ax"].cast("int").alias("x"), s["ay"].cast("int").alias("y")), F.struct(s["bx"].cast("int").alias("x"), s["by"].cast("int").alias("y")))
        pairs = F.transform("region.lines", lambda c: F.struct(ends(c["enter"]).alias("one"), ends(c["leave"]).alias("other")))
        drawn.append(shapes.line_shapes(pairs, "CountLine", shapes.style(stroke_color="#4e4e4e")))
    drawn.append(F.flatten(F.transform("o", lambda x: x["s"])))
    return g.select("source_id", "frame_id", shapes.drawn(F.concat(*drawn)).alias("shapes"))


def run(dets: DataFrame, document: dict[str, Any], folder: str | Path, sink: Callable[[DataFrame], None] | list[Callable[[DataFrame], None]], hooks: Hooks | None = None) -> None:
    """Gives a pipeline's events to its sinks, in their order (artefacts, then the store, then the poster); one that fails stops those after it."""
    e = stored(dets, document, folder, hooks)
    for s in [sink] if callable(sink) else sink:
        s(e)

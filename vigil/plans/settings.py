"""The settings of a pipeline: a JSON document of thirteen sections. A section that is missing or of another kind raises ConfigError; a preference that
is missing, empty, malformed or out of its range takes its default. Preferences are texts, as people write them; numbers and flags do as well."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

Kind = Callable[[str], Any]


class ConfigError(ValueError):
    pass


def _flag(s: str) -> bool:
    if s.strip().lower() not in ("true", "false"):
        raise ValueError(s)
    return s.strip().lower() == "true"


def _number(s: str) -> float:
    if not math.isfinite(x := float(s)):
        raise ValueError(s)
    return x


def _names(s: str) -> list[str]:
    return [p.strip().lower() for p in s.split(",") if p]


def _whole(n: int) -> Kind:
    def read(s: str) -> tuple[int, ...]:
        got = tuple(int(p) for p in s.split(","))
        if len(got) != n:
            raise ValueError(s)
        return got

    return read


def _intervals(s: str) -> dict[str, int]:
    """name:seconds parts; one without a colon spoils all, one whose seconds aren't a number goes."""
    parts = [p.split(":", 1) for p in s.split(",") if p]
    if any(len(p) != 2 for p in parts):
        raise ValueError(s)
    return {k.strip(): int(v) for k, v in parts if v.strip().lstrip("+-").isdigit()}


def _one_of(*names: str) -> Kind:
    def read(s: str) -> str:
        found = [n for n in names if n.lower() == s.strip().lower()]
        if not found:
            raise ValueError(s)
        return found[0]

    return read


_share, _positive, _counting = (lambda x: 0 <= x <= 1), (lambda x: x > 0), (lambda x: x >= 0)
_any = lambda _: True
_text = str

#: Of each section the preferences with their kind, default and range.
PREFERENCES: dict[str, dict[str, tuple[Kind, Any, Callable[[Any], bool]]]] = {
    "VideoLoaders": {"SourceId": (_text, "Test-Camera", _any), "VideoUri": (_text, "", _any), "VideoStride": (int, 1, _positive), "MaxRetries": (int, 3, _positive), "RetryDelayMs": (int, 1000, _positive), "Loop": (_flag, False, _any)},
    "InputFrameBuffer": {"BufferName": (_text, "video-buffer", _any), "BufferSize": (int, 300, _counting), "Mode": (_one_of("BlockingWait", "ReturnBlankFrame"), "BlockingWait", _any)},
    "OutputFrameBuffer": {"BufferName": (_text, "video-buffer", _any), "BufferSize": (int, 300, _counting), "Mode": (_one_of("BlockingWait", "ReturnBlankFrame"), "BlockingWait", _any)},
    "Detector": {
        "ClassNum": (int, 80, _positive), "ConfThresh": (_number, 0.25, _share), "IouThresh": (_number, 0.5, _share), "TargetTypes": (_names, [], _any), "DetectionStride": (int, 1, _positive),
        "FilterSmallObject": (_flag, False, _any), "MinBboxWidth": (int, 40, _counting), "MinBboxHeight": (int, 40, _counting), "FilterLargeObject": (_flag, False, _any), "MaxBboxWidth": (int, 300, _counting), "MaxBboxHeight": (int, 300, _counting),
        "RegionDetectionEnabled": (_flag, False, _any), "DetectionRegion": (_whole(4), (0, 0, 1, 1), _any), "TileDetectionEnabled": (_flag, False, _any), "TileDetectionSize": (_whole(2), (1, 1), _any),
        "MaxStitchGapPixel": (int, 2, _counting), "MinVerticalOverlapRatio": (_number, 0.9, _share), "WillSuppressInnerSameObject": (_flag, False, _any), "InnerObjectOverlapRatio": (_number, 0.8, _share),
        "WillMapObjectTypes": (_flag, False, _any), "SourceObjectTypeNames": (_names, [], _any), "DestinationObjectTypeName": (_text, "", _any), "Names": (_names, [], _any),
    },
    "RegionManager": {"SourceId": (_text, "Test-Camera", _any), "RegionDefinitionFile": (_text, "default-region.json", _any)},
    "Tracker": {"IouThreshold": (_number, 0.3, _share), "MaxMisses": (int, 3, _counting), "TargetConfidence": (_number, 0.4, _share), "AppearanceWeight": (_number, 0.5, _share), "FramesToAppearanceSmooth": (int, 100, _positive), "SmoothAppearanceWeight": (_number, 0.9, _share), "MinStreak": (int, 3, _counting)},
    "Snapshot": {
        "SnapshotsDir": (_text, "Snapshots", _any), "SaveBestSnapshot": (_flag, False, _any), "BestSnapshotBy": (_one_of("confidence", "area", "width", "height"), "confidence", _any), "SnapshotExpansionRatio": (_number, 1.2, lambda x: x > 1), "MaxSnapshots": (int, 10, _positive),
        "MinSnapshotWidth": (int, 40, _positive), "MinSnapshotHeight": (int, 40, _positive), "SnapshotRetentionDays": (int, 3, _positive), "VideoClipDurationSeconds": (int, 10, _positive), "VideoFrameRate": (_number, 25.0, _positive),
    },
    "MessagePoster": {"WillPostMessage": (_flag, True, _any), "DestinationUrl": (_text, "http://127.0.0.1/event", _any), "CheckDuplicateEvent": (_flag, False, _any), "EventSuppressionIntervals": (_intervals, {}, _any)},
    "EventRepository": {"RdbConnectionString": (_text, "", _any), "StorageUrl": (_text, "", _any), "WillStoreSnapshot": (_flag, True, _any), "WillStoreVideoClip": (_flag, False, _any)},
    "AnnotationSender": {"EnableAnnotationUdpSender": (_flag, False, _any), "AnnotationUdpDestinationHost": (_text, "127.0.0.1", _any), "AnnotationUdpDestinationPort": (int, 9999, lambda x: 0 < x < 65536)},
    "AnnotationRender": {"DefaultStyleFile": (_text, "default-style.json", _any)},
}
#: Sections that are lists of components.
LISTS = ("VideoLoaders", "RegionManager", "Algorithms")
#: What an algorithm's events have in common.
COMMON = {"EventName": (_text, "UnknownEvent", _any), "LocalEventIntervalSec": (int, 1, _counting), "WillPublishEventMessage": (_flag, True, _any), "WillSaveEventSnapshot": (_flag, True, _any), "EventSnapshotDir": (_text, "Events", _any), "PerformLLMAnalysis": (_flag, False, _any)}


def preferences(given: dict[str, Any] | None, known: dict[str, tuple[Kind, Any, Callable[[Any], bool]]]) -> dict[str, Any]:
    """All known preferences; others are kept as they are."""
    given = dict(given or {})
    out = {}
    for name, (kind, default, good) in known.items():
        raw = given.pop(name, None)
        raw = str(raw).lower() if isinstance(raw, bool) else "" if raw is None else str(raw)
        try:
            value = kind(raw) if raw else default
            out[name] = value if raw and good(value) else default
        except (ValueError, TypeError):
            out[name] = default
    return {**given, **out}


@dataclass(frozen=True)
class Component:
    """kind: which plug-in; it is looked up by the last word of the name that isn't Executor."""

    kind: str
    of: dict[str, Any] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Any:
        return self.of[name]


@dataclass(frozen=True)
class Settings:
    lifetime: int
    sections: dict[str, Any]

    def __getitem__(self, section: str) -> Any:
        return self.sections[section]


def _component(section: str, raw: Any) -> Component:
    if not isinstance(raw, dict):
        raise ConfigError(f"{section} settings corrupted")
    words = [w for w in str(raw.get("FullQualifiedClassName", raw.get("Class", ""))).split(".") if w and w != "Executor"]
    kind = words[-1] if words else ""
    return Component(kind, preferences(raw.get("Preferences"), PREFERENCES.get(section, COMMON)))


def parse(document: dict[str, Any]) -> Settings:
    pipeline = document.get("Pipeline")
    if not isinstance(pipeline, dict):
        raise ConfigError("Pipeline settings corrupted")
    sections: dict[str, Any] = {}
    for name in (*PREFERENCES, "Algorithms"):
        raw = document.get(name)
        if name in LISTS:
            if not isinstance(raw, list):
                raise ConfigError(f"{name} settings corrupted")
            sections[name] = [_component(name, r) for r in raw]
        else:
            sections[name] = _component(name, raw)
    lifetime = preferences(pipeline, {"FrameLifetime": (int, 300, _positive)})["FrameLifetime"]
    return Settings(lifetime, sections)

"""Registered queries of the stream-analytics operators, each with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions import messages, scalars
from vigil.functions.geometry import Box, crosses, evidence_quality
from vigil.operators import folds, windows
from vigil.sources import regions, views
from vigil.sources.views import DETECTIONS_SQL, SIGHTINGS_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Each source's region file; the last one is missing, so that the default file holds for its source.
_FILES = Path(__file__).parent / "regions"
REGIONS = regions.rows_of({f"cam-{i}": _FILES / f"cam-{i}.json" for i in range(4)}, views.WIDTH, views.HEIGHT, _FILES / "default.json")
WATCH = "watch"  # the interest area that each source has
_CX, _CY = "(x + w / 2.0)", "(y + h / 2.0)"
_EDGES = regions.edges_sql(REGIONS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def dimension(spark: SparkSession) -> DataFrame:
    return regions.dimension(spark, REGIONS)


def _tagged(dets: DataFrame) -> DataFrame:
    return regions.tagged(dets, dimension(dets.sparkSession))


#: tagged: the detections with their regions; tsight: the sightings with theirs.
_TAGGED_SQL = f"{_EDGES}, {regions.tagged_sql('det', 'tagged')}"
_TSIGHT_SQL = f"{_EDGES}, {regions.tagged_sql('sight', 'tsight')}"


def _density(spark: SparkSession, d: str) -> DataFrame:
    """Objects of a label under analysis in the watched area, per frame, with zeros."""
    return _tagged(views.detections(spark, d)).groupBy("source_id", "frame_id").agg(F.count_if((F.lower("label") == "person") & F.col("under_analysis") & regions.in_area(WATCH)).alias("n"))


_DENSITY_SQL = f"WITH {DETECTIONS_SQL}, {_TAGGED_SQL}, dens AS (SELECT source_id, frame_id, count(*) FILTER (label = 'person' AND under_analysis AND list_contains(areas, 'watch')) AS n FROM tagged GROUP BY ALL)"


@query(_DENSITY_SQL + " SELECT source_id, frame_id, n, 'person number: ' || n || ' in detection region:watch, exceed max thresh: 1.' AS message FROM dens WHERE n > 1")
def density_events(spark, d):
    return _density(spark, d).filter("n > 1").select("source_id", "frame_id", "n", messages.density(F.lit("person"), F.col("n"), F.lit(WATCH), F.lit(1)).alias("message"))


@query(_DENSITY_SQL + " SELECT source_id, frame_id, n, max(n) OVER (PARTITION BY source_id ORDER BY frame_id) AS max_n FROM dens")
def density_running_max(spark, d):
    return windows.running(_density(spark, d), "source_id", "frame_id", {"max_n": ("max", F.col("n"))})


@query(f"WITH {DETECTIONS_SQL} SELECT source_id, frame_id, x, y, w, h, x + w AS xmax, y + h AS ymax, {_CX} AS cx, {_CY} AS cy, w::BIGINT * h AS area, 2 * (w + h) AS perimeter, w = h AS is_square, x / 1920.0 AS nx, y / 1080.0 AS ny FROM det")
def bbox_derived(spark, d):
    b = Box.of()
    return views.detections(spark, d).select("source_id", "frame_id", "x", "y", "w", "h", b.xmax.alias("xmax"), b.ymax.alias("ymax"), b.cx.alias("cx"), b.cy.alias("cy"), b.area.alias("area"), b.perimeter.alias("perimeter"), (b.w == b.h).alias("is_square"), (b.x / 1920.0).alias("nx"), (b.y / 1080.0).alias("ny"))


@query(f"WITH {DETECTIONS_SQL} SELECT source_id || '|' || frame_id || '|' || label || '|' || x || ',' || y || ',' || w || ',' || h AS detection_key, source_id || '|' || tracking_id AS track_key, source_id || '_' || label || '_' || tracking_id AS id FROM det")
def identity_keys(spark, d):
    return views.detections(spark, d).select(F.concat_ws("|", "source_id", "frame_id", "label", F.concat_ws(",", "x", "y", "w", "h")).alias("detection_key"), F.concat_ws("|", "source_id", "tracking_id").alias("track_key"), F.concat_ws("_", "source_id", "label", "tracking_id").alias("id"))


@query(f"WITH {DETECTIONS_SQL} SELECT source_id, frame_id, CASE WHEN label IN ('car', 'boat') THEN 'vehicle' ELSE label END AS label, confidence, x, y, w, h FROM det WHERE label IN ('person', 'boat') AND w <= 180 AND h <= 180 AND w >= 40 AND h >= 40 AND confidence >= 0.4")
def filter_chain(spark, d):
    df = views.detections(spark, d).filter(F.lower("label").isin("person", "boat") & (F.col("w") <= 180) & (F.col("h") <= 180) & (F.col("w") >= 40) & (F.col("h") >= 40) & (F.col("confidence") >= 0.4))
    return df.select("source_id", "frame_id", F.when(F.col("label").isin("car", "boat"), "vehicle").otherwise(F.col("label")).alias("label"), "confidence", "x", "y", "w", "h")


@query(f"WITH {DETECTIONS_SQL}, {_TAGGED_SQL} SELECT source_id, frame_id, label, x, y, w, h, under_analysis, lane, array_to_string(areas, ',') AS areas FROM tagged")
def region_tagging(spark, d):
    """By each source's own definition: quadrilaterals, a hollow polygon, several areas, and the default file."""
    return _tagged(views.detections(spark, d)).select("source_id", "frame_id", "label", "x", "y", "w", "h", "under_analysis", "lane", F.array_join("areas", ",").alias("areas"))


@query(f"WITH {SIGHTINGS_SQL}, {_TSIGHT_SQL}, g AS (SELECT object_id, frame_id, under_analysis AS u, retain, coalesce((frame_id - lag(frame_id) OVER (PARTITION BY object_id ORDER BY frame_id) >= 50)::INT, 0) AS g FROM tsight), n AS (SELECT *, sum(g) OVER (PARTITION BY object_id ORDER BY frame_id) AS session_no FROM g) SELECT object_id, frame_id, u OR retain AND max(u::INT) OVER (PARTITION BY object_id, session_no ORDER BY frame_id) = 1 AS under_analysis FROM n")
def region_retain(spark, d):
    """Once under analysis an object stays so until it expires, where its source's definition says so."""
    return regions.retained(_tagged(views.sightings(views.detections(spark, d))), 50).select("object_id", "frame_id", "under_analysis")


_PAIR = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))::BIGINT * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(f"WITH {SIGHTINGS_SQL}, p AS (SELECT a.source_id, a.frame_id, a.object_id AS one, b.object_id AS other, {_PAIR} AS i, a.w::BIGINT * a.h AS aa, b.w::BIGINT * b.h AS ba FROM sight a JOIN sight b ON a.source_id = b.source_id AND a.frame_id = b.frame_id AND a.object_id < b.object_id) SELECT source_id, frame_id, one, other, i / (aa + ba - i) AS iou, i / least(aa, ba) AS iof FROM p WHERE i > 0")
def overlapping_pairs(spark, d):
    s = views.sightings(views.detections(spark, d)).select("source_id", "frame_id", "object_id", "x", "y", "w", "h")
    o = s.select("source_id", "frame_id", *[F.col(c).alias(f"o_{c}") for c in ("object_id", "x", "y", "w", "h")])
    a, b = Box.of(), Box.of("o_")
    return s.join(o, ["source_id", "frame_id"]).filter((F.col("object_id") < F.col("o_object_id")) & (a.intersection(b) > 0)).select("source_id", "frame_id", F.col("object_id").alias("one"), F.col("o_object_id").alias("other"), a.iou(b).alias("iou"), a.iof(b).alias("iof"))


_OCC = f"WITH {SIGHTINGS_SQL}, {_TSIGHT_SQL}, occ AS (SELECT * FROM tsight WHERE under_analysis AND list_contains(areas, 'watch'))"


@query(f"{_OCC}, f AS (SELECT DISTINCT source_id, frame_id FROM sight), m AS (SELECT DISTINCT a.source_id, a.frame_id FROM occ a JOIN occ b ON a.source_id = b.source_id AND a.frame_id = b.frame_id AND a.label = 'person' AND b.label = 'boat' WHERE sqrt(pow(a.x + a.w / 2.0 - b.x - b.w / 2.0, 2) + pow(a.y + a.h / 2.0 - b.y - b.h / 2.0, 2)) < 4 * a.w) SELECT f.*, m.frame_id IS NOT NULL AS proximity_met FROM f LEFT JOIN m USING (source_id, frame_id)")
def proximity_occurrence(spark, d):
    """Per frame, in one aggregation: does any person that occurs stand near any boat that does? Arrays of a frame, no pair rows."""
    occurs = F.col("under_analysis") & regions.in_area(WATCH)
    box = lambda label: F.collect_list(F.when((F.col("label") == label) & occurs, Box.of().struct()))
    near = F.exists("people", lambda p: F.exists("boats", lambda b: Box(p["x"], p["y"], p["w"], p["h"]).centre_distance(Box(b["x"], b["y"], b["w"], b["h"])) < 4 * p["w"]))
    return _tagged(views.sightings(views.detections(spark, d))).groupBy("source_id", "frame_id").agg(box("person").alias("people"), box("boat").alias("boats")).select("source_id", "frame_id", near.alias("proximity_met"))


@query(f"{_OCC}, p AS (SELECT a.source_id, a.frame_id, a.object_id AS one, b.object_id AS other FROM occ a JOIN occ b ON a.source_id = b.source_id AND a.frame_id = b.frame_id AND a.label = 'person' AND b.label = 'boat' WHERE sqrt(pow(a.x + a.w / 2.0 - b.x - b.w / 2.0, 2) + pow(a.y + a.h / 2.0 - b.y - b.h / 2.0, 2)) < 4 * a.w) SELECT source_id, frame_id, one AS object_id, max(other) AS partner FROM p GROUP BY ALL UNION ALL SELECT source_id, frame_id, other, max(one) FROM p GROUP BY ALL")
def proximity_partners(spark, d):
    """Each person and boat of a near pair with its partner, of several the last by id."""
    s = _tagged(views.sightings(views.detections(spark, d))).filter(F.col("under_analysis") & regions.in_area(WATCH)).select("source_id", "frame_id", "label", "object_id", "x", "y", "w", "h")
    o = s.filter("label = 'boat'").select("source_id", "frame_id", *[F.col(c).alias(f"o_{c}") for c in ("object_id", "x", "y", "w", "h")])
    near = s.filter("label = 'person'").join(o, ["source_id", "frame_id"]).filter(Box.of().centre_distance(Box.of("o_")) < 4 * F.col("w"))
    both = near.select("source_id", "frame_id", F.explode(F.array(F.struct(F.col("object_id").alias("a"), F.col("o_object_id").alias("b")), F.struct(F.col("o_object_id").alias("a"), F.col("object_id").alias("b")))).alias("p"))
    return both.groupBy("source_id", "frame_id", F.col("p.a").alias("object_id")).agg(F.max("p.b").alias("partner"))


def occurrence(tagged: DataFrame, targets: list[str], area: str) -> DataFrame:
    """Per frame: any_of (a target under analysis lies in the area), all_of (there are targets under analysis, and each lies there), labels (those that
    occur, sorted; none: all targets)."""
    target = F.col("under_analysis") & F.lower("label").isin(targets)
    inside = regions.in_area(area)
    g = tagged.groupBy("source_id", "frame_id").agg(F.count_if(target).alias("n"), F.count_if(target & inside).alias("k"), F.array_sort(F.collect_set(F.when(target & inside, F.lower("label")))).alias("s"))
    return g.select("source_id", "frame_id", (F.col("k") > 0).alias("any_of"), ((F.col("n") > 0) & (F.col("k") == F.col("n"))).alias("all_of"), F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(*map(F.lit, targets))).alias("labels"))


_OCCURRENCE_SQL = f"WITH {DETECTIONS_SQL}, {_TAGGED_SQL}, t AS (SELECT *, under_analysis AND label IN ('boat', 'car') AS target, list_contains(areas, 'watch') AS inside FROM tagged), occ AS (SELECT source_id, frame_id, bool_or(target AND inside) AS any_of, bool_or(target) AND bool_and(inside OR NOT target) AS all_of, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (target AND inside)), ', '), 'boat, car') AS labels FROM t GROUP BY ALL)"


@query(_OCCURRENCE_SQL + " SELECT * FROM occ")
def label_occurrence(spark, d):
    return occurrence(_tagged(views.detections(spark, d)), ["boat", "car"], WATCH).withColumn("labels", F.array_join("labels", ", "))


@query(_OCCURRENCE_SQL + """, i AS (SELECT *, sum((NOT any_of)::INT) OVER (PARTITION BY source_id ORDER BY frame_id) AS g FROM occ), s AS (SELECT *, (frame_id - min(frame_id) OVER (PARTITION BY source_id, g)) / 10.0 AS duration FROM i WHERE any_of)
 SELECT source_id, frame_id, duration::DOUBLE AS duration, 'Objects: ' || labels || ' have occurred in region:watch for ' || round_even(duration, 0)::INT || ' seconds.' AS message FROM s WHERE duration >= 1""")
def occurrence_by_seconds(spark, d):
    """Every frame of a run of occurrence that has lasted a second or more. A frame stands for 100 ms."""
    o = occurrence(_tagged(views.detections(spark, d)), ["boat", "car"], WATCH).withColumn("ts", F.timestamp_millis(F.col("frame_id") * 100))
    e = windows.lasting(o, "source_id", "frame_id", "ts", F.col("any_of"), 1)
    return e.select("source_id", "frame_id", "duration", messages.occurrence(F.col("labels"), F.lit(WATCH), F.bround("duration").cast("int")).alias("message"))


@query(f"WITH {SIGHTINGS_SQL}, e AS (SELECT source_id, max(frame_id) AS last_frame FROM sight GROUP BY 1), n AS (SELECT *, lead(frame_id) OVER (PARTITION BY object_id ORDER BY frame_id) AS nx FROM sight) SELECT n.source_id, object_id, frame_id, frame_id + 50 AS expired_at FROM n JOIN e USING (source_id) WHERE (nx IS NULL OR nx - frame_id >= 50) AND frame_id + 50 <= last_frame")
def object_expiry(spark, d):
    s = views.sightings(views.detections(spark, d)).select("source_id", "object_id", "frame_id")
    return windows.expiry(s, 50, s.groupBy("source_id").agg(F.max("frame_id").alias("last_frame")))


@query(f"WITH {SIGHTINGS_SQL}, n AS (SELECT object_id, frame_id, coalesce((frame_id - lag(frame_id) OVER (PARTITION BY object_id ORDER BY frame_id) >= 50)::INT, 0) AS g FROM sight), s AS (SELECT *, sum(g) OVER (PARTITION BY object_id ORDER BY frame_id) AS session_no FROM n) SELECT object_id, session_no::BIGINT AS session_no, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(*) AS frames, sha256(object_id || '|' || session_no::BIGINT) AS stable_id FROM s GROUP BY object_id, session_no")
def object_sessions(spark, d):
    s = windows.sessions(views.sightings(views.detections(spark, d)).select("object_id", "frame_id"), 50)
    return s.groupBy("object_id", "session_no").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count("*").alias("frames")).withColumn("stable_id", F.sha2(F.concat_ws("|", "object_id", "session_no"), 256))


@query(f"WITH {SIGHTINGS_SQL}, b AS (SELECT object_id, frame_id, confidence, max(confidence) OVER (PARTITION BY object_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sight) SELECT object_id, frame_id, confidence FROM b WHERE m IS NULL OR confidence > m")
def best_snapshots(spark, d):
    return windows.running_best(views.sightings(views.detections(spark, d)).select("object_id", "frame_id", "confidence"), "object_id", "frame_id", "confidence")


@query(f"WITH {SIGHTINGS_SQL}, l AS (SELECT object_id, w * h AS score, max(frame_id) AS frame_id FROM sight GROUP BY 1, 2) SELECT object_id, score, frame_id, row_number() OVER (PARTITION BY object_id ORDER BY score DESC) AS rank FROM l QUALIFY rank <= 5")
def top_snapshots(spark, d):
    return windows.top_scores(views.sightings(views.detections(spark, d)).select("object_id", "frame_id", (F.col("w") * F.col("h")).alias("score")), "object_id", "frame_id", "score", 5).select("object_id", "score", "frame_id", "rank")


@query(f"WITH {DETECTIONS_SQL}, o AS (SELECT source_id, frame_id, bool_or(label = 'boat') AS occ FROM det GROUP BY ALL), i AS (SELECT *, sum((NOT occ)::INT) OVER (PARTITION BY source_id ORDER BY frame_id) AS g FROM o) SELECT source_id, frame_id, min(frame_id) OVER (PARTITION BY source_id, g) AS run_start, row_number() OVER (PARTITION BY source_id, g ORDER BY frame_id) AS run_length FROM i WHERE occ")
def occurrence_runs(spark, d):
    o = views.detections(spark, d).groupBy("source_id", "frame_id").agg(F.bool_or(F.col("label") == "boat").alias("occ"))
    return windows.runs(o, "source_id", "frame_id", F.col("occ")).filter("occ").select("source_id", "frame_id", "run_start", "run_length")


@query(f"WITH {SIGHTINGS_SQL}, {_TSIGHT_SQL}, s AS (SELECT object_id, frame_id, under_analysis AS st FROM tsight), c AS (SELECT *, coalesce((st <> lag(st) OVER (PARTITION BY object_id ORDER BY frame_id))::INT, 0) AS ch FROM s), g AS (SELECT *, sum(ch) OVER (PARTITION BY object_id ORDER BY frame_id) AS isl FROM c) SELECT object_id, frame_id, st AS state FROM g QUALIFY row_number() OVER (PARTITION BY object_id, isl ORDER BY frame_id) = 3")
def state_stability(spark, d):
    s = _tagged(views.sightings(views.detections(spark, d))).select("object_id", "frame_id", F.col("under_analysis").alias("state"))
    return windows.stable(s, "object_id", "frame_id", "state", 3)


@query(f"WITH {DETECTIONS_SQL}, f AS (SELECT source_id, frame_id FROM det WHERE label = 'person' GROUP BY ALL), n AS (SELECT *, (row_number() OVER (PARTITION BY source_id ORDER BY frame_id) - 1) // 5 AS batch_no FROM f) SELECT source_id, batch_no, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM n GROUP BY 1, 2 HAVING count(*) = 5")
def sequence_batches(spark, d):
    f = views.detections(spark, d).filter("label = 'person'").select("source_id", "frame_id").distinct()
    return windows.tumbling_count(f, "source_id", "frame_id", 5).groupBy("source_id", "batch_no").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))


@query(f"WITH {DETECTIONS_SQL}, f AS (SELECT source_id, frame_id, row_number() OVER (PARTITION BY source_id ORDER BY frame_id) AS r FROM (SELECT DISTINCT source_id, frame_id FROM det)) SELECT a.source_id, a.frame_id AS anchor, b.frame_id FROM f a JOIN f b ON a.source_id = b.source_id AND b.r BETWEEN a.r - 3 AND a.r + 3 WHERE a.frame_id % 100 = 0")
def video_clips(spark, d):
    f = views.detections(spark, d).select("source_id", "frame_id").distinct()
    return windows.clip(f, f.filter("frame_id % 100 = 0"), windows.clip_half(0.7, 10))


@query(f"WITH {DETECTIONS_SQL}, f AS (SELECT source_id, frame_id, row_number() OVER (PARTITION BY source_id ORDER BY frame_id) AS n FROM (SELECT DISTINCT source_id, frame_id FROM det)) SELECT source_id, frame_id FROM f WHERE n % 3 = 0")
def frame_stride(spark, d):
    return views.stride(views.detections(spark, d).select("source_id", "frame_id").distinct(), 3)


@query(f"WITH {DETECTIONS_SQL}, f AS (SELECT DISTINCT source_id, frame_id FROM det), r AS (SELECT source_id, unnest(range(min(frame_id), max(frame_id) + 1)) AS frame_id FROM f GROUP BY 1) SELECT r.*, f.frame_id IS NULL AS is_blank FROM r LEFT JOIN f USING (source_id, frame_id)")
def blank_frames(spark, d):
    return views.gap_fill(views.detections(spark, d).select("source_id", "frame_id").distinct())


_EVENTS = "WITH e AS (SELECT event_id, epoch_us(ts) AS us, user_id AS object_id, event_type AS event_name, value AS score, props FROM events)"


@query(f"""WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS us, event_type FROM events), r(event_type, us) AS (SELECT event_type, min(us) FROM e GROUP BY 1
 UNION ALL SELECT r.event_type, (SELECT min(us) FROM e WHERE e.event_type = r.event_type AND e.us >= r.us + 3000000000) FROM r WHERE r.us IS NOT NULL) SELECT r.event_type AS event_name, r.us FROM r WHERE r.us IS NOT NULL""")
def throttled_events(spark, d):
    e = views.object_stream(spark, d).select("event_name", F.unix_micros("ts").alias("us"))
    return folds.throttle(e, "event_name", "us", 3_000_000_000)


@query(_EVENTS + ", f AS (SELECT *, max(us) FILTER (event_name = 'click') OVER w AS a, max(us) FILTER (event_name = 'view') OVER w AS b FROM e WINDOW w AS (PARTITION BY object_id ORDER BY us ROWS UNBOUNDED PRECEDING)) SELECT event_id, coalesce(us < a + 3600000000, false) AS gathering, coalesce(us < b + 7200000000, false) AS boat, coalesce(us < a + 3600000000, false) AND coalesce(us < b + 7200000000, false) AS alarm FROM f")
def ttl_flags(spark, d):
    e = windows.ttl_flags(views.object_stream(spark, d), "object_id", "ts", {"gathering": (F.col("event_name") == "click", 3600), "boat": (F.col("event_name") == "view", 7200)})
    return e.select("event_id", "gathering", "boat", (F.col("gathering") & F.col("boat")).alias("alarm"))


@query(_EVENTS + " SELECT object_id, round(list_reduce(list(score ORDER BY us), lambda a, x: a * 0.9 + x * 0.1), 6) AS ema, min(score) AS low, max(score) AS high, sum(score)::DECIMAL(30, 4)::DOUBLE AS total, count(*) AS n, round(count(*) / ((max(us) - min(us)) / 1000000.0 + 1), 9) AS rate FROM e GROUP BY 1")
def score_ema(spark, d):
    """Exponential average, least, most, total, number and rate by second of an object's scores."""
    e = views.object_stream(spark, d)
    span = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6 + 1
    g = e.groupBy("object_id").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("score").cast("decimal(30,4)").cast("double").alias("total"), F.count("*").alias("n"), F.round(F.count("*") / span, 9).alias("rate"))
    return g.join(folds.ema_by(e, "object_id", "ts", "score", 0.1).withColumn("ema", F.round("ema", 6)), "object_id")


@query(f"WITH {SIGHTINGS_SQL}, m AS (SELECT *, 0.60 * confidence + 0.25 * (w::BIGINT * h / 2073600.0) + 0.15 * greatest(0, least(1, 1 - sqrt(pow({_CX} - 960, 2) + pow({_CY} - 540, 2)) / sqrt(960.0 * 960 + 540 * 540))) AS q FROM sight) SELECT object_id, max(q) AS quality, max(confidence) AS confidence FROM m GROUP BY 1")
def evidence_by_object(spark, d):
    return views.sightings(views.detections(spark, d)).withColumn("q", evidence_quality(F.col("confidence"), Box.of(), 1920, 1080)).groupBy("object_id").agg(F.max("q").alias("quality"), F.max("confidence").alias("confidence"))


@query(f"WITH {DETECTIONS_SQL}, g AS (SELECT source_id, frame_id, label, count(*) AS n, sum(w::BIGINT * h) AS a FROM det GROUP BY ALL), m AS (SELECT source_id, frame_id, label FROM g QUALIFY row_number() OVER (PARTITION BY source_id, frame_id ORDER BY n DESC, a DESC, label) = 1), b AS (SELECT source_id, frame_id, max(confidence) AS confidence, avg(confidence) AS mean_confidence, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM det GROUP BY ALL) SELECT * FROM b JOIN m USING (source_id, frame_id)")
def merged_boxes(spark, d):
    """Per frame: the box around all, extreme and mean confidence, the label of most boxes, then most area."""
    g = views.detections(spark, d).groupBy("source_id", "frame_id", "label").agg(F.count("*").alias("n"), F.sum(Box.of().area).alias("a"), F.max("confidence").alias("c"), F.sum("confidence").alias("s"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
    return g.groupBy("source_id", "frame_id").agg(F.max("c").alias("confidence"), (F.sum("s") / F.sum("n")).alias("mean_confidence"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("r") - F.min("x")).alias("w"), (F.max("b") - F.min("y")).alias("h"), F.min_by("label", F.struct(-F.col("n"), -F.col("a"), "label")).alias("label"))


@query(f"WITH {SIGHTINGS_SQL}, s AS (SELECT object_id, frame_id, {_CX} AS bx, lag({_CX}) OVER (PARTITION BY object_id ORDER BY frame_id) AS ax FROM sight) SELECT object_id, frame_id FROM s WHERE ax IS NOT NULL AND bx <> ax AND (ax - 800) * (bx - 800) <= 0")
def line_crossings(spark, d):
    """Steps of an object over the upright line x = 800."""
    b = Box.of()
    w = windows.over("object_id", "frame_id")
    s = views.sightings(views.detections(spark, d)).select("object_id", "frame_id", b.cx.alias("bx"), b.cy.alias("by"), F.lag(b.cx).over(w).alias("ax"), F.lag(b.cy).over(w).alias("ay"))
    return s.filter(F.col("ax").isNotNull() & crosses(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), (800, -1e5, 800, 1e5))).select("object_id", "frame_id")


@query(f"WITH {DETECTIONS_SQL}, p AS (SELECT *, round_even(w * 0.1, 0)::INT AS px, round_even(h * 0.1, 0)::INT AS py FROM det) SELECT source_id, frame_id, x, y, w, h, greatest(0, x - px) AS crop_x, greatest(0, y - py) AS crop_y, least(1920, x + w + px) - greatest(0, x - px) AS crop_w, least(1080, y + h + py) - greatest(0, y - py) AS crop_h FROM p")
def padded_crops(spark, d):
    c = Box.of().padded(0.1, 1920, 1080)
    return views.detections(spark, d).select("source_id", "frame_id", "x", "y", "w", "h", c.x.alias("crop_x"), c.y.alias("crop_y"), c.w.alias("crop_w"), c.h.alias("crop_h"))


@query(f"WITH {SIGHTINGS_SQL} SELECT a.source_id, a.frame_id, a.object_id AS bearer, b.object_id AS part, row_number() OVER (PARTITION BY a.object_id, a.frame_id ORDER BY b.confidence DESC, b.object_id) AS place FROM sight a JOIN sight b ON a.source_id = b.source_id AND a.frame_id = b.frame_id AND a.label = 'boat' AND b.label <> 'boat' AND b.x >= a.x AND b.y >= a.y AND b.x + b.w <= a.x + a.w AND b.y + b.h <= a.y + a.h")
def contained_parts(spark, d):
    s = views.sightings(views.detections(spark, d))
    a = s.filter("label = 'boat'").select("source_id", "frame_id", F.col("object_id").alias("bearer"), "x", "y", "w", "h")
    b = s.filter("label <> 'boat'").select("source_id", "frame_id", F.col("object_id").alias("part"), "confidence", *[F.col(c).alias(f"p_{c}") for c in "xywh"])
    return a.join(b, ["source_id", "frame_id"]).filter(Box.of().contains(Box.of("p_"))).select("source_id", "frame_id", "bearer", "part", F.row_number().over(windows.over(["bearer", "frame_id"], F.desc("confidence"), "part")).alias("place"))


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: 1.0)::DOUBLE[]), 6) AS similarity FROM embeddings")
def vector_metrics(spark, d):
    e = F.col("embedding")
    ones = F.array_repeat(F.lit(1.0), 64)
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(F.sqrt(scalars.dot(e, e)), 6).alias("norm"), F.round(scalars.cosine(e, ones), 6).alias("similarity"))


@query(_EVENTS + ", l AS (SELECT event_id, us, event_name, object_id, score FROM e), b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY score DESC, us, event_id) = 1) SELECT object_id, event_id, score FROM b")
def best_request_per_object(spark, d):
    """Of waiting requests for an object the best one stays; of equal ones the first."""
    e = views.object_stream(spark, d)
    return e.groupBy("object_id").agg(F.min_by(F.struct("event_id", "score"), F.struct(-F.col("score"), "ts", "event_id")).alias("b")).select("object_id", "b.*")


@query(_EVENTS + ", q AS (SELECT event_id, object_id, us FROM e WHERE event_name = 'click'), a AS (SELECT q.event_id, min(e.us) AS answered FROM q LEFT JOIN e ON e.object_id = q.object_id AND e.event_name = 'purchase' AND e.us > q.us AND e.us <= q.us + 86400000000 GROUP BY 1) SELECT event_id, CASE WHEN answered IS NULL THEN 'TimedOut' ELSE 'Confirmed' END AS status FROM a")
def candidate_outcomes(spark, d):
    """Requests meet their first answer before the deadline, or time out: a window over the merged stream, not a range join."""
    e = views.object_stream(spark, d).filter(F.col("event_name").isin("click", "purchase")).select("event_id", "object_id", "event_name", F.unix_micros("ts").alias("us"))
    nxt = F.first(F.when(F.col("event_name") == "purchase", F.col("us")), ignorenulls=True).over(Window.partitionBy("object_id").orderBy("us").rangeBetween(1, 86_400_000_000))
    return e.withColumn("answered", nxt).filter("event_name = 'click'").select("event_id", F.when(F.col("answered").isNull(), "TimedOut").otherwise("Confirmed").alias("status"))


@query("SELECT event_id, 'peoplecount' || strftime(ts, '%Y%m%d') AS bucket, user_id || '_' || event_type AS event_key, json_extract_string(props, '$.k') AS k FROM events")
def event_rows(spark, d):
    e = views.object_stream(spark, d)
    return e.select("event_id", scalars.event_bucket(F.lit("People Count"), F.col("ts")).alias("bucket"), F.concat_ws("_", "object_id", "event_name").alias("event_key"), F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max_by(value, ts) AS last_value FROM events GROUP BY ALL")
def runtime_counters(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.max_by("value", "ts").alias("last_value"))


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) > 7")
def retention(spark, d):
    e = table(spark, d, "events")
    today = e.agg(F.max(F.to_date("ts")).alias("today"))
    return e.crossJoin(today).filter(F.datediff("today", F.to_date("ts")) > 7).select("event_id", "ts", "user_id", "event_type")  # one row is sent


@query("SELECT n_name, date_part('year', o_orderdate)::INT AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS total, grouping(n_name) AS all_nations FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (year, n_name)")
def orders_rollup(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.rollup(F.year("o_orderdate").alias("year"), "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping("n_name").cast("long").alias("all_nations"))


@query("SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def as_of_join(spark, d):
    """The last order before each event: both streams in one window, so a long history costs one sort."""
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), "ts", F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey")).select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    w = Window.partitionBy("k").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(w)).filter("side = 1").select("event_id", "o_orderkey")


@query(f"""WITH RECURSIVE {DETECTIONS_SQL}, g AS (SELECT source_id, frame_id, label, list({{'x': x, 'y': y, 'w': w, 'h': h, 't': tracking_id, 'c': confidence}} ORDER BY confidence DESC, x, y, w, h, tracking_id) AS b FROM det GROUP BY ALL),
p AS (SELECT *, list_transform(range(0, len(b) * len(b)), lambda k: {{'i': k // len(b) + 1, 'j': k % len(b) + 1}}) AS ps FROM g),
s(source_id, frame_id, label, b, ps, n, gone) AS (SELECT source_id, frame_id, label, b, list_filter(ps, lambda q: q.i < q.j), 1, list_transform(b, lambda r: false) FROM p
 UNION ALL SELECT source_id, frame_id, label, b, ps, n + 1,
  CASE WHEN gone[ps[n].i] OR gone[ps[n].j] OR NOT (greatest(0, least(b[ps[n].i].x + b[ps[n].i].w, b[ps[n].j].x + b[ps[n].j].w) - greatest(b[ps[n].i].x, b[ps[n].j].x))::BIGINT * greatest(0, least(b[ps[n].i].y + b[ps[n].i].h, b[ps[n].j].y + b[ps[n].j].h) - greatest(b[ps[n].i].y, b[ps[n].j].y)) / least(b[ps[n].i].w * b[ps[n].i].h, b[ps[n].j].w * b[ps[n].j].h) > 0.5) THEN gone
  ELSE list_transform(gone, lambda v, k: v OR k = CASE WHEN b[ps[n].i].w * b[ps[n].i].h >= b[ps[n].j].w * b[ps[n].j].h THEN ps[n].j ELSE ps[n].i END) END FROM s WHERE n <= len(ps)),
e AS (SELECT source_id, frame_id, label, unnest(list_filter(b, lambda r, k: NOT gone[k])) AS r FROM s WHERE n = len(ps) + 1)
SELECT source_id, frame_id, label, r.t AS tracking_id, r.c AS confidence, r.x AS x, r.y AS y, r.w AS w, r.h AS h FROM e""")
def inner_suppression(spark, d):
    return folds.inner_suppression(views.detections(spark, d), 0.5)


_CORNERS = "SELECT s.*, trunc(q.px) AS px, trunc(q.py) AS py, q.c FROM sight s, LATERAL (VALUES (x::DOUBLE, y::DOUBLE, 1), (x + w, y, 1), (x + w, y + h, 1), (x, y + h, 1), (x + w / 2.0, y + h / 2.0, 0)) q(px, py, c)"
_GEOMETRY_SQL = f"""{_EDGES}, corner AS ({_CORNERS}), cpt AS (SELECT DISTINCT source_id, px, py FROM corner), {regions.pip_sql('cpt', 'cin')},
geo AS (SELECT object_id, frame_id, count(*) FILTER (c = 1 AND kind IS NOT NULL) AS n, bool_or(c = 0 AND kind IS NOT NULL) AS mid FROM corner LEFT JOIN (SELECT * FROM cin WHERE kind = 'interest' AND name = 'watch') i USING (source_id, px, py) GROUP BY ALL),
geom AS (SELECT object_id, frame_id, CASE WHEN n = 4 THEN 'in' WHEN n = 0 THEN 'out' WHEN mid THEN 'mixed_in' ELSE 'mixed_out' END AS geometry FROM geo)"""


def watched_geometry(spark: SparkSession, d: str) -> DataFrame:
    return regions.geometry(views.sightings(views.detections(spark, d)), dimension(spark), WATCH)


@query(f"""WITH RECURSIVE {SIGHTINGS_SQL}, {_GEOMETRY_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY frame_id) AS n FROM geom),
s(object_id, frame_id, n, state) AS (SELECT object_id, frame_id, n, CASE WHEN geometry IN ('in', 'mixed_in') THEN 'Entering' ELSE 'Outside' END FROM o WHERE n = 1
 UNION ALL SELECT o.object_id, o.frame_id, o.n, CASE o.geometry WHEN 'in' THEN CASE WHEN s.state IN ('Entering', 'Inside') THEN 'Inside' ELSE 'Entering' END WHEN 'mixed_in' THEN CASE WHEN s.state = 'Inside' THEN 'Inside' ELSE 'Entering' END
 WHEN 'mixed_out' THEN CASE WHEN s.state = 'Outside' THEN 'Outside' ELSE 'Leaving' END ELSE CASE WHEN s.state IN ('Entering', 'Inside') THEN 'Leaving' ELSE 'Outside' END END FROM s JOIN o ON o.object_id = s.object_id AND o.n = s.n + 1)
SELECT object_id, frame_id, state FROM s""")
def region_access(spark, d):
    """Region-access states by how much of a box lies in its source's watched area."""
    return folds.access_states(watched_geometry(spark, d), "object_id", "frame_id", "geometry")


@query()
def sort_tracking(spark, d):
    return folds.sort_tracks(views.detections(spark, d))

"""Queries of the rules made of several steps, of requests and evidence, of annotation shapes and of tracking by appearance."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import scalars, shapes
from vigil.functions.geometry import Box
from vigil.operators import appearance, folds, keyed, motion, rules, windows
from vigil.plans.queries import _GEOMETRY_SQL, query, watched_geometry
from vigil.sources import sinks, views
from vigil.sources.views import DETECTIONS_SQL, SIGHTINGS_SQL, table


@query("""WITH r AS (SELECT l_orderkey AS candidate_id, l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS completed, l_returnflag = 'N' AS occurred FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber < 6),
f AS (SELECT candidate_id, first(request_id ORDER BY completed, request_id) AS request_id, first(occurred ORDER BY completed, request_id) AS occurred FROM r JOIN orders ON o_orderkey = candidate_id WHERE completed < o_orderdate + INTERVAL 60 DAY GROUP BY 1)
SELECT o_orderkey AS candidate_id, CASE WHEN request_id IS NULL THEN 'timed_out' WHEN occurred THEN 'published' ELSE 'rejected' END AS status, request_id, CASE WHEN request_id IS NULL THEN 'unknown' WHEN occurred THEN 'confirmed' END AS published FROM orders LEFT JOIN f ON o_orderkey = candidate_id""")
def candidate_reconciliation(spark, d):
    """Orders as candidates with a deadline of 60 days, their lines as results."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("deadline"))
    r = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_orderkey").alias("candidate_id"), F.col("l_shipdate").alias("completed"), (F.col("l_returnflag") == "N").alias("occurred"), (F.col("l_linestatus") != "O").alias("expired"), (F.col("l_linenumber") < 6).alias("handled"))
    return rules.reconciled(c, r, "publish_unknown")


def _requests(spark, d):
    e = views.object_stream(spark, d).withColumn("created_us", F.unix_micros("ts"))
    policy = F.element_at(F.array(*map(F.lit, ("latest_per_source", "best_per_object", "anchored", "drop_oldest"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.concat(F.lit("queue-"), (F.col("object_id") % 8).cast("string")).alias("queue"), F.col("event_id").alias("request_id"), policy.alias("policy"), F.col("event_name").alias("source_id"), F.col("object_id").cast("string").alias("object_id"), F.col("score").alias("quality"), "created_us", (F.col("created_us") + 86_400_000_000).alias("expire_us"))


@query()
def request_schedule(spark, d):
    return keyed.scheduled(_requests(spark, d), 20)


@query()
def evidence_admission(spark, d):
    e = _requests(spark, d).withColumnRenamed("queue", "store").withColumn("size_bytes", (F.col("request_id") * 7919 % 4_000_000).cast("long"))
    return keyed.admitted(e, 30, 64 << 20)


@query(f"WITH {SIGHTINGS_SQL} SELECT object_id, first(frame_id ORDER BY r DESC) AS frame_id, first(confidence ORDER BY r DESC) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY (w % 2 = 0), confidence, CASE WHEN w % 2 = 0 THEN 0 ELSE w * h END, frame_id DESC) AS r FROM sight) GROUP BY 1")
def best_evidence(spark, d):
    """Boxes of an even width count as known."""
    return rules.best_evidence(views.sightings(views.detections(spark, d)), "object_id", "frame_id", F.col("w") % 2 == 0, F.col("confidence"), F.col("w") * F.col("h"), "confidence")


_SCENES = "s AS (SELECT source_id, frame_id, CASE WHEN count(*) > 5 THEN 'crowded' WHEN max(w) > 200 THEN 'near' ELSE 'calm' END AS scene FROM det GROUP BY ALL)"


@query(f"WITH {DETECTIONS_SQL}, {_SCENES}, h AS (SELECT *, list(scene) OVER (PARTITION BY source_id ORDER BY frame_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h FROM s) SELECT source_id, frame_id, scene, list_filter(h, lambda v: len(list_filter(h, lambda x: x = v)) = list_max(list_transform(h, lambda y: len(list_filter(h, lambda z: z = y)))))[1] AS dominant FROM h")
def dominant_scene(spark, d):
    s = views.detections(spark, d).groupBy("source_id", "frame_id").agg(F.when(F.count("*") > 5, "crowded").when(F.max("w") > 200, "near").otherwise("calm").alias("scene"))
    return rules.dominant(s, "source_id", "frame_id", "scene", 10)


@query(f"WITH {DETECTIONS_SQL}, s AS (SELECT source_id, frame_id, max(h) > 100 AS size FROM det GROUP BY ALL), c AS (SELECT *, coalesce((size <> lag(size) OVER (PARTITION BY source_id ORDER BY frame_id))::INT, 0) AS c FROM s), i AS (SELECT *, sum(c) OVER (PARTITION BY source_id ORDER BY frame_id) AS i FROM c) SELECT source_id, frame_id FROM i QUALIFY row_number() OVER (PARTITION BY source_id, i ORDER BY frame_id) > 2")
def warmed_up_frames(spark, d):
    s = views.detections(spark, d).groupBy("source_id", "frame_id").agg((F.max("h") > 100).alias("size"))
    return rules.warmed_up(s, "source_id", "frame_id", F.col("size"), 2).select("source_id", "frame_id")


@query(f"WITH {SIGHTINGS_SQL}, q AS (SELECT object_id, frame_id, confidence AS quality, row_number() OVER w AS n, max(confidence) OVER (PARTITION BY object_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM sight WINDOW w AS (PARTITION BY object_id ORDER BY frame_id)) SELECT object_id, frame_id, quality FROM q WHERE n = 1 OR n % 5 = 0 AND quality > best + 0.03")
def verification_requests(spark, d):
    return rules.verifications(views.sightings(views.detections(spark, d)).select("object_id", "frame_id", F.col("confidence").alias("quality")), 5)


@query(f"""WITH {SIGHTINGS_SQL}, s AS (SELECT source_id, frame_id, object_id, tracking_id, label, confidence, x, y, unnest([1, 2]) AS part, row_number() OVER (PARTITION BY source_id, frame_id ORDER BY object_id) AS n FROM sight),
t AS (SELECT *, CASE WHEN part = 2 THEN 1 ELSE (CASE WHEN label = 'boat' THEN -1 ELSE 0 END) END AS z FROM s)
SELECT source_id, frame_id, row_number() OVER (PARTITION BY source_id, frame_id ORDER BY z, n, part) AS place, CASE part WHEN 1 THEN 'bbox_' ELSE 'text_' END || object_id AS id, x, CASE part WHEN 1 THEN y ELSE y - 20 END AS y, CASE part WHEN 2 THEN label || '_' || tracking_id || '_' || round(confidence::FLOAT::DOUBLE::DECIMAL(30, 20), 2) END AS text FROM t""")
def annotation_shapes(spark, d):
    """Boxes, boats beneath all others, under the texts, in drawing order."""
    b, oid = Box.of(), F.col("object_id")
    text = shapes.object_text(F.col("label"), F.col("tracking_id"), F.col("confidence"))
    two = F.array(shapes.box_shape(oid, b, z=F.when(F.col("label") == "boat", -1)), shapes.text_shape(oid, b, text, z=F.lit(1)))
    s = views.sightings(views.detections(spark, d)).groupBy("source_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("object_id", two.alias("two")))).alias("all"))
    s = s.select("source_id", "frame_id", F.posexplode(shapes.drawn(F.flatten(F.transform("all", lambda o: o["two"])))).alias("i", "s"))
    return s.select("source_id", "frame_id", (F.col("i") + 1).cast("long").alias("place"), "s.id", "s.x", "s.y", "s.text")


@query(f"WITH {SIGHTINGS_SQL}, {_GEOMETRY_SQL} SELECT * FROM geom")
def region_geometry(spark, d):
    return watched_geometry(spark, d).select("object_id", "frame_id", "geometry")


@query(f"""WITH {DETECTIONS_SQL}, p AS (SELECT a.source_id, a.frame_id, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))::BIGINT * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w::BIGINT * a.h + b.w::BIGINT * b.h AS s FROM det a JOIN det b ON a.source_id = b.source_id AND a.frame_id = b.frame_id + 1),
m AS (SELECT source_id, frame_id, avg(i / (s - i)) AS mean_iou FROM p GROUP BY ALL)
SELECT source_id, frame_id, count(*) AS regions, sum(w::BIGINT * h)::BIGINT AS total_area, sum(w::BIGINT * h) / 2073600.0 AS coverage, round(coalesce(any_value(mean_iou), 0), 9) AS mean_iou FROM det LEFT JOIN m USING (source_id, frame_id) GROUP BY ALL""")
def motion_statistics(spark, d):
    """Per frame: regions, their area, and the mean overlap of each with each of the frame before."""
    f = views.detections(spark, d).groupBy("source_id", "frame_id").agg(F.collect_list(Box.of().struct()).alias("now"))
    f = motion.remembered(f.withColumn("tagged", F.transform("now", lambda r: F.struct(F.col("frame_id").alias("f"), r.alias("r")))), "source_id", "frame_id", "tagged", 1)
    f = f.withColumn("before", F.transform(F.filter("history", lambda x: x["f"] < F.col("frame_id")), lambda x: x["r"]))
    box = lambda r: Box(r["x"], r["y"], r["w"], r["h"])
    overlaps = F.flatten(F.transform("now", lambda a: F.transform("before", lambda b: box(a).iou(box(b)))))
    mean = F.aggregate(overlaps, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(overlaps), F.lit(0))
    area = F.aggregate("now", F.lit(0).cast("long"), lambda a, r: a + r["w"].cast("long") * r["h"])
    return f.select("source_id", "frame_id", F.size("now").cast("long").alias("regions"), area.alias("total_area"), (area / 2073600.0).alias("coverage"), F.round(F.coalesce(mean, F.lit(0.0)), 9).alias("mean_iou"))


@query()
def appearance_tracking(spark, d):
    """The tables hold no appearances of detections; a vector of the embeddings stands in for each label and track."""
    looks = table(spark, d, "embeddings").select(F.col("vec_id").alias("__v"), "embedding")
    dets = views.detections(spark, d)
    return appearance.appearance_tracks(dets.join(looks, dets.tracking_id == F.col("__v")).drop("__v"), "embedding", threshold=0.3, streak=3)


@query("SELECT user_id AS source_id, event_type AS event_name, strftime(ts, '%Y%m%d') AS day, 'peoplecount' || strftime(ts, '%Y%m%d') AS bucket_name, event_id::VARCHAR AS event_id FROM events")
def stored_events(spark, d):
    e = views.object_stream(spark, d).select(F.col("event_id").cast("string").alias("event_id"), "ts", F.col("object_id").alias("source_id"), "event_name", F.lit("People Count").alias("algorithm_name"))
    return sinks.stored_events(e).select("source_id", "event_name", F.date_format("ts", "yyyyMMdd").alias("day"), "bucket_name", "event_id")


_POS = "f AS (SELECT source_id, frame_id, row_number() OVER (ORDER BY frame_id, source_id) AS pos FROM (SELECT DISTINCT source_id, frame_id FROM det))"


@query(f"WITH {DETECTIONS_SQL}, {_POS} SELECT * FROM f")
def arrival_positions(spark, d):
    return windows.positions(views.detections(spark, d).select("source_id", "frame_id").distinct(), 256)


@query(f"WITH {SIGHTINGS_SQL}, {_POS}, s AS (SELECT source_id, object_id, pos, lead(pos) OVER (PARTITION BY object_id ORDER BY pos) AS nx FROM sight JOIN f USING (source_id, frame_id)) SELECT source_id, object_id, pos, pos + 200 AS expired_at FROM s WHERE (nx IS NULL OR nx - pos >= 200) AND pos + 200 <= (SELECT max(pos) FROM f)")
def expiry_over_all_sources(spark, d):
    return windows.global_expiry(views.sightings(views.detections(spark, d)), 200)


#: A made-up decision about the candidate that a frame makes: an answer 3 to 202 frames later, or, from 120 frames on, none.
_CHAIN = """e AS (SELECT *, frame_id + least(3 + frame_id * 7 % 200, 120) AS due, 3 + frame_id * 7 % 200 >= 120 AS late FROM held),
n1 AS (SELECT a.*, (SELECT min(b.frame_id) FROM e b WHERE b.source_id = a.source_id AND b.g = a.g AND b.frame_id >= a.due) AS first, lead(frame_id) OVER (PARTITION BY source_id, g ORDER BY frame_id) AS behind FROM e a),
n2 AS (SELECT a.*, CASE WHEN a.late THEN b.behind ELSE a.first END AS nxt FROM n1 a LEFT JOIN n1 b ON b.source_id = a.source_id AND b.g = a.g AND b.frame_id = a.first),
chain AS (SELECT * FROM n2 QUALIFY row_number() OVER (PARTITION BY source_id, g ORDER BY frame_id) = 1 UNION ALL SELECT n2.* FROM chain JOIN n2 ON n2.source_id = chain.source_id AND n2.g = chain.g AND n2.frame_id = chain.nxt)"""


@query(f"WITH RECURSIVE {DETECTIONS_SQL}, o AS (SELECT source_id, frame_id, bool_or(label = 'boat') AS occ FROM det GROUP BY ALL), i AS (SELECT *, sum((NOT occ)::INT) OVER (PARTITION BY source_id ORDER BY frame_id) AS g FROM o), held AS (SELECT source_id, g, frame_id, row_number() OVER (PARTITION BY source_id, g ORDER BY frame_id) AS k FROM i WHERE occ QUALIFY k >= 3), {_CHAIN} SELECT source_id, frame_id AS candidate_frame, k AS duration, due AS decided, late AS timed_out FROM chain")
def active_candidates(spark, d):
    """Candidates of runs with a boat, one after the other: the next one may come once the last one is answered or given up."""
    o = views.detections(spark, d).groupBy("source_id", "frame_id").agg(F.bool_or(F.col("label") == "boat").alias("occ"))
    wait = 3 + F.col("frame_id") * 7 % 200
    o = o.withColumns({"decided": F.col("frame_id") + F.least(wait, F.lit(120)), "timed_out": wait >= 120})
    c = folds.candidates(o, "source_id", "frame_id", F.col("occ"), 3, F.col("decided"), F.col("timed_out"))
    return c.select("source_id", F.col("frame_id").alias("candidate_frame"), F.col("run_length").alias("duration"), "decided", "timed_out")


_LAG = "lag(x) OVER w AS px, lag(y) OVER w AS py, lag(w) OVER w AS pw, lag(h) OVER w AS ph"


@query(f"""WITH {SIGHTINGS_SQL}, l AS (SELECT object_id, frame_id, x, y, w, h, {_LAG} FROM sight WINDOW w AS (PARTITION BY object_id ORDER BY frame_id)),
m AS (SELECT *, greatest(0, least(x + w, px + pw) - greatest(x, px))::BIGINT * greatest(0, least(y + h, py + ph) - greatest(y, py)) AS i, (greatest(x + w, px + pw) - least(x, px))::BIGINT AS mw, (greatest(y + h, py + ph) - least(y, py))::BIGINT AS mh FROM l WHERE px IS NOT NULL),
u AS (SELECT *, w::BIGINT * h + pw::BIGINT * ph - i AS u FROM m)
SELECT object_id, frame_id, round(i / u - (mw * mh - u) / (mw * mh), 9) AS giou, round(i / u - (pow(x + w / 2.0 - px - pw / 2.0, 2) + pow(y + h / 2.0 - py - ph / 2.0, 2)) / (mw * mw + mh * mh), 9) AS diou FROM u""")
def box_similarity(spark, d):
    """Of each box of an object and the one before it."""
    w = windows.over("object_id", "frame_id")
    s = views.sightings(views.detections(spark, d)).select("object_id", "frame_id", *"xywh", *[F.lag(c).over(w).alias(f"p{c}") for c in "xywh"]).filter("px is not null")
    a, b = Box.of(), Box.of("p")
    return s.select("object_id", "frame_id", F.round(a.giou(b), 9).alias("giou"), F.round(a.diou(b), 9).alias("diou"))


@query("SELECT event_id, CASE WHEN value BETWEEN 0 AND 50 THEN value ELSE 10 END AS threshold, event_type || ':' || (event_id % 60) || ', odd, x:y' AS text, event_id % 60 AS seconds FROM events")
def parsed_preferences(spark, d):
    e = views.object_stream(spark, d)
    text = F.concat(F.col("event_name"), F.lit(":"), (F.col("event_id") % 60).cast("string"), F.lit(", odd, x:y"))
    return e.select("event_id", scalars.number_or(F.col("score").cast("string"), 10, 0, 50).alias("threshold"), text.alias("text"), F.try_element_at(scalars.key_values(text), F.col("event_name")).alias("seconds"))

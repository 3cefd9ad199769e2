"""Queries of the streaming operators, drained over a whole table, and of the rules over a frame's boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import messages
from vigil.functions.geometry import Box
from vigil.operators import frames
from vigil.plans import shipped
from vigil.plans.queries import ORACLES, query
from vigil.sources import views
from vigil.sources.views import DETECTIONS_SQL
from vigil.streaming import stateful, windows


def _events(spark, d):
    e = stateful.source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("us", F.unix_micros("ts"))


@query(ORACLES["throttled_events"])
def stream_throttled_events(spark, d):
    e = _events(spark, d).withColumnRenamed("event_type", "event_name")
    return stateful.drain(stateful.throttle(e, "event_name", "us", 3_000_000_000), "throttled")


@query("WITH c AS (SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM c WHERE start_us + 3600000000 <= (SELECT max(epoch_ms(ts)) * 1000 - 3600000000 FROM events)")
def stream_hourly_counts(spark, d):
    """Windows that the watermark, an hour behind, has passed."""
    return stateful.drain(stateful.windowed_counts(_events(spark, d), "ts", "event_type", "1 hour", "1 hour"), "hourly")


@query("WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us) >= 86400000000)::INT, 0) AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS no FROM g), t AS (SELECT user_id, no, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, first_us, last_us, n FROM t WHERE no < (SELECT max(no) FROM t u WHERE u.user_id = t.user_id) OR (last_us + 86400000000) // 1000 < (SELECT max(epoch_ms(ts)) FROM events)")
def stream_expired_sessions(spark, d):
    return stateful.drain(stateful.expired_sessions(_events(spark, d), "user_id", "us", 86_400_000_000), "sessions")


_GAP = "sqrt(pow(greatest(0, b.x - a.x - a.w, a.x - b.x - b.w), 2) + pow(greatest(0, b.y - a.y - a.h, a.y - b.y - b.h), 2))"


@query(f"WITH {DETECTIONS_SQL}, p AS (SELECT * FROM det WHERE label = 'person') SELECT a.source_id, a.frame_id, a.x, a.y, a.w, a.h, count(*) AS size FROM p a JOIN p b ON a.source_id = b.source_id AND a.frame_id = b.frame_id AND {_GAP} < 3 * greatest(a.w, a.h, b.w, b.h) GROUP BY ALL HAVING count(*) >= 2")
def gatherings(spark, d):
    """The people near each person of a frame, itself included: edges closer than thrice the longest side of the two."""
    p = views.detections(spark, d).filter("label = 'person'").select("source_id", "frame_id", "x", "y", "w", "h")
    o = p.select("source_id", "frame_id", *[F.col(c).alias(f"o_{c}") for c in "xywh"])
    near = Box.of().edge_distance(Box.of("o_")) < 3 * F.greatest("w", "h", "o_w", "o_h")
    return p.join(o, ["source_id", "frame_id"]).filter(near).groupBy("source_id", "frame_id", "x", "y", "w", "h").agg(F.count("*").alias("size")).filter("size >= 2")


#: One comparison a step: grown is the box that takes others in, at the place in todo that it has come to, rest what it didn't take.
_IOU = "(greatest(0, least(grown.x + grown.w, todo[pos].x + todo[pos].w) - greatest(grown.x, todo[pos].x))::BIGINT * greatest(0, least(grown.y + grown.h, todo[pos].y + todo[pos].h) - greatest(grown.y, todo[pos].y)))"
_HULL = "{'x': least(grown.x, todo[pos].x), 'y': least(grown.y, todo[pos].y), 'w': greatest(grown.x + grown.w, todo[pos].x + todo[pos].w) - least(grown.x, todo[pos].x), 'h': greatest(grown.y + grown.h, todo[pos].y + todo[pos].h) - least(grown.y, todo[pos].y)}"


def _forward_sql(order: str, again: str) -> str:
    """again: may a pass that merged something be followed by another?"""
    hit = f"{_IOU} / nullif(grown.w::BIGINT * grown.h + todo[pos].w::BIGINT * todo[pos].h - {_IOU}, 0) > 0.15"
    return f"""WITH RECURSIVE {DETECTIONS_SQL}, g AS (SELECT source_id, frame_id, list({{'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY {order}) AS b FROM det GROUP BY ALL),
s(source_id, frame_id, n, grown, todo, pos, rest, done, finished) AS (SELECT source_id, frame_id, len(b), b[1], b[2:], 1, b[1:0], b[1:0], false FROM g
 UNION ALL SELECT source_id, frame_id, CASE WHEN pass_end THEN len(done) + 1 ELSE n END,
  CASE WHEN pos <= len(todo) THEN CASE WHEN hit THEN {_HULL} ELSE grown END WHEN len(rest) > 0 THEN rest[1] ELSE list_append(done, grown)[1] END,
  CASE WHEN pos <= len(todo) THEN todo WHEN len(rest) > 0 THEN rest[2:] ELSE list_append(done, grown)[2:] END,
  CASE WHEN pos <= len(todo) THEN pos + 1 ELSE 1 END,
  CASE WHEN pos <= len(todo) THEN CASE WHEN hit THEN rest ELSE list_append(rest, todo[pos]) END ELSE rest[1:0] END,
  CASE WHEN pos <= len(todo) THEN done WHEN len(rest) > 0 OR last_pass THEN list_append(done, grown) ELSE done[1:0] END, last_pass
 FROM (SELECT *, coalesce({hit}, false) AS hit, pos > len(todo) AND len(rest) = 0 AS pass_end, pos > len(todo) AND len(rest) = 0 AND NOT ({again} AND len(done) + 1 < n) AS last_pass FROM s WHERE NOT finished)),
e AS (SELECT source_id, frame_id, unnest(done) AS r FROM s WHERE finished)
SELECT source_id, frame_id, r.x AS x, r.y AS y, r.w AS w, r.h AS h FROM e"""


_FIRST_SQL = f"""WITH RECURSIVE {DETECTIONS_SQL}, g AS (SELECT source_id, frame_id, list({{'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY x, y, w, h) AS b FROM det GROUP BY ALL),
s(source_id, frame_id, b, n, m) AS (SELECT source_id, frame_id, b, 1, b[1:1] FROM g
 UNION ALL SELECT source_id, frame_id, b, n + 1, CASE WHEN hit IS NULL THEN list_append(m, t) ELSE list_transform(m, lambda q, k: CASE WHEN k = hit THEN {{'x': least(q.x, t.x), 'y': least(q.y, t.y), 'w': greatest(q.x + q.w, t.x + t.w) - least(q.x, t.x), 'h': greatest(q.y + q.h, t.y + t.h) - least(q.y, t.y)}} ELSE q END) END
 FROM (SELECT *, b[n + 1] AS t, list_filter(range(1, len(m) + 1), lambda k: coalesce((greatest(0, least(m[k].x + m[k].w, b[n + 1].x + b[n + 1].w) - greatest(m[k].x, b[n + 1].x))::BIGINT * greatest(0, least(m[k].y + m[k].h, b[n + 1].y + b[n + 1].h) - greatest(m[k].y, b[n + 1].y)))
  / nullif(m[k].w::BIGINT * m[k].h + b[n + 1].w::BIGINT * b[n + 1].h - (greatest(0, least(m[k].x + m[k].w, b[n + 1].x + b[n + 1].w) - greatest(m[k].x, b[n + 1].x))::BIGINT * greatest(0, least(m[k].y + m[k].h, b[n + 1].y + b[n + 1].h) - greatest(m[k].y, b[n + 1].y))), 0) >= 0.15, false))[1] AS hit FROM s WHERE n < len(b))),
e AS (SELECT source_id, frame_id, unnest(m) AS r FROM s WHERE n = len(b))
SELECT source_id, frame_id, r.x AS x, r.y AS y, r.w AS w, r.h AS h FROM e"""

_MERGE_SQL = {"first": _FIRST_SQL, "forward": _forward_sql("x, y, w, h", "false"), "largest": _forward_sql("w::BIGINT * h DESC, x, y, w, h", "false"), "all": _forward_sql("x, y, w, h", "true")}


def _merge_query(variant: str):
    def run(spark, d):
        return frames.merged(views.detections(spark, d), variant, 0.15)

    run.__name__ = f"box_merge_{variant}"
    return query(_MERGE_SQL[variant])(run)


for _variant in frames.MERGED:
    _merge_query(_variant)


def _apart(axis: str, size: str, seams: list[int]) -> str:
    far = " OR ".join(f"(a.{axis} + a.{size} <= {s} AND b.{axis} >= {s})" for s in seams)
    other, width = ("y", "h") if axis == "x" else ("x", "w")
    along = f"greatest(0, least(a.{other} + a.{width}, b.{other} + b.{width}) - greatest(a.{other}, b.{other})) / least(a.{width}, b.{width})"
    return f"(({far}) AND b.{axis} - a.{axis} - a.{size} <= 60 AND {along} >= 0.3)"


@query(f"""WITH RECURSIVE {DETECTIONS_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY source_id, frame_id ORDER BY x, y, w, h, label, tracking_id, confidence) AS n FROM det),
e AS (SELECT a.source_id, a.frame_id, a.n AS i, b.n AS j FROM d a JOIN d b ON a.source_id = b.source_id AND a.frame_id = b.frame_id AND a.label = b.label AND a.n <> b.n WHERE {_apart("x", "w", [480, 960, 1440])} OR {_apart("y", "h", [360, 720])}),
u AS (SELECT * FROM e UNION SELECT source_id, frame_id, j, i FROM e),
r(source_id, frame_id, i, j) AS (SELECT source_id, frame_id, n, n FROM d UNION SELECT r.source_id, r.frame_id, r.i, u.j FROM r JOIN u ON r.source_id = u.source_id AND r.frame_id = u.frame_id AND r.j = u.i),
c AS (SELECT source_id, frame_id, i AS n, min(j) AS g FROM r GROUP BY ALL)
SELECT source_id, frame_id, any_value(label) AS label, coalesce(min(tracking_id) FILTER (tracking_id > 0), 0) AS tracking_id, max(confidence) AS confidence, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*)::INT AS parts FROM d JOIN c USING (source_id, frame_id, n) GROUP BY source_id, frame_id, g""")
def tile_stitching(spark, d):
    """A grid of 4 x 3 tiles; the tables' boxes aren't cut by tiles, so the tolerance is wide."""
    return frames.stitched(views.detections(spark, d), views.WIDTH, views.HEIGHT, 4, 3, gap=60, overlap=0.3)


@query()
def stream_sort_tracking(spark, d):
    """The relational table as a stream of detections in order; no frame is cut."""
    lines = stateful.in_order(spark, d, "lineitem", F.expr("l_orderkey div 4"))
    return stateful.drain(stateful.sort_tracks(views.detections_of(lines)), "tracks")


def _sightings(spark, d):
    dets = views.detections_of(stateful.in_order(spark, d, "lineitem", F.expr("l_orderkey div 4")))
    return dets.withColumn("object_id", F.concat_ws("_", "source_id", "label", "tracking_id"))


@query(ORACLES["object_expiry"])
def stream_object_expiry(spark, d):
    """What leaves each source's window of 50 frames."""
    gone = windows.sliding(_sightings(spark, d), 50).filter("object_id is not null")
    return stateful.drain(gone, "expired", windows.STORE)


@query(ORACLES["sequence_batches"])
def stream_sequence_batches(spark, d):
    got = windows.tumbling(_sightings(spark, d).filter("label = 'person'"), 5)
    return stateful.drain(got.select("source_id", "batch_no", F.col("first").alias("first_frame"), F.col("frame_id").alias("last_frame")), "batches", windows.STORE)


def better_evidence(stride: int):
    """Of known, confidence, area, frame and others: an object is looked at when it comes and on every stride-th frame; a known label beats an unknown one, then confidence, then
    (of unknown ones) area, then the first."""
    rank = lambda e: (e[0], e[1], 0 if e[0] else e[2], -e[3])

    def keep(old, new, place):
        return new if old is None or place % stride == 0 and rank(new) > rank(old) else old

    return keep


@query(shipped.SQL["ship_labels"])
def stream_ship_labels(spark, d):
    """A boat's best evidence, given when the boat expires."""
    s = _sightings(spark, d).withColumn("labels", shipped._labels())
    s = s.withColumns({"object_id": F.when(F.lower("label") == "boat", F.col("object_id")), "detail": F.col("labels.detail"), "area": F.col("w").cast("long") * F.col("h"), "seen_at": F.col("frame_id")})
    s = s.withColumn("known", F.lower("detail") != "unknown")
    gone = windows.sliding(s, shipped.LIFETIME, ["known", "confidence", "area", "seen_at", "detail"], ["confidence", "w", "h", "x", "y"], better_evidence(5))
    gone = gone.filter("object_id is not null and area >= 6000")
    said = messages.ship(F.col("object_id"), F.lit("ship"), F.col("detail"), F.array(F.lit("red"), F.lit("white")))
    return stateful.drain(gone.select("source_id", F.col("expired_at").alias("frame_id"), said.alias("message")), "ships", windows.STORE)


@query("""WITH r AS (SELECT l_orderkey AS candidate_id, l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS completed, l_returnflag = 'N' AS occurred FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber < 6),
f AS (SELECT candidate_id, first(request_id ORDER BY completed, request_id) AS request_id, first(occurred ORDER BY completed, request_id) AS occurred FROM r JOIN orders ON o_orderkey = candidate_id WHERE completed >= o_orderdate AND completed < o_orderdate + INTERVAL 60 DAY GROUP BY 1)
SELECT o_orderkey AS candidate_id, CASE WHEN request_id IS NULL THEN 'timed_out' WHEN occurred THEN 'published' ELSE 'rejected' END AS status, request_id FROM orders LEFT JOIN f ON o_orderkey = candidate_id
WHERE o_orderdate + INTERVAL 60 DAY < least((SELECT max(o_orderdate) FROM orders), (SELECT max(completed) FROM r))""")
def stream_candidate_reconciliation(spark, d):
    """Orders as requests with a deadline of 60 days, their lines as answers, as two streams; those whose deadline the watermark has passed."""
    requests = stateful.source(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderdate").cast("timestamp").alias("created"))
    lines = stateful.source(spark, d, "lineitem").filter("l_linestatus = 'O' and l_linenumber < 6")
    answers = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_orderkey").alias("candidate_id"), F.col("l_shipdate").cast("timestamp").alias("completed"), (F.col("l_returnflag") == "N").alias("occurred"))
    status = F.when(F.col("request_id").isNull(), "timed_out").when(F.col("occurred"), "published").otherwise("rejected")
    met = windows.reconciled(requests, answers, "60 days")
    return stateful.drain(met.select("candidate_id", status.alias("status"), "request_id"), "answers", windows.STORE)

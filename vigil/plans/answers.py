"""Queries of texts and answers of models: fields of any kind, colours, addresses, labels chosen by score, property bags, ways of detection, messages, and what becomes of requests by policy. The
tables' rows are turned into such texts by a rule that SQL says too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions import messages, scalars, shapes
from vigil.operators import motion, rules, windows
from vigil.plans.queries import query
from vigil.sources import views
from vigil.sources.views import table


def _one_of(n: int, *texts: str | None) -> Column:
    """By event_id: one of the texts."""
    out = F.lit(None).cast("string")
    for i, t in reversed(list(enumerate(texts))):
        out = F.when(F.col("event_id") % n == i, t).otherwise(out)
    return out


def _one_of_sql(n: int, *texts: str | None) -> str:
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if t is None else "'" + t.replace("'", "''") + "'") for i, t in enumerate(texts))
    return f"CASE event_id % {n} {cases} END"


_FIELDS = ('{"v": null}', '{"v": ["a", "b"]}', '{"v": "x"}', '{"v": 3}', '{"w": 1}', '{"v": []}')


@query(f"SELECT event_id, {_one_of_sql(6, '', 'a; b', 'x', '3', '', '')} AS v FROM events")
def flexible_fields(spark, d):
    """A field that is null, a list, a text, a number, or not there."""
    return views.object_stream(spark, d).select("event_id", scalars.flexible_string(_one_of(6, *_FIELDS), "$.v").alias("v"))


_ACTIONS = ('{"Conclusion": "fight", "Action": "push"}', '```json\n{"Conclusion": "calm"}\n```', '{"Conclusion": 5', "calm", '{"Action": "run", "other": 1}')
_SHIPS = ('{"ShipTypeGroup": "cargo", "ShipColor": ["red", "blue"], "ShipPaintedText": [{"Text": "A 1", "Bbox": [1, 2, 3, 4]}]}', '{"ShipTypeGroup": "cargo", "ShipColor": []}', "[1]")


@query(f"SELECT event_id, {_one_of_sql(5, 'fight', 'calm', None, None, None)} AS conclusion, {_one_of_sql(5, 'push', None, None, None, 'run')} AS action, {_one_of_sql(3, 'cargo', 'cargo', None)} AS ship, {_one_of_sql(3, 'red,blue', '', None)} AS colours, {_one_of_sql(3, 'A 1', None, None)} AS painted, CASE WHEN event_id % 3 = 0 THEN 3 END AS width FROM events")
def decoded_actions_and_ships(spark, d):
    """Answers about what people do and what a ship is, with fences, broken, and of another kind."""
    e = views.object_stream(spark, d).select("event_id", scalars.decoded(_one_of(5, *_ACTIONS), scalars.ACTION).alias("a"), scalars.decoded(_one_of(3, *_SHIPS), scalars.SHIP).alias("s"))
    text = F.get("s.ShipPaintedText", F.lit(0))
    return e.select("event_id", F.col("a.Conclusion").alias("conclusion"), F.col("a.Action").alias("action"), F.col("s.ShipTypeGroup").alias("ship"), F.array_join("s.ShipColor", ",").alias("colours"), text["Text"].alias("painted"), F.get(text["Bbox"], F.lit(2)).alias("width"))


@query(f"SELECT event_id, {_one_of_sql(4, 'http://h/v1', 'https://h:1/a', 'http://h/v1', 'h')} AS url, {_one_of_sql(3, 'Host=h;Password=***;Db=d', 'pwd=***', 'none')} AS masked, {_one_of_sql(4, '10,20,30,1.0', '1,2,3,0.5', '1,2,3,1.0', None)} AS colour FROM events")
def addresses_and_colours(spark, d):
    """Addresses of services, texts with passwords, colours in their two forms."""
    c = scalars.colour(_one_of(4, "#0a141E", "rgba(1, 2, 3, 0.5)", "rgb(1,2,3)", "red"))
    joined = F.when(c.isNotNull(), F.concat_ws(",", *[c[x].cast("string") for x in ("r", "g", "b", "alpha")]))
    url, secret = _one_of(4, "http://h/", "https://h:1/a/", " http://h ", "h"), _one_of(3, "Host=h;Password=p w;Db=d", "pwd=1", "none")
    return views.object_stream(spark, d).select("event_id", scalars.server_url(url).alias("url"), scalars.mask_password(secret).alias("masked"), joined.alias("colour"))


@query(f"SELECT event_id, {_one_of_sql(5, None, None, '1|2|3|4', '1|2|3', 'x')} AS given, CASE WHEN event_id % 5 = 2 THEN 3 END AS w FROM events")
def rectangles(spark, d):
    """Four whole numbers are a rectangle; anything else is none."""
    text = _one_of(5, None, None, "1|2|3|4", "1|2|3", "x")
    return views.object_stream(spark, d).select("event_id", text.alias("given"), scalars.rectangle(F.replace(text, F.lit("|"), F.lit(","))).getField("w").alias("w"))


@query("WITH e AS (SELECT event_id, value, event_id % 10 / 10.0 AS s FROM events) SELECT event_id, CASE WHEN s > 0.5 AND 1 - s > 0.5 THEN 'a,b' WHEN s > 0.5 THEN 'a,c' WHEN 1 - s > 0.5 THEN 'b' ELSE 'a' END AS top, CASE WHEN s - 0.05 > 1 - s THEN 'c' ELSE 'b' END AS allowed FROM e")
def chosen_labels(spark, d):
    """Labels over a threshold, else the best; and the best of those allowed."""
    s = F.col("event_id") % 10 / 10.0
    scores = F.array(*[F.struct(F.lit(n).alias("label"), v.alias("score")) for n, v in (("a", s), ("b", 1 - s), ("c", s - 0.05))])
    return views.object_stream(spark, d).select("event_id", F.array_join(shapes.top_labels(scores), ",").alias("top"), shapes.best_allowed(scores, F.array(F.lit("b"), F.lit("c"))).alias("allowed"))


@query("SELECT event_id, event_type AS kind, 'set' AS extra, 'none' AS missing, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 3 END AS n, event_id % 2 = 1 AS has_kind FROM events")
def property_bags(spark, d):
    """A bag of properties: set whether or not it is there, got with and without a default, required, removed."""
    e = views.object_stream(spark, d).withColumn("bag", F.create_map(F.lit("kind"), F.col("event_name"), F.lit("id"), F.col("event_id").cast("string")))
    e = e.withColumn("bag", shapes.bag_set(shapes.bag_set("bag", "extra", F.lit("old")), "extra", F.lit("set")))
    left = F.when(F.col("event_id") % 2 == 0, shapes.bag_remove(F.col("bag"), "kind")).otherwise(F.col("bag"))
    return e.select("event_id", shapes.bag_require(F.col("bag"), "kind").alias("kind"), shapes.bag_get(F.col("bag"), "extra").alias("extra"), shapes.bag_get(F.col("bag"), "nowhere", F.lit("none")).alias("missing"), F.size(left).alias("n"), F.map_contains_key(left, "kind").alias("has_kind"))


@query("WITH l AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (e[i] - b[i]) * (e[i] - b[i])))), 6) AS step FROM l WHERE b IS NOT NULL")
def vector_steps(spark, d):
    """How far a vector is from the one before it of its label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e")).withColumn("b", F.lag("e").over(windows.over("label", "vec_id"))).filter("b is not null")
    step = scalars.minus(F.col("e"), F.col("b"))
    return e.select("vec_id", F.round(F.sqrt(scalars.dot(step, step)), 6).alias("step"))


@query("WITH e AS (SELECT event_id, event_id % 10 / 40.0 AS noise, event_id % 7 / 8.0 AS complexity, event_id % 5 / 20.0 AS intensity, event_id % 3 * 15 AS millis FROM events) SELECT event_id, CASE WHEN noise > 0.15 OR complexity > 0.7 THEN 'advanced' WHEN intensity < 0.1 AND millis > 20 THEN 'classic' ELSE 'advanced' END AS way, 'LLM ''m'', Elapse: ' || millis || ', Result: ' || event_type || '.' AS message FROM (SELECT e.*, event_type FROM e JOIN events USING (event_id))")
def ways_of_detection(spark, d):
    """Which way of detection suits a scene, and what is said of a model's answer."""
    k = F.col("event_id")
    e = views.object_stream(spark, d).withColumn("millis", k % 3 * 15)
    return e.select("event_id", motion.strategy(k % 10 / 40.0, k % 7 / 8.0, k % 5 / 20.0, F.col("millis")).alias("way"), messages.inference("m", F.col("millis"), F.col("event_name")).alias("message"))


@query("""WITH r AS (SELECT l_orderkey AS candidate_id, l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS completed, l_returnflag = 'N' AS occurred FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber < 6),
f AS (SELECT candidate_id, first(occurred ORDER BY completed, request_id) AS occurred, count(*) AS n FROM r JOIN orders ON o_orderkey = candidate_id WHERE completed < o_orderdate + INTERVAL 60 DAY GROUP BY 1)
SELECT o_orderkey AS candidate_id, CASE WHEN n IS NULL THEN 'timed_out' WHEN occurred THEN 'published' ELSE 'rejected' END AS status, CASE WHEN n IS NULL THEN CASE o_orderkey % 4 WHEN 1 THEN 'traditional' WHEN 2 THEN 'unknown' END WHEN occurred THEN 'confirmed' END AS published FROM orders LEFT JOIN f ON o_orderkey = candidate_id""")
def reconciliation_policies(spark, d):
    """What becomes of unanswered requests by each one's policy: dropped, published as they are, published as unknown, or tried again."""
    policy = F.element_at(F.array(*map(F.lit, ("drop", "publish_traditional", "publish_unknown", "retry"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("deadline"), policy.alias("policy"))
    r = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_orderkey").alias("candidate_id"), F.col("l_shipdate").alias("completed"), (F.col("l_returnflag") == "N").alias("occurred"), (F.col("l_linestatus") != "O").alias("expired"), (F.col("l_linenumber") < 6).alias("handled"))
    return rules.reconciled(c, r, F.col("policy")).select("candidate_id", "status", "published")

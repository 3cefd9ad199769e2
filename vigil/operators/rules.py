"""Rules made of several steps: flight from a boat, gatherings, second opinions on candidates, evidence, scenes, warm-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.geometry import Box
from vigil.operators import frames, windows


def last_known(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds the last value that wasn't null, this row's included."""
    df = windows.running(rows, key, order, {"__known": ("last", value)})
    return df.withColumn(name, F.col("__known")).drop("__known")


def moving_away(people: DataFrame, length: int, share: float) -> DataFrame:
    """Adds moving_away: over the last length positions of an object, the distance to (bx, by) grew in at least this share of them, and at least
    half of length are known. people: object_id, frame_id, px, py, bx, by."""
    h = people.withColumn("__h", F.collect_list(F.struct("px", "py")).over(windows.over("object_id", "frame_id").rowsBetween(-(length - 1), 0)))
    away = lambda p: F.sqrt(F.pow(p["px"] - F.col("bx"), 2) + F.pow(p["py"] - F.col("by"), 2))
    h = h.withColumn("__d", F.transform("__h", away))
    grew = F.size(F.filter(F.zip_with(F.slice("__d", 1, F.size("__d") - 1), F.slice("__d", 2, F.size("__d")), lambda a, b: b > a), lambda g: g))
    return h.withColumn("moving_away", (F.size("__d") >= length // 2) & (grew / F.size("__d") >= share)).drop("__h", "__d")


def _near(a: tuple, b: tuple, factor: float) -> bool:
    dx, dy = max(0, b[0] - a[0] - a[2], a[0] - b[0] - b[2]), max(0, b[1] - a[1] - a[3], a[1] - b[1] - b[3])
    return (dx * dx + dy * dy) ** 0.5 < factor * max(a[2], a[3], b[2], b[3])


def _holds(a: tuple, b: tuple) -> bool:
    return a[2] > 0 < a[3] and b[2] > 0 < b[3] and a[0] <= b[0] and a[1] <= b[1] and a[0] + a[2] >= b[0] + b[2] and a[1] + a[3] >= b[1] + b[3]


def kept_gatherings(boxes: list[tuple], factor: float, least: int) -> list[tuple[int, list[int], tuple]]:
    """(person, members, box) of the gatherings that stay: the people near each person, where there are enough. One within an earlier one goes; of
    the earlier ones within a new one the last goes."""
    kept: list[tuple[int, list[int], tuple]] = []
    for i, a in enumerate(boxes):
        members = [i] + [j for j, b in enumerate(boxes) if j != i and _near(a, b, factor)]
        if len(members) < least:
            continue
        box = frames.around(*[boxes[j] for j in members])
        outer = next((n for n, k in enumerate(kept) if _holds(k[2], box)), len(kept))
        inner = [n for n, k in enumerate(kept[:outer]) if _holds(box, k[2])]
        if outer == len(kept):
            kept.append((i, members, box))
        if inner:
            del kept[inner[-1]]
    return kept


def gatherings(people: DataFrame, factor: float, least: int) -> DataFrame:
    """source_id, frame_id, anchor, size, fleeing (members that move away), x, y, w, h of each gathering that stays: kept_gatherings() as a fold over
    the array of a frame's people. people: source_id, frame_id, tracking_id, x, y, w, h, moving_away; they come from left to right, then down."""
    rows = people.dropna(subset=["source_id", "frame_id"]).groupBy("source_id", "frame_id").agg(F.sort_array(F.collect_list(F.struct("x", "y", "w", "h", "tracking_id", F.col("moving_away").cast("boolean").alias("away")))).alias("p"))
    box = lambda r: Box(r["x"], r["y"], r["w"], r["h"])
    near = lambda a, b: box(a).edge_distance(box(b)) < factor * F.greatest(a["w"], a["h"], b["w"], b["h"])

    def with_members(a: Column, i: Column) -> Column:
        return F.struct(a["tracking_id"].alias("tracking_id"), F.filter("p", lambda b, j: (i == j) | near(a, b)).alias("m"))

    def around_person(a: Column) -> Column:
        m = a["m"]
        lo = lambda c: F.array_min(F.transform(m, lambda r: r[c]))
        hi = lambda c, d: F.array_max(F.transform(m, lambda r: r[c] + r[d]))
        return F.struct(a["tracking_id"].alias("anchor"), F.size(m).cast("long").alias("size"), F.size(F.filter(m, lambda r: F.coalesce(r["away"], F.lit(False)))).cast("long").alias("fleeing"), lo("x").alias("x"), lo("y").alias("y"), (hi("x", "w") - lo("x")).alias("w"), (hi("y", "h") - lo("y")).alias("h"))

    def keep(kept: Column, g: Column) -> Column:
        # within an earlier one: it goes; of the earlier ones, up to that, that lie within it the last goes
        once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
        outer = F.array_position(F.transform(kept, lambda k: ~box(g).empty & ~box(k).empty & box(k).contains(box(g))), True)
        return F.when(F.size(kept) == 0, F.array(g)).otherwise(once(outer, lambda outer: placed(kept, g, outer, once)))

    def placed(kept: Column, g: Column, outer: Column, once) -> Column:
        before = F.when(outer > 0, F.slice(kept, 1, (outer - 1).cast("int"))).otherwise(kept)
        inner = F.array_max(F.transform(before, lambda k, i: F.when(~box(k).empty & ~box(g).empty & box(g).contains(box(k)), i)))
        grown = F.when(outer > 0, kept).otherwise(F.concat(kept, F.array(g)))
        return once(inner, lambda inner: F.when(inner.isNull(), grown).otherwise(F.filter(grown, lambda _, i: i != inner)))

    # whoever is near is looked for once, and only where there are enough the gathering is made
    found = rows.filter(F.size("p") >= least).withColumn("g", F.transform(F.filter(F.transform("p", with_members), lambda a: F.size(a["m"]) >= least), around_person)).filter(F.size("g") > 0)
    kept = F.aggregate("g", F.slice("g", 1, 0), keep)
    return found.select("source_id", "frame_id", F.explode(kept).alias("g")).select("source_id", "frame_id", "g.*")


#: What is published of a candidate that had no answer in time.
TIMEOUTS = {"drop": None, "publish_traditional": "traditional", "publish_unknown": "unknown", "retry": None}


def reconciled(candidates: DataFrame, results: DataFrame, on_timeout: str | Column = "drop") -> DataFrame:
    """candidate_id, status (published, rejected, timed_out), request_id and published of every candidate. The first result of a request counts, if
    it isn't expired and has a handler; the first of a candidate's results before its deadline decides; of results of one request and one time one that says it occurred. candidates: candidate_id, deadline; results:
    request_id, candidate_id, completed, occurred, expired, handled. on_timeout: a policy for all, or a column of the candidates. One shuffle by candidate: a request names one candidate."""
    policy = F.lit(on_timeout) if isinstance(on_timeout, str) else on_timeout
    said = F.create_map(*[F.lit(x).cast("string") for kv in TIMEOUTS.items() for x in kv])
    c, r = candidates.select("candidate_id", "deadline", F.try_element_at(said, policy).alias("__late")), results.filter("not expired and handled").select("request_id", "candidate_id", "completed", "occurred")
    first = r.join(c.drop("__late"), "candidate_id").filter("completed < deadline").groupBy("candidate_id").agg(F.min(F.struct("completed", "request_id", (~F.coalesce("occurred", F.lit(False))).alias("not"))).alias("r")).select("candidate_id", F.struct("r.request_id", (~F.col("r.not")).alias("occurred")).alias("r"))
    status = F.when(F.col("r").isNull(), "timed_out").when(F.col("r.occurred"), "published").otherwise("rejected")
    return c.join(first, "candidate_id", "left").select("candidate_id", status.alias("status"), F.col("r.request_id").alias("request_id"), F.when(status == "published", "confirmed").when(status == "timed_out", F.col("__late")).alias("published"))


def best_evidence(rows: DataFrame, key: str, order: str, known: Column, confidence: Column, area: Column, *keep: str) -> DataFrame:
    """The evidence an object ends with: a known label beats an unknown one, then confidence, then (among unknown ones) area, then the first."""
    rank = F.struct(known.cast("int").alias("k"), confidence.alias("c"), F.when(known, F.lit(0)).otherwise(area).alias("a"), (-F.col(order)).alias("o"))
    return rows.groupBy(key).agg(F.max_by(F.struct(order, *keep), rank).alias("e")).select(key, "e.*")


def dominant(rows: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Adds dominant: the most frequent value of the last n rows; of equally frequent ones the one seen first."""
    df = windows.with_context(rows, key, order, n - 1)
    h = F.collect_list(value).over(windows.over([key, "__b"], order).rowsBetween(-(n - 1), 0))
    times = lambda v: F.size(F.filter("__h", lambda x: x == v))
    best = lambda: F.array_max(F.transform("__h", times))
    return df.withColumn("__h", h).filter("not __context").withColumn("dominant", F.get(F.filter("__h", lambda v: times(v) == best()), F.lit(0))).drop("__h", "__b", "__context", "rank")


def warmed_up(rows: DataFrame, key: str, order: str, size: Column, n: int) -> DataFrame:
    """Rows after the first n of each stretch of one frame size: the n rows before such a row are of its size."""
    df = windows.with_context(rows.withColumn("__s", size), key, order, n)
    w = windows.over([key, "__b"], order).rowsBetween(-n, 0)
    df = df.withColumn("__same", (F.min("__s").over(w) == F.max("__s").over(w)) & (F.count("*").over(w) == n + 1))
    return df.filter("not __context and __same").drop("__s", "__same", "__b", "__context", "rank")


def verifications(rows: DataFrame, every: int, gain: float = 0.03) -> DataFrame:
    """Rows of an object that ask for verification: its first, and on each every-th row one that beats the best before it by over gain."""
    w = windows.over("object_id", "frame_id")
    best = F.max("quality").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = rows.withColumn("__n", F.row_number().over(w)).withColumn("__best", best)
    return df.filter((F.col("__n") == 1) | ((F.col("__n") % every == 0) & (F.col("quality") > F.col("__best") + gain))).drop("__n", "__best")

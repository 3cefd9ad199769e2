"""Sequence operators: per key, in order of position or time, by window functions alone.

What runs over all of a source's history (running sums, ranks, runs, moving windows) goes by blocks of frame numbers or hours: each block
is worked on by itself, one row a block carries what the blocks before it come to, so that no task sorts a source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

#: Frame numbers of one block.
BLOCK = 4096


def over(key: str | list[str], *order) -> Window:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def block_of(rows: DataFrame, order: str, size: int = BLOCK) -> Column:
    """The block of a row: so many frame numbers, or of times an hour."""
    if isinstance(rows.schema[order].dataType, (TimestampType, TimestampNTZType)):
        return F.floor(F.unix_micros(F.col(order).cast("timestamp")) / 3_600_000_000)
    return F.floor(F.col(order) / size)


def _with_carried(df: DataFrame, keys: list[str], carried: DataFrame) -> DataFrame:
    """df with the columns of carried (keys and __block in the first places), null keys included."""
    names = carried.columns[len(keys) + 1 :]
    c = carried.toDF(*(f"__k{i}" for i in range(len(keys) + 1)), *names)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__block"])])
    return df.join(c, same).drop(*c.columns[: len(keys) + 1])


def running(rows: DataFrame, key: str | list[str], order: str, values: dict[str, tuple[str, Column]], strict: bool = False, size: int = BLOCK) -> DataFrame:
    """Adds columns: of each name the sum, max, min or last (that isn't null) of a value over a key's rows up to this one (strict: before it)."""
    keys = [key] if isinstance(key, str) else key
    df = rows.withColumn("__block", block_of(rows, order, size)).withColumns({f"__v_{n}": v for n, (_, v) in values.items()})
    inside = over([*keys, "__block"], order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    before = over(keys, "__block").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    total = {**fold, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))}
    sums = df.groupBy(*keys, "__block").agg(*[total[f](f"__v_{n}").alias(f"__t_{n}") for n, (f, _) in values.items()])
    carried = sums.select(*keys, "__block", *[fold[f](f"__t_{n}").over(before).alias(f"__c_{n}") for n, (f, _) in values.items()])
    df = _with_carried(df.withColumns({f"__i_{n}": fold[f](f"__v_{n}").over(inside) for n, (f, _) in values.items()}), keys, carried)
    both = {"sum": lambda i, c: F.when(i.isNotNull() | c.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0))), "max": F.greatest, "min": F.least, "last": F.coalesce}
    df = df.withColumns({n: both[f](F.col(f"__i_{n}"), F.col(f"__c_{n}")) for n, (f, _) in values.items()})
    return df.drop("__block", *[f"__{x}_{n}" for x in "vic" for n in values])


def ranked(rows: DataFrame, key: str | list[str], order: str, name: str = "rank") -> DataFrame:
    """Adds the place of a row, from 1, among a key's rows."""
    return running(rows, key, order, {name: ("sum", F.lit(1).cast("long"))})


def with_context(rows: DataFrame, key: str | list[str], order: str, before: int, size: int = BLOCK) -> DataFrame:
    """Adds rank, __b (a block of ranks) and __context: the last `before` rows of a block stand in the next one too, so that a window of so many
    rows before each row lies in one block. The caller drops the rows of __context."""
    size = max(size, 2 * before)
    at = (F.col("rank") - 1) % size
    b = F.floor((F.col("rank") - 1) / size)
    mine, next_one = F.struct(b.alias("b"), F.lit(False).alias("context")), F.struct((b + 1).alias("b"), F.lit(True).alias("context"))
    df = ranked(rows, key, order).withColumn("__at", F.explode(F.when(at >= size - before, F.array(mine, next_one)).otherwise(F.array(mine))))
    return df.withColumns({"__b": F.col("__at.b"), "__context": F.col("__at.context")}).drop("__at")


def expiry(sight: DataFrame, frames: int, ends: DataFrame, flush: bool = False) -> DataFrame:
    """object_id, frame_id (of its last sighting), expired_at: the frame that pushes it out of a window of so many frames.
    An object expires unless it is seen again within the window. ends: source_id, last_frame. flush: at the end of the stream the objects that
    are still in the window expire too, once each, with the last frame."""
    nxt = F.lead("frame_id").over(over("object_id", "frame_id"))
    gone = sight.select("source_id", "object_id", "frame_id", nxt.alias("__next")).filter(F.col("__next").isNull() | (F.col("__next") - F.col("frame_id") >= frames))
    gone = gone.join(ends, "source_id").withColumn("expired_at", F.col("frame_id") + frames)
    if flush:
        gone = gone.withColumn("expired_at", F.least("expired_at", "last_frame"))
    return gone.filter(F.col("expired_at") <= F.col("last_frame")).select("source_id", "object_id", "frame_id", "expired_at")


def alive(sight: DataFrame, source: str, frame: int, frames: int) -> DataFrame:
    """The objects of a source that are in the window of so many frames that ends with a frame, and the frames of it that hold each."""
    held = sight.filter((F.col("source_id") == source) & (F.col("frame_id") > frame - frames) & (F.col("frame_id") <= frame))
    return held.groupBy("object_id").agg(F.array_sort(F.collect_set("frame_id")).alias("frame_ids"))


def sessions(sight: DataFrame, frames: int) -> DataFrame:
    """Adds session_no: a new one after a gap of so many frames or more."""
    w = over("object_id", "frame_id")
    gap = F.coalesce((F.col("frame_id") - F.lag("frame_id").over(w) >= frames).cast("int"), F.lit(0))
    return sight.withColumn("__new", gap).withColumn("session_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def running_best(rows: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Rows that beat everything before them."""
    before = F.max(score).over(over(key, order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col(score) > F.col("__before"))).drop("__before")


def top_scores(rows: DataFrame, key: str, order: str, score: str, n: int) -> DataFrame:
    """The n highest distinct scores of a key; of equal scores the last row."""
    last = rows.groupBy(key, score).agg(F.max(order).alias(order))
    return last.withColumn("rank", F.row_number().over(over(key, F.desc(score)))).filter(F.col("rank") <= n)


def runs(rows: DataFrame, key: str, order: str, flag: Column, size: int = BLOCK) -> DataFrame:
    """Adds run_start (the order of the run's first row) and run_length (rows of the run so far), within unbroken runs of flag; null where it is false.

    Of each block one row carries: how many rows it has, its last row that breaks a run, and where the run starts that is open at its end."""
    df = rows.withColumns({"__flag": F.coalesce(flag, F.lit(False)), "__block": block_of(rows, order, size)})
    inside = over([key, "__block"], order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"__n": F.row_number().over(inside).cast("long"), "__next": F.lead(order).over(inside)})
    df = df.withColumns({"__broken": F.max(F.when(~F.col("__flag"), F.col("__n"))).over(upto), "__start": F.max(F.when(~F.col("__flag"), F.col("__next"))).over(upto)})
    blocks = df.groupBy(key, "__block").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max("__broken").alias("broken"), F.max_by("__flag", order).alias("open"), F.max("__start").alias("start"))
    w = over(key, "__block")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"before": F.coalesce(F.sum("n").over(prior), F.lit(0)), "tail": F.when(F.col("broken").isNotNull(), F.when(F.col("open"), F.col("start")).otherwise(F.lead("first").over(w)))})
    carried = blocks.select(key, "__block", F.col("before").alias("__before"), F.max(F.col("before") + F.col("broken")).over(prior).alias("__broken_before"), F.coalesce(F.last("tail", ignorenulls=True).over(prior), F.min("first").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("__start_before"))
    df = _with_carried(df, [key], carried)
    length = F.col("__before") + F.col("__n") - F.coalesce(F.col("__before") + F.col("__broken"), F.col("__broken_before"), F.lit(0))
    df = df.withColumns({"run_start": F.when(F.col("__flag"), F.coalesce(F.when(F.col("__broken").isNotNull(), F.col("__start")), F.col("__start_before"))), "run_length": F.when(F.col("__flag"), length)})
    return df.drop("__flag", "__block", "__n", "__next", "__broken", "__start", "__before", "__broken_before", "__start_before")


def lasting(rows: DataFrame, key: str, order: str, ts: str, flag: Column, seconds: int) -> DataFrame:
    """Rows of runs of flag that have lasted so many seconds by their times, with duration in seconds. With 0 or less there are none."""
    if seconds <= 0:
        return rows.withColumn("duration", F.lit(0.0)).limit(0)
    times = rows.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    df = runs(times, key, order, flag)
    starts = df.filter(F.col("run_start") == F.col(order)).select(F.col(key).alias("__k"), F.col("run_start").alias("__s"), F.col("__us").alias("__first"))
    df = df.filter("run_start is not null").join(starts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("run_start") == F.col("__s")))
    df = df.withColumn("duration", (F.col("__us") - F.col("__first")) / 1e6).filter(F.col("duration") >= seconds)
    return df.drop("__us", "__k", "__s", "__first")


def stable(rows: DataFrame, key: str, order: str, state: str, threshold: int) -> DataFrame:
    """Rows at which a state has lasted threshold rows, once a stay."""
    w = over(key, order)
    changed = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(0))
    df = rows.withColumn("__c", changed).withColumn("__island", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("__n", F.row_number().over(over([key, "__island"], order))).filter(F.col("__n") == threshold).drop("__c", "__island", "__n")


def tumbling_count(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Adds batch_no; an incomplete last batch goes."""
    df = ranked(rows, key, order, "__n").withColumn("batch_no", F.floor((F.col("__n") - 1) / size))
    return df.withColumn("__size", F.count("*").over(Window.partitionBy(key, "batch_no"))).filter(F.col("__size") == size).drop("__n", "__size")


def clip_half(seconds: float, rate: float) -> int:
    """How many frames a clip takes on either side of its anchor."""
    return int(seconds * rate) // 2


def clip(frames: DataFrame, anchors: DataFrame, half: int) -> DataFrame:
    """The frames within half ranks of each anchor frame of the same source: an equi join on blocks of ranks, not a range join."""
    at_rank = ranked(frames, "source_id", "frame_id").withColumn("__block", F.floor(F.col("rank") / (half + 1)))
    at = at_rank.select("source_id", "frame_id", F.col("rank").alias("__at")).join(anchors, ["source_id", "frame_id"]).select("source_id", F.col("frame_id").alias("anchor"), "__at", F.explode(F.sequence(F.floor((F.col("__at") - half) / (half + 1)), F.floor((F.col("__at") + half) / (half + 1)))).alias("__block"))
    return at_rank.join(at, ["source_id", "__block"]).filter(F.abs(F.col("rank") - F.col("__at")) <= half).select("source_id", "anchor", "frame_id")


def ttl_flags(rows: DataFrame, key: str, order: str, flags: dict[str, tuple[Column, int]]) -> DataFrame:
    """Adds flags: of each name one that stays set for so many seconds after its condition last held (no longer at that very instant)."""
    df = running(rows, key, order, {f"__last_{n}": ("max", F.when(flag, F.col(order))) for n, (flag, _) in flags.items()})
    active = {n: F.coalesce(F.unix_micros(F.col(order)) < F.unix_micros(f"__last_{n}") + seconds * 1_000_000, F.lit(False)) for n, (_, seconds) in flags.items()}
    return df.withColumns(active).drop(*[f"__last_{n}" for n in flags])


def positions(frames: DataFrame, block: int = 4096) -> DataFrame:
    """Adds pos: the place, from 1, of each (frame_id, source_id) in the arrival order of all sources. No task ranks all frames: blocks of frame numbers
    are counted, the counts (a row a block) are summed up, and each block ranks its own frames. frames: distinct source_id, frame_id."""
    df = frames.withColumn("__block", F.floor(F.col("frame_id") / block))
    sums = df.groupBy("__block").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    return df.join(sums.select("__block", "__before"), "__block").withColumn("pos", F.col("__before") + F.row_number().over(over("__block", "frame_id", "source_id"))).drop("__block", "__before")


def global_expiry(sight: DataFrame, window: int) -> DataFrame:
    """source_id, object_id, pos (of the last sighting), expired_at: the window holds so many frames of all sources, and the oldest leaves before the newest
    is looked at, so that an object seen again in just that frame has expired."""
    frames = positions(sight.select("source_id", "frame_id").distinct())
    last = frames.agg(F.max("pos").alias("__end"))
    s = sight.select("source_id", "frame_id", "object_id").distinct().join(frames, ["source_id", "frame_id"])
    nxt = F.lead("pos").over(over("object_id", "pos"))
    gone = s.withColumn("__next", nxt).filter(F.col("__next").isNull() | (F.col("__next") - F.col("pos") >= window))
    return gone.crossJoin(last).filter(F.col("pos") + window <= F.col("__end")).select("source_id", "object_id", "pos", (F.col("pos") + window).alias("expired_at"))  # one row is sent

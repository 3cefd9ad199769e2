"""Frame, detection and object streams over relational tables, and the region dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.operators import windows

WIDTH, HEIGHT = 1920, 1080


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(stored: DataFrame, name: str = "place") -> DataFrame:
    """Adds where in the table's files a row stands: places are in the order of the table."""
    return stored.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def detections(spark: SparkSession, sf_dir: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """One row per detection. Only the columns asked for are read from the table. frames: from one number to another; they are a range of the stored key, so that the reader skips files and row
    groups beyond it."""
    lines = table(spark, sf_dir, "lineitem")
    if frames is not None:
        lines = lines.filter(F.col("l_orderkey").between(4 * frames[0], 4 * frames[1] + 3))
    return detections_of(lines)


def detections_of(lines: DataFrame, *keep: str) -> DataFrame:
    """The same of a table, or stream, of lines; keep: what else of them."""
    k, c = F.col("l_orderkey"), F.col
    return lines.select(
        F.concat(F.lit("cam-"), (k % 4).cast("string")).alias("source_id"),
        F.expr("l_orderkey div 4").alias("frame_id"),
        F.when(c("l_returnflag") == "A", "person").when(c("l_returnflag") == "N", "boat").otherwise("car").alias("label"),
        (c("l_partkey") % 20 + 1).cast("int").alias("tracking_id"),
        (F.round(c("l_extendedprice") * 100).cast("long") % 1000 / 1000.0).alias("confidence"),
        ((c("l_partkey") * 37) % 1700).cast("int").alias("x"),
        ((c("l_suppkey") * 53 + c("l_linenumber") * 97) % 900).cast("int").alias("y"),
        (20 + c("l_quantity") * 4).cast("int").alias("w"),
        (20 + (k * 7 + c("l_linenumber") * 31) % 160).cast("int").alias("h"),
        *keep,
    )


#: The same view for the independent engine.
DETECTIONS_SQL = """det AS (SELECT 'cam-' || (l_orderkey % 4) AS source_id, l_orderkey // 4 AS frame_id,
  CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN 'boat' ELSE 'car' END AS label, (l_partkey % 20 + 1)::INT AS tracking_id,
  (round(l_extendedprice * 100)::BIGINT % 1000) / 1000.0 AS confidence, ((l_partkey * 37) % 1700)::INT AS x,
  ((l_suppkey * 53 + l_linenumber * 97) % 900)::INT AS y, trunc(20 + l_quantity * 4)::INT AS w, (20 + (l_orderkey * 7 + l_linenumber * 31) % 160)::INT AS h FROM lineitem)"""


def sightings(dets: DataFrame) -> DataFrame:
    """One row per source, frame, label and track: the best detection (confidence, then the largest box, then place)."""
    best = F.max(F.struct("confidence", "w", "h", "x", "y")).alias("b")
    return dets.groupBy("source_id", "frame_id", "label", "tracking_id").agg(best).select("source_id", "frame_id", "label", "tracking_id", F.concat_ws("_", "source_id", "label", "tracking_id").alias("object_id"), "b.*")


SIGHTINGS_SQL = DETECTIONS_SQL + """, sight AS (SELECT *, source_id || '_' || label || '_' || tracking_id AS object_id FROM det
  QUALIFY row_number() OVER (PARTITION BY source_id, frame_id, label, tracking_id ORDER BY confidence DESC, w DESC, h DESC, x DESC, y DESC) = 1)"""


def object_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings: object, name, event time, score, JSON payload."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("object_id"), F.col("event_type").alias("event_name"), F.col("value").alias("score"), "props")


def stride(frames: DataFrame, every: int) -> DataFrame:
    """Every n-th frame of a source, counting from 1."""
    return windows.ranked(frames, "source_id", "frame_id", "__n").filter(F.col("__n") % every == 0).drop("__n")


def gap_fill(frames: DataFrame, block: int = 4096) -> DataFrame:
    """Every frame number between a source's first and last; is_blank marks those that stood in no row. Numbers are made block by block."""
    ends = frames.groupBy("source_id").agg(F.min("frame_id").alias("a"), F.max("frame_id").alias("b"))
    blocks = ends.select("source_id", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))).alias("n")).repartition("source_id", "n")
    span = blocks.select("source_id", F.explode(F.sequence(F.greatest("a", F.col("n") * block), F.least("b", F.col("n") * block + block - 1))).alias("frame_id"))
    return span.join(frames.withColumn("__there", F.lit(True)), ["source_id", "frame_id"], "left").withColumn("is_blank", F.col("__there").isNull()).drop("__there")


def seek(frames: DataFrame, source: str, first: int, last: int | None = None, by: str = "frame_id") -> DataFrame:
    """A positioned scan from a frame number, or with by="offset_ms" from a time: the range reaches the reader as a pushed filter."""
    here = F.col("source_id") == source
    return frames.filter(here & (F.col(by) >= first) if last is None else here & F.col(by).between(first, last))


def last_n(rows: DataFrame, n: int, key: str, order: str) -> DataFrame:
    """What a queue of n that overwrites its oldest holds at the end."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("__n") <= n).drop("__n")


def pixels(points: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """Normalised points in pixels, rounded half to even."""
    return [(round(WIDTH * x), round(HEIGHT * y)) for x, y in points]


def polygon(points: list[tuple[float, float]]) -> Column:
    """Normalised points as a literal array of pixels, rounded half to even."""
    return F.array(*[F.struct(F.bround(F.lit(WIDTH * x)).cast("double").alias("x"), F.bround(F.lit(HEIGHT * y)).cast("double").alias("y")) for x, y in points])

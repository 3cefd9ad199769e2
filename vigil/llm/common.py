"""Shared plumbing of the training-data operators: the shared folder, written tables, sizes, packed hash exchange."""

from __future__ import annotations

import math
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.sources.shared import clean, delete, run_dir

__all__ = ["clean", "delete", "run_dir"]

#: Separators of words, for Java's regular expressions; bytes.split() uses the same six characters.
WHITE = "[\\x20\\x09-\\x0D]+"


def written_at(df: DataFrame, name: str) -> str:
    """The path of df as a table in the shared folder."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and outlives any executor."""
    return df.sparkSession.read.schema(df.schema).parquet(written_at(df, name))


def size_in_bytes(df: DataFrame) -> int:
    """What the optimizer knows of df's size; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, target_mb: int = 16) -> int:
    """Partitions of about target_mb of text each, and no fewer than the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = size_in_bytes(df)
    if size > 1 << 60:  # unknown to the optimizer
        size = int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    return max(least, math.ceil(2 * size / (target_mb << 20)))


def text_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the whole text as UTF-8 (null: empty): other columns, of any name, never come near an operator."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def positional(docs: DataFrame) -> DataFrame:
    """docs with its columns called c0, c1 and so on: names with dots, or equal to those of an operator, can't clash."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def place_of(docs: DataFrame, name: str) -> str:
    """The column's name in positional()."""
    return f"c{docs.columns.index(name)}"


def replaced(batch: pa.RecordBatch, names: list[str], new: list[str | None]) -> pa.RecordBatch:
    """batch, of positional() columns called so before, with the new texts where there are any, and n_chars, if it is a whole number, to match."""
    if all(t is None for t in new):
        return batch
    columns, i = list(batch.columns), names.index("text")
    columns[i] = pa.array([o if t is None else t for o, t in zip(columns[i].to_pylist(), new, strict=True)], columns[i].type)
    if "n_chars" in names and pa.types.is_integer(columns[n := names.index("n_chars")].type):
        columns[n] = pa.array([o if t is None else len(t) for o, t in zip(columns[n].to_pylist(), new, strict=True)], columns[n].type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def with_new_texts(docs: DataFrame, change: Callable[[Iterator[tuple[bytes]]], Iterator[str | None]]) -> DataFrame:
    """docs, all rows and columns, with what change says of each text (None: it stays). change may read ahead of what it says."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def texts() -> Iterator[tuple[bytes]]:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    for t in batch.column(names.index("text")):
                        yield ((t.as_py() or "").encode(),)

        got: list[str | None] = []
        for new in change(texts()):
            got.append(new)
            if len(got) == waiting[0].num_rows:
                yield replaced(waiting.popleft(), names, got)
                got = []

    rows = positional(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*names)


def held_out(remainder: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows, one at a time: a list of a whole batch's texts would hold it twice."""
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(x.as_py() for x in row)


class Out:
    """Gathers rows and gives record batches of a bounded number of rows and bytes."""

    def __init__(self, schema: pa.Schema, rows: int = 4096, size: int = 8 << 20):
        self.schema, self.most, self.size, self.rows, self.held = schema, rows, size, [], 0

    def add(self, row: tuple, weight: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += weight
        if len(self.rows) >= self.most or self.held >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows, self.held = [], 0


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))

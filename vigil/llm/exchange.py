"""Counts of 64-bit (or two times 64-bit) hashes over a whole corpus, exchanged in packed form.

Documents are dealt into buckets by their id and content, so that neither null nor repeated ids meet in one. A task that reads documents gathers the distinct hashes of each bucket
and sends them to the hash's partition as bytes, not as rows; the partition sorts them with numpy and answers each bucket with what it
asked about. A hash that stands in every document costs one entry per task and bucket, so no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashes that a task holds before it sends them.
HELD = 2_000_000


def bucket_of(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def unique_counts(keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct rows of keys (a vector, or rows of two) with their counts added up; of more, the largest."""
    flat = keys if keys.ndim == 1 else None
    order = np.argsort(keys, kind="stable") if flat is not None else np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    change = keys[1:] != keys[:-1]
    new = np.concatenate([[True], change if flat is not None else change.any(1)]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    if not len(at):
        return keys, counts, *more
    return keys[at], np.add.reduceat(counts[order], at), *(np.maximum.reduceat(m[order], at) for m in more)


#: One row per task and hash partition: runs of entries by bucket.
PACKED = "p int, buckets binary, lengths binary, keys binary, counts binary"
PACKED_SCHEMA = pa.schema([("p", pa.int32()), *((x, pa.binary()) for x in ("buckets", "lengths", "keys", "counts"))])


def packed(part: np.ndarray, bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED. keys: [n, bytes]; counts: [n], of a type that holds them."""
    if not len(part):
        return
    order = np.lexsort((bucket, part))
    part, bucket, keys, counts = part[order], bucket[order], keys[order], counts[order]
    run = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1])]))
    first = np.flatnonzero(np.concatenate([[True], part[run][1:] != part[run][:-1]]))  # of each partition, among the runs
    lengths = np.diff(np.append(run, len(part)))
    rows, held = [], 0
    for i, j in zip(first, [*first[1:], len(run)], strict=True):
        a, b = run[i], run[j] if j < len(run) else len(part)
        rows.append({"p": int(part[a]), "buckets": bucket[run[i:j]].astype("<i4").tobytes(), "lengths": lengths[i:j].astype("<i4").tobytes(), "keys": np.ascontiguousarray(keys[a:b]).tobytes(), "counts": counts[a:b].tobytes()})
        held += b - a
        if held >= 500_000:
            yield pa.RecordBatch.from_pylist(rows, schema=PACKED_SCHEMA)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=PACKED_SCHEMA)


def buckets_of(t: pa.Table) -> np.ndarray:
    """The bucket of each entry of a partition's rows."""
    flat = lambda c: np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in t[c]])
    return np.repeat(flat("buckets"), flat("lengths"))

"""Exact substring dedup by fixed-block anchors.

Index: the non-overlapping blocks of BLOCK words of every document. Probes: every rolling window of BLOCK words of every
document. Every window of 35 words contains one whole block of its document, so a window that occurs twice has a block
that some other probe hits. A hit block is extended word by word: the windows of 35 words that hold it are looked up, by
128-bit hashes, among all windows held by hit blocks; runs of windows found twice or more are the maximal exact repeats.
Their words go. Both lookups run over packed hashes by hash partition (see exchange), so a passage that stands in a third
of all documents costs one entry per task and bucket; no pairs of its occurrences are ever made.

The choice of block: a 35-word window holds a whole aligned block of B words if 2 * B - 1 <= 35, hence 18.

Defined cases: null texts have no words; texts shorter than a window lose nothing; repeated rows and equal documents lose
all that they share; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import mix, parts_for, place_of, positional, replaced, rows_of, text_bytes, written
from vigil.llm.exchange import HELD, PACKED, PACKED_SCHEMA, bucket_of, buckets_of, packed, unique_counts

WINDOW = 35
_R1, _R2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r ** i and r ** -i mod 2 ** 64 for i < n at least."""
    have = _powers.get(r)
    if have is None or len(have[0]) < n:
        n, inverse = max(n, 4096), pow(r, -1, 1 << 64)
        grow = lambda x: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, np.uint64(x)))])
        have = _powers[r] = grow(r), grow(inverse)
    return have


def rolling(h: np.ndarray, size: int, r: int = _R1) -> np.ndarray:
    """A polynomial hash of each window of size word hashes, one pass."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    up, down = _power(r, len(h))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix((total[size:] - total[:-size]) * down[: len(h) - size + 1])


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """The two lanes of a window's 128 bits rest on two hashes of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)) if seed else map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def block_size(window: int) -> int:
    return (window + 1) // 2


def _probes(window: int, parts: int):
    """(text, b) -> packed hashes of every rolling window; in counts, bit 7 marks that a block of the index is among them."""
    size = block_size(window)

    def send(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        keys, counts, bucket = [], [], []
        for b, pieces in held.items():
            k, n, block = unique_counts(np.concatenate([x[0] for x in pieces]), np.ones(sum(len(x[0]) for x in pieces), np.int64), np.concatenate([x[1] for x in pieces]))
            keys.append(k)
            counts.append((np.minimum(n, 2) | (block.astype(np.int64) << 7)).astype(np.uint8))
            bucket.append(np.full(len(k), b, np.int32))
        if keys:
            k = np.concatenate(keys)
            # the low 16 bits go: the rest tells apart far more hashes than a partition holds, and a rare false hit only costs a lookup
            short = k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
            yield from packed(((k >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32), np.concatenate(bucket), short, np.concatenate(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = 0
        for text, b in rows_of(batches):
            words = text.split()
            if len(words) < window:
                continue
            keys = rolling(word_hashes(words), size)
            held.setdefault(b, []).append((keys, np.arange(len(keys)) % size == 0))
            n += len(keys)
            if n >= HELD:
                yield from send(held)
                held, n = {}, 0
        yield from send(held)

    return run


def _unpack48(raw: bytes) -> np.ndarray:
    k = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(k), 8), np.uint8)
    out[:, 2:] = k
    return out.view("<u8")[:, 0]


def _answer(p: pa.Table, wide: bool) -> pa.Table:
    """What one hash partition answers: for each bucket, its hashes that occur twice or more (and, of narrow ones, that a block has)."""
    keys = np.concatenate([np.frombuffer(x.as_py(), "<u8").reshape(-1, 2) if wide else _unpack48(x.as_py()) for x in p["keys"]])
    raw = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in p["counts"]])
    bucket = buckets_of(p)
    found, total, block = unique_counts(keys, (raw & 127).astype(np.int64), raw >> 7)
    good = found[(total > 1) & (wide | (block > 0))]
    hit = _among(keys[:, 0], keys[:, 1], _halves(good)) if wide else _within(keys, good)
    keys, bucket = keys[hit], bucket[hit]
    order = np.lexsort((keys[:, 1], keys[:, 0], bucket) if wide else (keys, bucket))
    keys, bucket = keys[order], bucket[order]
    same = (keys[1:] == keys[:-1]).all(1) if wide else keys[1:] == keys[:-1]
    new = np.append(True, ~same | (bucket[1:] != bucket[:-1]))[: len(keys)]
    keys, bucket = keys[new], bucket[new]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    return pa.table({"b": pa.array(bucket[at].astype(np.int32)), "keys": pa.array([k.tobytes() for k in np.split(keys, at[1:])] if len(at) else [], pa.binary())}, schema=pa.schema([("b", pa.int32()), ("keys", pa.binary())]))


def _answers(rows: DataFrame, wide: bool) -> DataFrame:
    return rows.groupBy("p").applyInArrow(lambda t: _answer(t, wide), "b int, keys binary")


def _keys_of(hits: pa.Table, wide: bool) -> np.ndarray:
    """The keys that a bucket was told, in order, each once: each partition told its own ones so, and no two the same."""
    blobs = [np.frombuffer(x.as_py(), "<u8") for x in hits["keys"]]
    flat = np.concatenate(blobs) if blobs else np.zeros(0, np.uint64)
    if not wide:
        return np.unique(flat)
    rows = flat.reshape(-1, 2)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1])


def _within(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(keys):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def _extend(window: int, parts: int):
    """A bucket's documents and its hit blocks -> packed hashes of the windows that hold them."""
    size = block_size(window)
    low = np.uint64(_MASK ^ 0xFFFF)

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs.num_rows or not hits.num_rows:
            return PACKED_SCHEMA.empty_table()
        known, out = _keys_of(hits, False), []
        for text in docs["text"]:
            words = text.as_py().split()
            if len(words) < window:
                continue
            h = word_hashes(words)
            blocks = rolling(h, size)[::size]
            at = np.flatnonzero(_within(blocks & low, known)) * size
            if len(at):
                n = len(h) - window + 1
                starts = np.unique((at[:, None] - np.arange(window - size + 1)).ravel())
                starts = starts[(starts >= 0) & (starts < n)]
                out.append(np.stack([rolling(h, window)[starts], rolling(word_hashes(words, 1), window, _R2)[starts]], 1))
        if not out:
            return PACKED_SCHEMA.empty_table()
        keys = np.concatenate(out)
        keys, n = unique_counts(keys, np.ones(len(keys), np.int64))
        bucket = np.full(len(keys), docs["b"][0].as_py(), np.int32)
        part = (keys[:, 0] % np.uint64(parts)).astype(np.int32)
        return pa.Table.from_batches(packed(part, bucket, keys.view(np.uint8).reshape(-1, 16), np.minimum(n, 2).astype(np.uint8)), PACKED_SCHEMA)

    return run


def _among(one: np.ndarray, two: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which pairs of (one, two) are known; known: the two halves of rows in order, each in one piece, as a search in a column would copy it."""
    first, second = known
    if not len(first) or not len(one):
        return np.zeros(len(one), bool)
    lo, hi = np.searchsorted(first, one), np.searchsorted(first, one, side="right")
    hit = (second[np.minimum(lo, len(first) - 1)] == two) & (hi > lo)
    for i in np.flatnonzero(hi - lo > 1):  # several rows of one first half
        hit[i] = two[i] in second[lo[i] : hi[i]]
    return hit


def _kept(words: list[bytes], known: tuple[np.ndarray, np.ndarray], window: int) -> np.ndarray:
    """Which words stay; known: the windows found twice or more."""
    gone = np.zeros(len(words) + 1, np.int64)
    if len(words) >= window and len(known[0]):
        one = rolling(word_hashes(words), window)
        at = np.flatnonzero(_within(one, known[0]))
        if len(at):
            start, stop = int(at[0]), int(at[-1]) + window  # no other word takes part
            two = rolling(word_hashes(words[start:stop], 1), window, _R2)
            at = at[_among(one[at], two[at - start], known)]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
    return np.cumsum(gone)[:-1] == 0


def _known(hits: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _halves(_keys_of(hits, True) if hits.num_rows else np.zeros((0, 2), np.uint64))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _digest(window: int):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        known, out = _known(hits), []
        for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
            words = text.as_py().split()
            left = _kept(words, known, window)
            n = len(words) - int(left.sum())
            kept = b" ".join(compress(words, left.tolist()) if n else words)
            out.append((doc.as_py(), len(words), n, hashlib.sha256(kept).hexdigest()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RESULT.types, strict=True)], schema=RESULT) if out else RESULT.empty_table()

    return run


def _repeats(texts: DataFrame, window: int, parts: int) -> DataFrame:
    """b, keys: what each bucket needs to know of the windows that are found twice or more. texts: text (as bytes), b."""
    hits = written(_answers(texts.mapInArrow(_probes(window, parts), PACKED), False), "anchors")
    candidates = texts.groupBy("b").cogroup(hits.groupBy("b")).applyInArrow(_extend(window, parts), PACKED)
    return written(_answers(candidates, True), "repeats")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the hex digest of the kept words) of every document."""
    parts = parts_for(docs.select("text"))
    texts = text_bytes(docs).withColumn("b", bucket_of(parts, "doc_id", "text"))
    repeats = _repeats(texts.select("text", "b"), window, parts)
    return texts.groupBy("b").cogroup(repeats.groupBy("b")).applyInArrow(_digest(window), "doc_id long, n_words long, n_removed long, kept string")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all rows and columns, with the repeats gone from the texts (their other words joined by one blank) and n_chars, where there is
    one, to match; texts without any stay as they are."""
    parts, names = parts_for(docs.select("text")), docs.columns
    rows, text = positional(docs), place_of(docs, "text")
    dealt = rows.withColumn("b", bucket_of(parts, *([place_of(docs, "doc_id")] if "doc_id" in names else []), text))
    texts = dealt.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), "b")

    def run(some: pa.Table, hits: pa.Table) -> pa.Table:
        known, new = _known(hits), []
        for t in some[text]:
            words = (t.as_py() or "").encode().split()
            left = _kept(words, known, window)
            new.append(None if left.all() else b" ".join(compress(words, left.tolist())).decode())
        some = some.drop_columns(["b"]).combine_chunks()
        return pa.Table.from_batches([replaced(x, names, new) for x in some.to_batches()], some.schema) if len(new) else some

    return dealt.groupBy("b").cogroup(_repeats(texts, window, parts).groupBy("b")).applyInArrow(run, rows.schema).toDF(*names)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS i) WHERE len(ws) >= 35),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
k AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM g GROUP BY doc_id),
u AS (SELECT d.doc_id, p, ws[p] AS word FROM d JOIN k USING (doc_id), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS p)),
left_over AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS t FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.p = g.p GROUP BY u.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN k.n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

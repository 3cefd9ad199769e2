"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of documents in one task, of at least SHARD_WORDS words (the last one of a task may have less; a longer document is a
shard by itself). All its words are indexed, over the shard's own vocabulary, with a separator after each document: a suffix array, its
Burrows-Wheeler transform in a wavelet matrix with ranks, and suffix positions sampled every SAMPLE words and at each document's start.
The benchmark (the stated query set) stands as a table in the shared folder; a task reads it in blocks of bounded size and searches the
windows of every block in the shard's one index: backward, all at once. Occurrences are located by walking back to a sampled
position; their spans are merged.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case. A window is 10 consecutive words
of an item; an item of fewer words, but not none, is one window.

Defined cases: null texts have no words; an item without words never occurs; equal item ids count once, a null id as the empty one;
repeated documents give a row each; no benchmark or no documents: no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Out, rows_of, size_in_bytes, text_bytes, with_new_texts, written_at

WINDOW, SHARD_WORDS, SAMPLE = 10, 400_000, 8
#: Bytes of benchmark text, and of shard text, that a task holds at once.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
#: A-Z to lower case, other ASCII that isn't a letter or digit to a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


#: A block of the benchmark, made ready: its items, its vocabulary, the distinct windows as ids of it (from 1; zeros on the left), and which items have each: ends and places of items.
PREPARED = pa.schema([("items", pa.list_(pa.string())), ("words", pa.binary()), ("padded", pa.binary()), ("ends", pa.binary()), ("of", pa.binary())])


def prepared(items: list[tuple[str, bytes]], window: int = WINDOW) -> dict:
    names = sorted({i for i, _ in items})
    place = {x: n for n, x in enumerate(names)}
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            found.setdefault(tuple(ids[at : at + window]), set()).add(place[item])
    padded = np.zeros((len(found), window), "<i4")  # at the right, as the search runs backward
    for n, w in enumerate(found):
        padded[n, window - len(w) :] = w
    of = [sorted(x) for x in found.values()]
    return {"items": names, "words": b" ".join(vocabulary), "padded": padded.tobytes(), "ends": np.cumsum([len(x) for x in of], dtype="<i8").tobytes(), "of": np.array(list(chain(*of)), "<i4").tobytes()}


class Queries:
    """The distinct windows of a block of items, as ids of the items' vocabulary (from 1)."""

    def __init__(self, row: dict, window: int = WINDOW):
        self.items, self.words = row["items"], row["words"].split()
        self.padded = np.frombuffer(row["padded"], "<i4").reshape(-1, window).astype(np.int64)
        self.lengths = (self.padded > 0).sum(1)
        self.of = np.split(np.frombuffer(row["of"], "<i4"), np.frombuffer(row["ends"], "<i8")[:-1]) if len(self.padded) else []

    def in_shard(self, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """The windows whose words all stand in the shard, in the shard's ids, and their numbers."""
        own = np.fromiter(chain([0], map(vocabulary.get, self.words, repeat(-1))), np.int64, len(self.words) + 1)
        padded = own[self.padded]
        which = np.flatnonzero((padded >= 0).all(1))
        return padded[which], which


class FMIndex:
    """Over words (ids from 1) with separators (0), the last of which ends the text. Positions count from the text's start."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        gap = words == 0
        self.n, suffix = n, _suffixes(words, gap)
        bwt = words[suffix - 1]  # before the first position stands the last, a separator
        self.before = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=1))])  # words less than w
        self.levels = max(1, int(words.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1 == 1
            self.ones.append(np.append(np.int32(0), np.cumsum(bit, dtype=np.int32)))
            self.zeros.append(n - int(self.ones[-1][-1]))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        start = np.append(True, gap[:-1]) if n else np.zeros(0, bool)  # a walk back never crosses a separator
        kept = start | (np.arange(n) % SAMPLE == 0)
        self.sampled = kept[suffix]
        self.slot = np.cumsum(self.sampled) - 1
        self.positions = suffix[self.sampled]

    def rank(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each word stands in the first at symbols of the transform."""
        first = np.zeros_like(at)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = (word >> level) & 1 == 1
            a, b = self.ones[k][at].astype(np.int64), self.ones[k][first].astype(np.int64)
            at, first = np.where(one, self.zeros[k] + a, at - a), np.where(one, self.zeros[k] + b, first - b)
        return at - first

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The transform's symbol at each row."""
        out = np.zeros_like(at)
        for k in range(self.levels):
            bit = (self.ones[k][at + 1] - self.ones[k][at]).astype(np.int64)
            out = out * 2 + bit
            a = self.ones[k][at].astype(np.int64)
            at = np.where(bit == 1, self.zeros[k] + a, at - a)
        return out

    def search(self, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of each pattern (0 on its left: none)."""
        lo, hi = np.zeros(len(padded), np.int64), np.full(len(padded), self.n, np.int64)
        known = len(self.before) - 1
        for k in range(padded.shape[1] - 1, -1, -1):
            live = np.flatnonzero((padded[:, k] > 0) & (hi > lo))
            word = padded[live, k]
            there = word < known
            hi[live[~there]] = lo[live[~there]]
            live, word = live[there], word[there]
            lo[live], hi[live] = self.before[word] + self.rank(word, lo[live]), self.before[word] + self.rank(word, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        rows, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[rows[todo]]
            hit = todo[done]
            out[hit] = self.positions[self.slot[rows[hit]]] + walked[hit]
            todo = todo[~done]
            word = self.symbol(rows[todo])
            rows[todo] = self.before[word] + self.rank(word, rows[todo])
            walked[todo] += 1
        return out


def _suffixes(words: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling; only suffixes that aren't told apart yet are sorted again. Each separator is a symbol of
    its own, so that texts never compare beyond their end, and copies are told apart there."""
    n = len(words)
    rank = np.where(gap, np.cumsum(gap) - 1, words + int(gap.sum())).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    head = np.append(True, rank[order[1:]] != rank[order[:-1]]) if n else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # the first place of the group
    step, places = 1, np.arange(n)
    while True:
        alone = head & np.append(head[1:], True)
        places = places[~alone]  # of the suffixes that share their group
        if not len(places):
            return order
        some = order[places]
        key = rank[some] * (n + 1) + rank[some + step]  # a group's suffixes all reach beyond step: none of their first symbols ends a text
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[places] = some
        head = np.append(True, key[1:] != key[:-1])
        rank[some] = np.maximum.accumulate(np.where(head, places, 0))
        step *= 2


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Shard:
    """The index of some texts: words (ids from 1, 0 after each text) of the shard's vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int], texts: list[np.ndarray]):
        self.vocabulary, self.words = vocabulary, np.concatenate([np.append(t, 0) for t in texts])
        self.starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.cover = np.zeros(len(self.words) + 1, np.int64)
        self.items: dict[int, set[str]] = {}
        self.index = FMIndex(self.words)

    def search(self, queries: Queries) -> None:
        """Marks the words that the block's windows cover, and the items that occur, text by text."""
        padded, which = queries.in_shard(self.vocabulary)
        lo, hi = self.index.search(padded)
        found = np.flatnonzero(hi > lo)
        counts = hi[found] - lo[found]
        for some in np.split(found, np.flatnonzero(np.diff(np.cumsum(counts) // 1_000_000)) + 1):
            n = hi[some] - lo[some]
            at = self.index.locate(np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            window = np.repeat(which[some], n)
            np.add.at(self.cover, at, 1)
            np.add.at(self.cover, at + queries.lengths[window], -1)
            owner = np.searchsorted(self.starts, at, side="right") - 1
            for text, w in np.unique(np.stack([owner, window], 1), axis=0).tolist():
                self.items.setdefault(text, set()).update(queries.items[i] for i in queries.of[w].tolist())

    def spans(self) -> dict[int, list[tuple[int, int]]]:
        """Spans of covered words of each text that has any. No window reaches over a separator."""
        edges = np.flatnonzero(np.diff(np.append(0, np.cumsum(self.cover) > 0).astype(np.int8)))
        out: dict[int, list[tuple[int, int]]] = {}
        for a, b in edges.reshape(-1, 2).tolist():
            text = bisect.bisect_right(self.starts, a) - 1
            out.setdefault(text, []).append((a - int(self.starts[text]), b - int(self.starts[text])))
        return out


def blocks_of(path: str, window: int) -> Iterator[Queries]:
    """The benchmark's blocks, of the table at path."""
    fs, place = pa.fs.FileSystem.from_uri(path)
    for batch in pa.dataset.dataset(place, filesystem=fs, format="parquet").to_batches(columns=PREPARED.names, batch_size=1, batch_readahead=0, fragment_readahead=0):
        for row in batch.to_pylist():
            yield Queries(row, window)


class Blocks:
    """blocks_of(), read anew for each shard unless there is only one: as arrays, nothing is split or counted again."""

    def __init__(self, path: str, window: int):
        self.args, self.only = (path, window), None

    def __iter__(self) -> Iterator[Queries]:
        if self.only is None:
            first = list(islice(found := blocks_of(*self.args), 2))
            if len(first) == 2:
                yield from chain(first, found)
                return
            self.only = first
        yield from self.only


def searched(rows: Iterator[tuple], blocks: Blocks) -> Iterator[tuple[tuple, int, list[tuple[int, int]], list[str]]]:
    """Each row (its last field: the text), the number of its words, the merged spans of hit words, and the items that occur, sorted."""
    held, texts, vocabulary, indexed, size = [], [], {}, 0, 0

    def flush() -> Iterator[tuple]:
        shard = Shard(vocabulary, texts) if indexed else None
        if shard:
            for queries in blocks:
                shard.search(queries)
        spans = shard.spans() if shard else {}
        for n, row in enumerate(held):
            yield row, len(texts[n]), spans.get(n, []), sorted(shard.items[n]) if n in spans else []

    for row in rows:
        words = words_of(row[-1])
        if len(words) > 2 * SHARD_WORDS:
            yield from flush()
            held, texts, vocabulary, indexed, size = [], [], {}, 0, 0
            yield row, len(words), *_in_pieces(words, blocks)
            continue
        for w in set(words).difference(vocabulary):
            vocabulary[w] = len(vocabulary) + 1
        texts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
        held.append(row)
        indexed, size = indexed + len(words), size + len(row[-1])
        if indexed >= SHARD_WORDS or size >= SHARD_BYTES or len(held) >= 100_000:
            yield from flush()
            held, texts, vocabulary, indexed, size = [], [], {}, 0, 0
    yield from flush()


def _in_pieces(words: list[bytes], blocks: Blocks) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans and items of a text too long for one shard; its shards have all but one word of a window in common."""
    spans, items = [], set()
    for at in range(0, len(words), SHARD_WORDS):
        vocabulary: dict[bytes, int] = {}
        piece = words[at : at + SHARD_WORDS + blocks.args[1] - 1]
        shard = Shard(vocabulary, [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in piece], np.int64)])
        for queries in blocks:
            shard.search(queries)
        spans += [(a + at, b + at) for a, b in shard.spans().get(0, [])]
        items |= shard.items.get(0, set())
    return merge_spans(spans), sorted(items)


def stored(benchmark: DataFrame, window: int, block_bytes: int) -> str:
    """The path of the benchmark's blocks, made ready once, in the shared folder. Items' ids are text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, size = [], 0
        for item, text in rows_of(batches):
            items.append((item, text))
            size += len(text)
            if size >= block_bytes:
                yield pa.RecordBatch.from_pylist([prepared(items, window)], PREPARED)
                items, size = [], 0
        if items:
            yield pa.RecordBatch.from_pylist([prepared(items, window)], PREPARED)

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    tasks = max(1, -(-size_in_bytes(rows) // block_bytes))  # no blocks for parts of a small table
    return written_at(rows.coalesce(min(tasks, 10_000)).mapInArrow(run, "items array<string>, words binary, padded binary, ends binary, of binary"), "benchmark")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (of words, half open, merged), items (ids as strings, sorted) of every document."""
    blocks = Blocks(stored(benchmark, window, block_bytes), window)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for (doc_id, _), n_words, spans, items in searched(rows_of(batches), blocks):
            yield from out.add((doc_id, n_words, [{"a": a, "b": b} for a, b in spans], items))
        yield from out.flush()

    return text_bytes(docs).mapInArrow(run, "doc_id long, n_words long, spans array<struct<a:int,b:int>>, items array<string>")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    return find(docs, benchmark, **options).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans' words and what stands between them."""
    flat = text.translate(TABLE)
    starts, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : starts[a][0]])
        last = starts[b - 1][1]
    return b"".join([*out, text[last:]])


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all rows and columns, with each text (and n_chars, where there is one) without its spans; texts without a hit stay as they are."""
    blocks = Blocks(stored(benchmark, window, block_bytes), window)

    def new_texts(rows: Iterator[tuple]) -> Iterator[str | None]:
        for (text,), _, spans, _ in searched(rows, blocks):
            yield cut(text, spans).decode() if spans else None

    return with_new_texts(docs, new_texts)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win FROM b, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i) WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM d, ns, LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i) WHERE len(ws) >= n),
h AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, win)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""

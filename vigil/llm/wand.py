"""Ranked lexical search: variable-block-max WAND over an inverted index in shards.

`index` reads the documents as they lie, without a shuffle: a task gathers documents into shards of SHARD_TERMS terms (a longer document is a shard by itself), in order of doc_id,
and writes each one's vocabulary and postings (documents in order, and how often) to a table. From the shards follow the number of documents and terms, and, for the terms that
are asked for, how many documents hold each. `search` opens a shard at a time. A term's postings are cut into blocks by dynamic programming: of all cuts into blocks of at most LONGEST
postings the one whose blocks' greatest scores exceed the postings' scores by least in sum, where each block costs BLOCK more. The step of the programme runs over all lists at once.

A question's blocks, laid over each other, cut the shard into stretches; the sum of their greatest scores bounds what a document of a stretch can have. Where the bound is under the score of the
tenth best so far, the stretch is skipped with all blocks in it. The rest is gone through in order, some stretches at a time: the terms of least bound that together stay under the
threshold can't bring a document in alone, so candidates are the postings of the other terms (the pivot terms); the former are looked up for candidates only, greatest bound first, and
candidates that can't come in any more are left as soon as that is known. A task carries its ten best of each question from shard to shard; results are exact.

Scores are whole numbers: weight * ((10**9 * tf) div (1000 * tf + 8 * m)), m = 25 + ((75 * n * N) div L), weight = floor(1000 * ln((2N + 2) / (2df + 1))).

Defined cases: null text has no terms; each row of the items is an item of its own, and each row of the documents a document, so repeated ids appear as often as their rows; equal scores by
ascending doc_id, null first; an item without terms, or whose terms no document holds, has no row; empty tables give no row; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import Out, rows_of, text_bytes, written, written_at

#: Terms: letters and digits of ASCII, and any byte of other characters; upper case becomes lower case, the rest separates.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
TOP = 10
SHARD_TERMS, SHARD_DOCUMENTS, SHARD_BYTES = 3_000_000, 50_000, 24 << 20
QUERY_BYTES = 4 << 20
#: Of the dynamic programme: a block's greatest length and its cost, as a part of the greatest share of a score; postings worked on at a time.
LONGEST, BLOCK, LISTS = 64, 1_500_000, 4096
#: Documents of the first stretches looked at, before there is a threshold; doubled from step to step.
FIRST_STEP = 256


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


SHARDS = pa.schema([("documents", pa.int64()), ("total", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("vocabulary", pa.binary()), ("starts", pa.binary()), ("docs", pa.binary()), ("tfs", pa.binary())])
_SHARD_COLUMNS = "documents long, total long, ids array<long>, lengths binary, vocabulary binary, starts binary, docs binary, tfs binary"


class Builder:
    """The documents of a shard to come."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.texts: list[np.ndarray] = []
        self.size = self.terms = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words, place = terms_of(text), self.place
        if not words:
            return
        for w in set(words).difference(place):
            place[w] = len(place)
        self.ids.append(doc_id)
        self.texts.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
        self.terms += len(words)
        self.size += len(text)

    def full(self, terms: int = SHARD_TERMS) -> bool:
        return self.terms >= terms or len(self.ids) >= SHARD_DOCUMENTS or self.size >= SHARD_BYTES

    def row(self) -> dict:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0))
        lengths = np.array([len(self.texts[i]) for i in order], np.int64)
        names = sorted(self.place)
        rank = np.empty(len(names), np.int64)
        rank[[self.place[w] for w in names]] = np.arange(len(names))
        key = rank[np.concatenate([self.texts[i] for i in order])] * len(order) + np.repeat(np.arange(len(order)), lengths)
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        term, doc = np.divmod(key[at], len(order))
        starts = np.searchsorted(term, np.arange(len(names) + 1))
        tfs = np.diff(at, append=len(key))
        return {
            "documents": len(order), "total": int(lengths.sum()), "ids": [self.ids[i] for i in order], "lengths": lengths.astype("<u4").tobytes(), "vocabulary": b" ".join(names),
            "starts": starts.astype("<u4").tobytes(), "docs": doc.astype("<u4").tobytes(), "tfs": tfs.astype("<u4").tobytes(),
        }


def index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The shards, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Builder()
        for doc_id, text in rows_of(batches):
            shard.add(doc_id, text)
            if shard.full(shard_terms):
                yield pa.RecordBatch.from_pylist([shard.row()], SHARDS)
                shard = Builder()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], SHARDS)

    return written(text_bytes(docs).mapInArrow(run, _SHARD_COLUMNS), "postings")


Block = tuple[list[int], np.ndarray, list[bytes], np.ndarray, np.ndarray]  # items, where each begins, its terms, repeats and weights


def blocks_of(path: str, size: int) -> Iterator[Block]:
    """The questions at path, in blocks of about size bytes."""
    fs, place = pa.fs.FileSystem.from_uri(path)
    items, starts, terms, repeats, weights, held = [], [0], [], [], [], 0
    for batch in pa.dataset.dataset(place, filesystem=fs, format="parquet").to_batches(columns=["item", "terms"], batch_size=256):
        for item, of_item in rows_of([batch]):
            items.append(item)
            for t in of_item:
                terms.append(t["term"])
                repeats.append(t["repeats"])
                weights.append(t["weight"])
                held += len(t["term"]) + 80
            starts.append(len(terms))
            if held >= size:
                yield items, np.array(starts), terms, np.array(repeats, np.int64), np.array(weights, np.int64)
                items, starts, terms, repeats, weights, held = [], [0], [], [], [], 0
    if items:
        yield items, np.array(starts), terms, np.array(repeats, np.int64), np.array(weights, np.int64)


def item_terms(items: DataFrame, tokens: str = "text") -> DataFrame:
    """item (the row's number), item_id, term, repeats: the items' distinct terms."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.string()), ("term", pa.binary()), ("repeats", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for item, item_id, text in rows_of(batches):
            found: dict[bytes, int] = {}
            for t in terms_of(text):
                found[t] = found.get(t, 0) + 1
            for t, n in found.items():
                yield from out.add((item, item_id, t, n), len(t) + 32)
        yield from out.flush()

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col(tokens), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item long, item_id string, term binary, repeats long")


def frequencies(shards: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """term, df: the documents of all shards that hold each term asked for."""
    path = written_at(asked.select("term").distinct(), "asked")
    schema = pa.schema([("term", pa.binary()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = pa.fs.FileSystem.from_uri(path)
        found: dict[bytes, int] = {}  # of the terms asked for, a batch of shards at a time
        for vocabulary, starts in rows_of(batches):
            names = vocabulary.split(b" ")
            held, df = dict(zip(names, range(len(names)), strict=True)), np.diff(np.frombuffer(starts, "<u4").astype(np.int64))
            for batch in pa.dataset.dataset(place, filesystem=fs, format="parquet").to_batches(batch_size=65536):
                for (term,) in rows_of([batch]):
                    if (i := held.get(term)) is not None:
                        found[term] = found.get(term, 0) + int(df[i])
            if len(found) * 64 > size:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], schema=schema)
                found = {}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], schema=schema)

    return shards.select("vocabulary", "starts").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def cut(score: list[np.ndarray], longest: int = LONGEST, block: int = BLOCK) -> list[np.ndarray]:
    """Where the blocks of each list end, so that the sum over blocks of block + length * greatest - sum is least. One step takes the i-th score of every list."""
    order = sorted(range(len(score)), key=lambda k: -len(score[k]))
    sizes = np.array([len(score[k]) for k in order])
    most = int(sizes[0])
    back = np.zeros((most + 1, len(order)), np.uint8)  # length of the block that ends there
    steps = np.arange(1, longest + 1)
    # over the last `longest` places, newest first: cost so far before a block of that length, and its greatest score
    before = np.full((len(order), longest), 1 << 60, np.int64)
    greatest = np.zeros((len(order), longest), np.int64)
    last = np.zeros(len(order), np.int64)
    padded = np.zeros((most, len(order)), np.int64)
    for j, k in enumerate(order):
        padded[: len(score[k]), j] = score[k]
    for i in range(1, most + 1):
        n = int(np.searchsorted(-sizes, -i, side="right"))  # lists of at least i scores
        s = padded[i - 1, :n]
        before, greatest, last = before[:n], greatest[:n], last[:n]
        # the error of a block's other postings is what its greatest score exceeds their sum by: sums cancel along a list, so only greatest * length counts
        before[:, 1:] = before[:, :-1].copy()
        before[:, 0] = last
        greatest[:, 1:] = greatest[:, :-1].copy()
        greatest[:, 0] = 0
        np.maximum(greatest, s[:, None], out=greatest)
        cost = greatest * steps
        cost += before
        best = cost.argmin(1)
        back[i, :n] = best + 1
        last = cost[np.arange(n), best] + block
    ends: list[np.ndarray] = [np.zeros(0, np.int64)] * len(score)
    for j, k in enumerate(order):
        at, found = len(score[k]), []
        while at:
            found.append(at)
            at -= int(back[at, j])
        ends[k] = np.array(found[::-1])
    return ends


class List:
    """The postings of a term: documents, shares of the score, and the blocks: their ends (postings), last documents, greatest shares."""

    __slots__ = ("docs", "greatest", "lasts", "most", "shares")

    def __init__(self, docs: np.ndarray, shares: np.ndarray, ends: np.ndarray):
        self.docs, self.shares = docs, shares
        self.lasts, self.greatest = docs[ends - 1].astype(np.int64), np.maximum.reduceat(shares, np.append(0, ends[:-1]))
        self.most = int(self.greatest.max())


class Shard:
    def __init__(self, row: dict, documents: int, total: int):
        self.ids = row["ids"]
        self.names = {w: i for i, w in enumerate(row["vocabulary"].split(b" "))}
        self.starts, self.docs, self.tfs = (np.frombuffer(row[c], "<u4") for c in ("starts", "docs", "tfs"))
        lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.m = 25 + (75 * lengths * documents) // total
        self.lists: dict[int, List] = {}

    def open(self, terms: list[bytes]) -> None:
        """Cuts the postings of these terms, where that isn't done."""
        new = sorted({i for t in terms if (i := self.names.get(t)) is not None and i not in self.lists}, key=lambda i: (int(self.starts[i + 1]) - int(self.starts[i]), i))
        for some in _portions(new, [int(self.starts[i + 1]) - int(self.starts[i]) for i in new]):
            docs = [self.docs[self.starts[i] : self.starts[i + 1]] for i in some]
            shares = []
            for i, d in zip(some, docs, strict=True):
                tf = self.tfs[self.starts[i] : self.starts[i + 1]].astype(np.int64)
                shares.append((1_000_000_000 * tf) // (1000 * tf + 8 * self.m[d]))
            for i, d, s, ends in zip(some, docs, shares, cut(shares), strict=True):
                self.lists[i] = List(d, s, ends)

    def search(self, terms: list[bytes], factors: np.ndarray, best: Best) -> None:
        """Puts what the shard has into best. factors: weight times repeats of each term."""
        held = [(self.lists[i], int(f)) for t, f in zip(terms, factors.tolist(), strict=True) if f > 0 and (i := self.names.get(t)) is not None]
        if not held:
            return
        # stretches: where a block begins its greatest score is added, behind its last document it is taken off
        at = np.concatenate([np.concatenate([x.docs[:1], x.lasts[:-1] + 1, x.lasts[-1:] + 1]) for x, _ in held])
        change = np.concatenate([np.diff(np.concatenate([[0], x.greatest, [0]])) * f for x, f in held])
        order = np.argsort(at, kind="stable")
        at, bound = at[order], np.cumsum(change[order])
        final = np.flatnonzero(np.append(at[1:] != at[:-1], True))
        begins, bound = at[final], bound[final]  # a stretch reaches to the next one's beginning; the last has bound 0
        held.sort(key=lambda x: x[0].most * x[1])
        mosts = np.cumsum([x.most * f for x, f in held])
        k, step = 0, FIRST_STEP
        while k < len(begins) - 1:
            live = k + np.flatnonzero(bound[k:-1] >= max(best.threshold, 1))
            if not len(live):
                return
            k = int(live[0])
            end = int(np.searchsorted(begins, begins[k] + step, side="left"))
            end = max(min(end, len(begins) - 1), k + 1)
            self._stretches(held, mosts, begins, bound, live[live < end], best)
            k, step = end, step * 2

    def _stretches(self, held: list[tuple[List, int]], mosts: np.ndarray, begins: np.ndarray, bound: np.ndarray, live: np.ndarray, best: Best) -> None:
        lo, hi = int(begins[live[0]]), int(begins[live[-1] + 1])
        pivot = int(np.searchsorted(mosts, best.threshold, side="left"))  # lists before it can't reach the threshold together
        ranges = [np.searchsorted(x.docs, (lo, hi)) for x, _ in held]
        found = [x.docs[a:b] for (x, _), (a, b) in zip(held[pivot:], ranges[pivot:], strict=True)]
        docs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)
        stretch = np.searchsorted(begins, docs, side="right") - 1
        docs = docs[bound[stretch] >= max(best.threshold, 1)]
        if not len(docs):
            return
        score = np.zeros(len(docs), np.int64)
        for i in range(len(held) - 1, -1, -1):
            (x, f), (a, b) = held[i], ranges[i]
            if a < b:
                at = np.minimum(a + np.searchsorted(x.docs[a:b], docs), b - 1)
                score += np.where(x.docs[at] == docs, x.shares[at], 0) * f
            if i and best.threshold:
                stays = score + mosts[i - 1] >= best.threshold
                if not stays.all():
                    docs, score = docs[stays], score[stays]
                    if not len(docs):
                        return
        best.add(score, docs, self.ids)


def _portions(items: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """items, sized in ascending order, in runs of at most LISTS, and of a bounded number of postings as padded to the longest."""
    some: list[int] = []
    for x, n in zip(items, sizes, strict=True):
        if some and (len(some) >= LISTS or (len(some) + 1) * n > 4_000_000):
            yield some
            some = []
        some.append(x)
    if some:
        yield some


class Best:
    """The best documents so far; ties by ascending id, null first."""

    def __init__(self, top: int):
        self.top, self.threshold, self.rows = top, 0, []  # threshold: the score of the last of them, once there are enough

    def add(self, score: np.ndarray, docs: np.ndarray, ids: list[int | None]) -> None:
        good = np.flatnonzero((score > 0) & (score >= self.threshold))
        if len(good) > self.top:  # documents are in order of their ids
            good = good[np.argsort(-score[good], kind="stable")[: self.top]]
        self.rows += [(s, ids[d]) for s, d in zip(score[good].tolist(), docs[good].tolist(), strict=True)]
        self.rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
        del self.rows[self.top :]
        if len(self.rows) == self.top:
            self.threshold = self.rows[-1][0]


def found_in(shards: Iterator[dict], path: str, documents: int, total: int, top: int, size: int) -> Iterator[tuple[int, int | None, int]]:
    """item, doc_id, score of each item's best documents in these shards. One block of questions keeps its best from shard to shard; of more blocks, each shard's best are given."""
    first = list(islice(blocks := blocks_of(path, size), 2))
    one = len(first) < 2
    kept: dict[int, Best] = {}
    for row in shards:
        shard = Shard(row, documents, total)
        for items, starts, terms, repeats, weights in first if one else chain(first, blocks) if first else blocks_of(path, size):
            shard.open(terms)
            for j, item in enumerate(items):
                best = kept.setdefault(item, Best(top)) if one else Best(top)
                at = slice(int(starts[j]), int(starts[j + 1]))
                shard.search(terms[at], repeats[at] * weights[at], best)
                if not one:
                    yield from ((item, doc_id, score) for score, doc_id in best.rows)
        if not one:
            first = []
    for item, best in kept.items():
        yield from ((item, doc_id, score) for score, doc_id in best.rows)


def search(shards: DataFrame, items: DataFrame, top: int = TOP, size: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the best documents of all shards."""
    documents, total = shards.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    asked = written(item_terms(items), "questions")
    weight = F.floor(1000 * F.log((2 * F.lit(float(documents)) + 2) / (2 * F.col("df") + 1)))
    weighted = asked.join(frequencies(shards, asked, size), "term").withColumn("weight", weight)
    path = written_at(weighted.groupBy("item").agg(F.collect_list(F.struct("term", "repeats", "weight")).alias("terms")), "weights")  # a list is one item's terms
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        rows = (dict(zip(SHARDS.names, r, strict=True)) for r in rows_of(batches))
        for row in found_in(rows, path, documents, total, top, size):
            yield from out.add(row)
        yield from out.flush()

    found = shards.mapInArrow(run, "item long, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).filter(F.col("rank") <= top)
    names = asked.groupBy("item").agg(F.first("item_id").alias("item_id"))
    typed = F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id")
    return ranked.join(names, "item").select(typed, F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf FROM b GROUP BY ALL),
f AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
tf AS (SELECT doc_id, len(ts)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, f GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // total)))))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term), f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

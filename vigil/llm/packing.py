"""Lexical retrieval packing: documents are packed into sequences of at most 2048 tokens next to their lexical neighbours.

Documents are dealt into shards of some SHARD_IDS ids by the hash of id and content; their number follows from the corpus's ids alone, not from files, partitions or settings, so that equal
tables have equal pieces. A shard holds a BM25 inverted index over its documents' whole texts (terms are
token ids; document frequencies and the mean length are those of the whole corpus). The first unused document is a seed; full windows of its own come
first, and what is left of it opens a window. The index is asked with all distinct terms of the seed and returns its unused neighbours
by score; they fill the window greedily, the last one cut to fit, its rest staying unused. When no neighbour shares a term, the next unused document
follows in order. So only the last window of a shard can be padded, one of some five hundred; a shard holds about a thousand documents.

Ids are those of `tokenizers` for the given file; texts of common characters go through the same vocabulary in tiktoken,
which gives the same ids faster; any other text goes through tokenizers itself.

Defined cases: null text counts as empty (its document is the end id alone); null and repeated ids are kept, row by row; an
empty table gives no piece; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Out, rows_of, text_bytes, written

LENGTH, END = 2048, 1
#: Ids of a shard.
SHARD_IDS = 1_000_000
K1, B = 1.2, 0.75
#: Texts of only these are encoded alike by both libraries: their classes of letters, digits and spaces agree there.
COMMON = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\u017f\u2010-\u2027\u20ac]*")
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts in which no white space follows another: no look-ahead, so that one automaton does all of it.
_SINGLE = _PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")


def _runs_of_white(text: str) -> bool:
    """Does white space follow white space in a text of common characters? Of those only white space is up to a blank."""
    white = np.frombuffer(text.encode(), np.uint8) <= 0x20
    return bool((white[1:] & white[:-1]).any())


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        special = {t["content"] for t in held["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in word): i for word, i in held["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("same", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.faster = tiktoken.Encoding("no runs of white space", pat_str=_SINGLE, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if COMMON.fullmatch(text) and not self.special.search(text):
            same = self.fast if _runs_of_white(text) else self.faster
            return np.frombuffer(array("I", same.encode_ordinary(text)), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


ENCODED = pa.schema([("doc_id", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary())])


class TermCounts:
    """How many documents hold each term, how many documents and ids there are."""

    def __init__(self):
        self.df, self.documents, self.ids = np.zeros(1 << 16, np.int64), 0, 0

    def add(self, ids: np.ndarray) -> None:
        ids = np.sort(ids)
        terms = ids[np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))]
        self._room(int(terms[-1]))
        self.df[terms] += 1
        self.documents, self.ids = self.documents + 1, self.ids + len(ids)

    def _room(self, last: int) -> None:
        if last >= len(self.df):
            self.df = np.concatenate([self.df, np.zeros(last + 1 - len(self.df), np.int64)])

    def packed(self) -> tuple[bytes, bytes]:
        """Terms and their counts; term -1: documents; term -2: ids."""
        at = np.flatnonzero(self.df)
        return np.append([-1, -2], at).astype("<i8").tobytes(), np.append([self.documents, self.ids], self.df[at]).astype("<i8").tobytes()

    def unpack(self, terms: bytes, counts: bytes) -> None:
        t, n = np.frombuffer(terms, "<i8"), np.frombuffer(counts, "<i8")
        self.documents, self.ids = self.documents + int(n[0]), self.ids + int(n[1])
        self._room(int(t.max(initial=0)))
        self.df[t[2:]] += n[2:]


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, ids (16-bit, or 32-bit where an id needs it; the end id last) of every document, and one row a task, its ids null, of
    packed TermCounts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, seen = encoder(tokenizer), Out(ENCODED), TermCounts()
        for doc_id, text in rows_of(batches):
            ids = np.append(encode(text.decode()), np.uint32(end))
            wide = bool(ids.max() >= 1 << 16)
            ids = ids.astype("<u4" if wide else "<u2")
            seen.add(ids)
            yield from out.add((doc_id, wide, ids.tobytes(), None, None), ids.nbytes + 32)
        yield from out.add((None, None, None, *seen.packed()))
        yield from out.flush()

    return text_bytes(docs).mapInArrow(run, "doc_id long, wide boolean, ids binary, terms binary, counts binary")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = TermCounts()
    for terms, counts in rows_of(batches):
        total.unpack(terms, counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")) for x in total.packed()], ["term", "n"])


def statistics(ids: DataFrame) -> tuple[int, float, np.ndarray]:
    """Documents, mean length and idf by term, over all documents. One row per id of the vocabulary: its size bounds what is gathered."""
    rows = ids.filter("ids is null").select("terms", "counts").mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    idf = np.zeros(max(found, default=0) + 1, np.float32)
    for t, df in found.items():
        idf[t] = np.log(1 + (n - df + 0.5) / (df + 0.5))
    return n, total / max(n, 1), idf


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and how often each stands there."""
    ids = np.sort(ids)
    at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[at], np.diff(at, append=len(ids))


class BM25:
    """The inverted index of one shard: postings by term, with their whole share of the score worked out. Terms of many documents have
    a row of weights over all documents instead; documents that are used up leave the index once they are a fifth of it."""

    def __init__(self, texts: list[np.ndarray], mean: float, idf: np.ndarray):
        terms, counts = zip(*map(_counted, texts), strict=True)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in terms])
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float32)
        norm = K1 * (1 - B + B * np.array([len(t) for t in texts], np.float32) / max(mean, 1e-9))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        order = np.argsort(term, kind="stable")
        self.queries, self.size = terms, len(idf)
        self._index(np.arange(len(texts)), term[order], doc[order], weight[order].astype(np.float32))

    def _index(self, docs: np.ndarray, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        """docs: the documents left; term, doc (a place in docs), weight: the postings by term."""
        self.docs, self.term, self.doc, self.weight = docs, term, doc, weight
        self.start = np.searchsorted(term, np.arange(self.size + 1))
        df = np.diff(self.start)
        common = np.flatnonzero(df > max(64, len(docs) // 8))
        self.row = np.full(self.size, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), len(docs)), np.float32)
        for i, t in enumerate(common):
            at = slice(self.start[t], self.start[t + 1])
            self.rows[i, doc[at]] = weight[at]

    def _drop_used(self, unused: np.ndarray) -> None:
        stays = unused[self.docs]
        place, at = np.cumsum(stays) - 1, stays[self.doc]
        self._index(self.docs[stays], self.term[at], place[self.doc[at]], self.weight[at])

    def _scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Of each document in self.docs; 0: it is used, or shares no term. A document once used stays so."""
        if 1.25 * np.count_nonzero(unused) < len(self.docs):
            self._drop_used(unused)
        terms, rows = self.queries[seed], self.rows
        row = self.row[terms]
        score, rare = np.zeros(len(self.docs), np.float32), terms[row < 0].astype(np.int64)
        for r in row[row >= 0].tolist():
            score += rows[r]
        parts = [slice(a, b) for a, b in zip(self.start[rare].tolist(), self.start[rare + 1].tolist(), strict=True) if b > a]
        if parts:
            score += np.bincount(np.concatenate([self.doc[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), len(score))
        score[~unused[self.docs]] = 0
        return score

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term, best first; ties by place."""
        score = self._scores(seed, unused)
        return self._sorted(score, np.flatnonzero(score > 0))

    def _sorted(self, score: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.docs[at[np.argsort(-score[at], kind="stable")]]

    def best_first(self, seed: int, unused: np.ndarray, some: int = 16) -> Iterator[int]:
        """neighbours(), one at a time: the rest is sorted only when the best are taken."""
        score = self._scores(seed, unused)
        least = np.partition(score, -some)[-some] if len(score) > some else np.float32(0)
        if least > 0:
            yield from self._sorted(score, np.flatnonzero(score >= least)).tolist()
            yield from self._sorted(score, np.flatnonzero((score > 0) & (score < least))).tolist()
        else:
            yield from self._sorted(score, np.flatnonzero(score > 0)).tolist()


def pack_shard(texts: list[np.ndarray], mean: float, idf: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every id once."""
    index = BM25(texts, mean, idf)
    left, unused = np.zeros(len(texts), np.int64), np.ones(len(texts), bool)  # left: where the unused rest starts
    pieces, sequence, offset, first = [], 0, 0, 0

    def put(d: int) -> None:
        nonlocal sequence, offset
        n = min(len(texts[d]) - int(left[d]), length - offset)
        pieces.append((d, int(left[d]), n, sequence, offset))
        left[d] += n
        unused[d] = left[d] < len(texts[d])
        offset += n
        if offset == length:
            sequence, offset = sequence + 1, 0

    while True:
        while first < len(texts) and not unused[first]:
            first += 1
        if first == len(texts):
            return pieces
        seed = first
        if offset == 0:
            while len(texts[seed]) - left[seed] >= length:
                put(seed)
        window = sequence
        if unused[seed]:
            put(seed)
        if offset and sequence == window:
            for d in index.best_first(seed, unused):
                put(d)
                if sequence != window:
                    break


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece. Sequence ids are the shard's number times 2 ** 32 plus a running number."""
    spark = docs.sparkSession
    ids = written(encoded(docs, tokenizer, end), "ids")
    n, mean, idf = statistics(ids)
    idf[end : end + 1] = 0  # no word of a text: it stands in every document
    shards = max(1, round(n * mean / SHARD_IDS))
    idf_sent = spark.sparkContext.broadcast(idf)  # bounded by the vocabulary

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        texts = [np.frombuffer(x.as_py(), "<u4" if w.as_py() else "<u2") for w, x in zip(t["wide"], t["ids"], strict=True)]
        doc_ids = t["doc_id"].to_pylist()
        rows = pack_shard(texts, mean, idf_sent.value, length)
        d, start, n, sequence, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        crc = [zlib.crc32(texts[a][b : b + c].astype("<u4").tobytes()) for a, b, c, _, _ in rows]
        base = key[0].as_py() << 32
        return pa.table([pa.array([doc_ids[i] for i in d], pa.int64()), start, n, pa.array(crc, pa.int64()), np.array([len(texts[i]) for i in d], np.int64), sequence + base, offset], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = ids.filter("ids is not null").select("doc_id", "wide", "ids", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, PIECES)

"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order. A key is the document's id as 8 bytes, big endian, sign bit flipped, so
bytes sort as ids do, and a 4-byte number that tells equal ids apart; a null id sorts first under an empty key.

    block     entries: shared u8 | rest u8 | width u8 (2 or 4) | n_ids u32 | the key's last `rest` bytes | ids, width bytes each;
              first entry of a block: shared = 0
    index     per block: key length u8 | its first key | offset u64 | size u32 | entries u32
    filter    Bloom filter of the ids, 10 bits a key, 7 probes
    footer    index offset u64 | index size u64 | filter offset u64 | filter size u64 | documents u64 | ids u64 | magic

All numbers are little endian. A lookup reads the footer, the filter, the index, and by binary search one block.
Files are written under a temporary name and renamed, into the shared folder; a task that runs again writes a file of another name, and
only files named in the manifest count.

Defined cases: null text counts as empty (its document has the end id alone); null ids and repeated ids are kept; an empty
table gives no shard; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import Out, parts_for, rows_of, run_dir, text_bytes, written

MAGIC, BLOCK_BYTES, FILE_BYTES = b"VIGILSST", 64 << 10, 64 << 20
_FOOT, _ENTRY, _PLACE = struct.Struct("<QQQQQQ8s"), struct.Struct("<BBBI"), struct.Struct("<QII")
END = 2
_STOP = re.compile(rb"[.,](?<=[a-z][.,])(?=[\x20\x09-\x0D]|\Z)")


def key_of(doc_id: int | None, number: int) -> bytes:
    return b"" if doc_id is None and not number else (b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", number)


def id_of(key: bytes) -> int | None:
    return None if len(key) < 8 else struct.unpack(">Q", key[:8])[0] - (1 << 63)


def _probes(doc_id: int, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(struct.pack("<q", doc_id))
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(7)]


class Writer:
    def __init__(self, out):
        self.out, self.at, self.index, self.ids, self.documents, self.n_ids = out, 0, [], [], 0, 0
        self.block, self.entries, self.size, self.first, self.last = [], 0, 0, b"", b""

    def add(self, doc_id: int | None, number: int, ids: np.ndarray, end: int) -> None:
        """A document of ids (two or four bytes each), and its end id."""
        key = key_of(doc_id, number)
        if self.size >= BLOCK_BYTES:
            self._close_block()
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        width = ids.itemsize
        self.block += [_ENTRY.pack(shared, len(key) - shared, width, len(ids) + 1), key[shared:], ids.tobytes(), end.to_bytes(width, "little")]
        self.size += ids.nbytes + 16
        self.entries, self.last = self.entries + 1, key
        self.documents, self.n_ids = self.documents + 1, self.n_ids + len(ids) + 1
        if doc_id is not None:
            self.ids.append(doc_id)

    def _close_block(self) -> None:
        data = b"".join(self.block)
        self.out.write(data)
        self.index.append(bytes([len(self.first)]) + self.first + _PLACE.pack(self.at, len(data), self.entries))
        self.at += len(data)
        self.block, self.entries, self.size = [], 0, 0

    def close(self) -> None:
        if self.entries:
            self._close_block()
        index = b"".join(self.index)
        bits = np.zeros(max(64, 10 * len(self.ids) + 7) // 8 * 8, np.uint8)
        for x in self.ids:
            bits[_probes(x, len(bits))] = 1
        bloom = np.packbits(bits).tobytes()
        self.out.write(index + bloom + _FOOT.pack(self.at, len(index), self.at + len(index), len(bloom), self.documents, self.n_ids, MAGIC))


def _entries(block: bytes) -> Iterator[tuple[bytes, np.ndarray]]:
    at, last = 0, b""
    while at < len(block):
        shared, rest, width, n = _ENTRY.unpack_from(block, at)
        at += _ENTRY.size
        last = last[:shared] + block[at : at + rest]
        at += rest
        yield last, np.frombuffer(block, f"<u{width}", n, at).astype("<u4")
        at += width * n


class Reader:
    """Random access to one shard by its footer, index and filter."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - _FOOT.size)
        at, n, self.bloom_at, self.bloom_size, self.documents, self.n_ids, magic = _FOOT.unpack(file.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(at)
        raw, self.firsts, self.places, i = file.read(n), [], [], 0
        while i < n:
            end = i + 1 + raw[i]
            self.firsts.append(raw[i + 1 : end])
            self.places.append(_PLACE.unpack_from(raw, end))
            i = end + _PLACE.size

    def may_hold(self, doc_id: int) -> bool:
        self.file.seek(self.bloom_at)
        bits = np.unpackbits(np.frombuffer(self.file.read(self.bloom_size), np.uint8))
        return bool(bits[_probes(doc_id, len(bits))].all())

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, size, _ = self.places[i]
        self.file.seek(offset)
        return _entries(self.file.read(size))

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.places)):
            for key, ids in self.block(i):
                yield id_of(key), ids

    def get(self, doc_id: int) -> np.ndarray | None:
        """The first document of that id, by filter and binary search."""
        if not self.places or not self.may_hold(doc_id):
            return None
        key = key_of(doc_id, 0)
        for k, ids in self.block(max(0, bisect.bisect_right(self.firsts, key) - 1)):
            if k == key:
                return ids
        return None


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """encode(text).ids by the library, each distinct word once: this tokenizer's ids never reach over white space, and ASCII white
    space is dropped. Kept between tasks of a worker; emptied before it holds over MOST words or MOST_BYTES of them."""

    MOST, MOST_BYTES = 1_000_000, 32 << 20

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self._empty()

    def _empty(self) -> None:
        self.known, self.bytes = {}, 0
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # both with room; ends[0]: where the first word starts

    def _learn(self, new: list[bytes]) -> None:
        """The words go through the library as one text; an id belongs to the word in which its characters stand."""
        texts = [w.decode() for w in new]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        of = np.searchsorted(starts, np.fromiter((a for a, _ in got.offsets), np.int64, len(got)), side="right") - 1
        first, ids = len(self.known), self.ends[len(self.known)]
        self.ends = _room(self.ends, first + len(new) + 1)
        self.ends[first + 1 : first + 1 + len(new)] = ids + np.cumsum(np.bincount(of, minlength=len(new)))
        self.flat = _room(self.flat, ids + len(got))
        self.flat[ids : ids + len(got)] = got.ids
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.bytes += sum(map(len, new))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end."""
        # lower case and a blank before a word's last stop change no id, but leave fewer distinct words; special tokens are only looked for as written
        split = [(t if b"<|" in t else _STOP.sub(rb" \g<0>", t.lower())).split() for t in texts]
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing))
            if len(self.known) + len(new) > self.MOST or self.bytes + sum(map(len, new)) > self.MOST_BYTES:
                self._empty()
                new, missing = list(dict.fromkeys(words)), np.arange(len(words))
            self._learn(new)
            at[missing] = [self.known[words[i]] for i in missing]
        starts = self.ends[at]
        n = self.ends[at + 1] - starts
        total = np.append(0, np.cumsum(n))
        ids = self.flat[np.repeat(starts - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.cumsum([len(w) for w in split])]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a copy twice as long as needed."""
    if n <= len(a):
        return a
    out = np.zeros(2 * n, a.dtype)
    out[: len(a)] = a
    return out


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("low", pa.binary()), ("documents", pa.int64()), ("n_ids", pa.int64())])
_MANIFEST = "part int, number int, path string, low binary, documents long, n_ids long"
#: Range partitions whose files are summed up together, and files that a task reads, when shards are read back.
BLOCK_PARTS, TASK_FILES = 1024, 8


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END) -> DataFrame:
    """Writes the shards, by default under the session's own folder, which clean() deletes with what lost tasks left; part and number (the files' order), path, low (first key), documents, n_ids of each file, as a stored table. Rows of one id are
    ordered by their texts' hash and may fill any number of files."""
    folder = folder or f"{run_dir(docs.sparkSession)}/sst-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fs, writer, rows = encoder(tokenizer), None, None, []
        number, last, low = 0, object(), b""

        def finish():
            writer.close()
            writer.out.close()
            fs.move(temporary, temporary[: -len(".tmp")])
            rows.append((TaskContext.get().partitionId(), len(rows), f"{folder}/{name}", low, writer.documents, writer.n_ids))

        def groups():  # bounded by bytes, so that a batch of long texts is never held as words
            some, size = [], 0
            for row in rows_of(batches):
                some.append(row)
                size += len(row[1])
                if size >= 4 << 20:
                    yield some
                    some, size = [], 0
            if some:
                yield some

        for some in groups():
            flat, ends = encode([t for _, t in some])
            flat, begin = flat.astype("<u2" if int(flat.max(initial=end)) < 1 << 16 else "<u4"), 0
            for (doc_id, _), stop in zip(some, ends.tolist(), strict=True):
                ids, begin = flat[begin:stop], stop
                number = number + 1 if doc_id == last else 0
                last = doc_id
                if writer is None:
                    fs, root = pa.fs.FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    name, low = f"{uuid.uuid4().hex}.sst", key_of(doc_id, number)
                    temporary = f"{root}/{name}.tmp"
                    writer = Writer(fs.open_output_stream(temporary))
                writer.add(doc_id, number, ids, end)
                if writer.at >= FILE_BYTES:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), MANIFEST, strict=True)], schema=MANIFEST)

    parts = parts_for(docs.select("text"))
    ordered = text_bytes(docs).withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return written(ordered.mapInArrow(run, _MANIFEST), "manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """path, start (ids of all files before it), documents of each file: sums by block of range partitions, then inside each block."""
    files = manifest.select("part", "number", "path", "documents", "n_ids", F.floor(F.col("part") / BLOCK_PARTS).alias("block"))
    sums = files.groupBy("block").agg(F.sum("n_ids").alias("n"))
    sums = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))  # a row for 1024 partitions
    inside = F.sum("n_ids").over(Window.partitionBy("block").orderBy("part", "number")) - F.col("n_ids")
    return files.withColumn("inside", inside).join(sums, "block").select("path", (F.col("before") + F.col("inside")).alias("start"), "documents")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for path, start, documents in rows_of(batches):
            fs, place = pa.fs.FileSystem.from_uri(path)
            with fs.open_input_file(place) as file:
                reader = Reader(file)
                if reader.documents != documents:
                    raise ValueError(f"{path} isn't whole")
                for doc_id, ids in reader.scan():
                    yield from out.add((doc_id, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
        yield from out.flush()

    least = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-manifest.count() // TASK_FILES))
    return starts(manifest).repartition(tasks, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int) -> np.ndarray | None:
    """The ids of one document, from the one file whose key range holds it (of repeated ids: of one of their documents)."""
    key = key_of(doc_id, 0)
    f = manifest.filter(F.col("low") <= F.lit(bytearray(key))).orderBy(F.desc("low"), "part", "number").first()
    if f is None:
        return None
    fs, place = pa.fs.FileSystem.from_uri(f.path)
    with fs.open_input_file(place) as file:
        return Reader(file).get(doc_id)

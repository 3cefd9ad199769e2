"""Packing and sorted shards against the tokenizers library itself."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from vigil.llm import packing, sstable
from vigil.llm.queries import op2_bm25_packing, op5_sstable, tokenizer_path

SF = "/root/testdata/sf0.001"


def ids_of(name, texts, end):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def check_packing(pieces, docs, ids, length=2048):
    whole = {}
    for p in pieces:
        whole.setdefault(p.doc_id, []).append(p)
    for doc, i in zip(docs, ids, strict=True):
        at = 0
        for p in sorted(whole.pop(doc), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(i)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(i[at : at + p.length].tobytes())
            at += p.length
        assert at == len(i)
    assert not whole
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length
    return sum(map(len, ids)) / (len(sequences) * length)


def test_packing_holds_every_id_once(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fill = check_packing(op2_bm25_packing(spark, SF).collect(), [d for d, _ in docs], ids_of("byte_bpe_50k.json", [t for _, t in docs], 1))
    assert fill > 0.9


def test_packing_of_odd_rows(spark, nasty, empty):
    rows = {r.doc_id: r.text for r in nasty.collect() if r.doc_id != 3}
    got = packing.pack(nasty.filter("doc_id is null or doc_id <> 3"), tokenizer_path("byte_bpe_50k.json")).collect()
    check_packing(got, list(rows), ids_of("byte_bpe_50k.json", rows.values(), 1))
    assert packing.pack(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_neighbours_share_rare_terms():
    idf = np.ones(50, np.float32)
    texts = [np.array([1, 2, 3] * 5), np.array([9] * 15), np.array([1, 2, 8] * 5), np.array([9, 7] * 5)]
    assert packing.BM25([t.astype(np.uint32) for t in texts], 15, idf).neighbours(0, np.array([False, True, True, True])).tolist() == [2]


def test_pieces_do_not_follow_settings_and_are_full(spark):
    """Shards follow from the corpus: the same pieces for any number of partitions, with little padding."""
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(tuple(r) for r in op2_bm25_packing(spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    held = sum(r[2] for r in found[0])
    assert held / (2048 * len({r[5] for r in found[0]})) >= 0.95


def expected(docs, ids):
    at, out = 0, []
    for d, i in sorted(zip(docs, ids, strict=True), key=lambda x: x[0]):
        out.append((d, at, len(i), zlib.crc32(i.tobytes())))
        at += len(i)
    return out


def test_neighbours_by_all_terms_equal_brute_force():
    rng = np.random.default_rng(4)
    texts = [np.minimum(rng.zipf(1.3, rng.integers(1, 200)), 399).astype(np.uint32) for _ in range(300)]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=400)
    idf = np.log(1 + (300 - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = np.mean([len(t) for t in texts])
    index, unused = packing.BM25(texts, mean, idf), np.ones(300, bool)
    for seed in rng.permutation(300)[:280]:
        unused[seed] = False
        score = np.zeros(300)
        for d in np.flatnonzero(unused):
            for t in set(texts[seed].tolist()) & set(texts[d].tolist()):
                tf = int((texts[d] == t).sum())
                score[d] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[d]) / mean))
        got = index.neighbours(int(seed), unused)
        assert set(got.tolist()) == set(np.flatnonzero(score).tolist())
        assert np.all(np.diff(score[got]) <= 1e-4) and list(index.best_first(int(seed), unused)) == got.tolist()


def test_shards_equal_the_library(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op5_sstable(spark, SF).collect())
    assert got == expected([d for d, _ in docs], ids_of("word_bpe_49k.json", [t for _, t in docs], 2))


def test_shards_of_odd_rows_and_lookup(spark, nasty, empty):
    rows = {r.doc_id: r.text for r in nasty.collect() if r.doc_id is not None}
    ids = ids_of("word_bpe_49k.json", rows.values(), 2)
    path = tokenizer_path("word_bpe_49k.json")
    manifest = sstable.write(nasty.filter("doc_id is not null").dropDuplicates(["doc_id"]), path)
    assert sorted(tuple(r) for r in sstable.read(manifest).collect()) == expected(list(rows), ids)
    for d, i in zip(rows, ids, strict=True):
        assert sstable.lookup(manifest, d).tolist() == i.tolist()
    assert sstable.lookup(manifest, 10**6) is None
    assert sstable.read(sstable.write(nasty, path)).count() == nasty.count()
    assert sstable.read(sstable.write(empty, path)).count() == 0


@pytest.mark.parametrize("text", ["A<|startoftext|>B <|ENDOFTEXT|>. x", "e\u0301. E\u0301, don't. it's, a.b. c.,", "\u3000x\u00a0y. 12. 3,4 \u212a."])
def test_word_cache_is_exact(text):
    encode = sstable.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    want = ids_of("word_bpe_49k.json", [text, "", text], 2)
    for _ in range(2):
        ids, ends = encode([text.encode(), b"", text.encode()])
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [w[:-1].tolist() for w in want]


#: What texts are made of when both libraries, or cached and whole encoding, are held against each other.
PIECES = ["a", "Ab", "the", "don't", "'s", "'ll", "'Re", "é", "ñu", "ß", "œ", "12", "3", ".", ",", "...", "!?", "&&", "<|", "<|endoftext|>", "_", "-", "—", "€", " ", "  ", "\n", "\n\n", "\t", " \n", "\r\n", " ", "　", "日本", "é", "K", "İ", "ǅ", "\x00", "\x1c", "­", "x" * 300]


def fuzz(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(PIECES, rng.integers(0, 25))) for _ in range(n)]


def test_cached_encoding_equals_the_library_on_mixed_texts(monkeypatch):
    monkeypatch.setattr(sstable.WordEncoder, "MOST_BYTES", 5_000)
    encode, texts = sstable.WordEncoder(tokenizer_path("word_bpe_49k.json")), fuzz(4000, 1)
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        ids, ends = encode([t.encode() for t in some])
        for t, got, want in zip(some, np.split(ids, ends[:-1]), ids_of("word_bpe_49k.json", some, 2), strict=True):
            assert got.tolist() == want[:-1].tolist(), t


def test_fast_encoding_equals_the_library_on_mixed_texts():
    encode, texts = packing.Encoder(tokenizer_path("byte_bpe_50k.json")), fuzz(4000, 2)
    for t, want in zip(texts, ids_of("byte_bpe_50k.json", texts, 1), strict=True):
        assert encode(t).tolist() == want[:-1].tolist(), t

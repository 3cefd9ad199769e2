"""The pipeline as a whole, very long texts through every operator, and statistics, rankings and scores against brute force."""

import math
import re
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_decontaminate import WORDS as ITEM_WORDS
from tests.llm.test_decontaminate import split
from tests.llm.test_models import brute_dedup
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_tokens import check_packing, ids_of
from vigil.llm import chat, common, decontaminate, html, ledger, lm, packing, quality, simhash, sstable, substring
from vigil.llm.queries import QUERIES, op6_tree_extraction, op9_attention_lm, tokenizer_path

SF = "/root/testdata/sf0.001"
WHITE = re.compile("[\x20\x09-\x0d]+")


def words_of(text):
    return [w for w in WHITE.split(text or "") if w]


def brute_statistics(text):
    text = text or ""
    w, lines = words_of(text), [x for x in text.split("\n") if words_of(x)]
    chars = "".join(WHITE.split(text))
    kind = lambda *k: sum(unicodedata.category(c).startswith(k) for c in text)
    n, x, rows = max(len(w), 1), max(len(chars), 1), max(len(lines), 1)
    count = lambda cs: sum(c in cs for c in text)
    letters = kind("L")
    return {
        "words": len(w), "distinct": len(set(w)) / n, "lines": len(lines), "same_lines": 1 - len(set(lines)) / rows, "bars": sum(" | " in s for s in lines) / rows, "word_length": len(chars) / n, "letters": letters / x,
        "upper": kind("Lu") / max(letters, 1), "digits": count("0123456789") / x, "symbols": count("#*$%&|<>{}[]=_/\\") / n, "marks": count("!?") / n, "stops": count(".,;:") / n, "twice": sum(a == b for a, b in zip(w, w[1:])) / n, "line_words": len(w) / rows, "root_distinct": len(set(w)) / math.sqrt(n),
    }


def test_statistics_equal_brute_force(spark, nasty):
    texts = [r.text for r in nasty.collect()] + ["Aa aa aa, Aa | b\nx | y!\n\n x | y!", "É ß ÑÑ 12 3.5 #*$% {[]}=_/\\ ...", "a\tb\x0bc\x1cd\x85e"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.features(df, "doc_id").collect():
        want = brute_statistics(texts[r.doc_id])
        assert all(math.isclose(r[f"f_{k}"], v, rel_tol=1e-12, abs_tol=1e-12) for k, v in want.items()), (texts[r.doc_id][:50], want, r)


@pytest.fixture(scope="module")
def long(spark):
    """A word a million times, and a text that is one word."""
    return spark.createDataFrame([(1, "w " * 1_000_000), (2, "x" * 1_000_000), (3, "w " * 1_000_000)], "doc_id long, text string")


def test_very_long_texts_through_every_operator(spark, long):
    model = quality.Ensemble(0.3, ((((0, True, 200.0), (12, False, 0.1)), 1.5),))
    assert [r.score for r in quality.score(long, model).orderBy("doc_id").collect()] == pytest.approx([1 / (1 + math.exp(-0.3))] * 3)
    assert [r.f_twice for r in quality.features(long, "doc_id").orderBy("doc_id").collect()] == [0.999999, 0, 0.999999]
    rows = {r.doc_id: r.text for r in long.collect()}
    bpe = tokenizer_path("byte_bpe_50k.json")
    check_packing(packing.pack(long, bpe).collect(), list(rows), ids_of("byte_bpe_50k.json", rows.values(), 1))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(long).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup(long).collect()} == {1: (1_000_000, 1_000_000), 2: (1, 0), 3: (1_000_000, 1_000_000)}
    got = {r.doc_id: r.n_tokens for r in sstable.read(sstable.write(long, tokenizer_path("word_bpe_49k.json"))).collect()}
    assert got[1] == got[3] == 1_000_001
    rules = {r.doc_id: (r.n_words, r.n_repeat_words, r.kept) for r in ledger.apply_policy(ledger.ledger(long)).collect()}
    assert rules == {1: (1_000_000, 1_000_000, False), 2: (1, 0, False), 3: (1_000_000, 1_000_000, False)}
    assert lm.score(long, bpe).filter("score < 0").count() == 3
    bench = spark.createDataFrame([(1, "w " * 10)], "item_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.report(long, bench).collect()} == {1: (1_000_000, 1_000_000), 2: (1, 0), 3: (1_000_000, 1_000_000)}
    assert html.extract(spark.createDataFrame([(1, "u", "<p>" + "w " * 1_000_000)], "page_id long, url string, html string")).count() == 1
    talk = long.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), "text")
    assert {r.conv_id: r.loss_chars for r in chat.digest(talk).collect()} == {1: 2_000_000, 2: 1_000_000, 3: 2_000_000}


def test_texts_of_several_shards_equal_one(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 40)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 5, 39, 81, 300, 1000)]
    items = decontaminate.Queries(decontaminate.prepared([("i", b"a b c a b c a b c a b"), ("j", b"c c"), ("k", b"")]))

    class Blocks:
        args = (10, 10, 0)

        def __iter__(self):
            yield items

    got = {row: (n, spans, found) for row, n, spans, found in decontaminate.searched(((t.encode(),) for t in texts), Blocks())}
    for t in texts:
        w = t.split()
        hit, names = set(), set()
        for name, window in (("i", "a b c a b c a b c a".split()), ("i", "b c a b c a b c a b".split()), ("j", ["c", "c"])):
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    names.add(name)
        n, spans, found = got[(t.encode(),)]
        assert (n, found) == (len(w), sorted(names)) and {p for a, b in spans for p in range(a, b)} == hit


def test_extraction_of_real_pages(spark):
    """The registered query over whole pages: paragraphs of their articles are there, words of menus and scripts aren't."""
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: r for r in op6_tree_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(pages)
    found = lost = said = 0
    for i, source in pages.items():
        r = got[i]
        assert r.n_chars == len(r.text)
        article = re.search(r"<article[^>]*>(.*?)</article>", source or "", re.S)
        if article:
            inner = re.sub(r"<(aside|nav|footer|form|script|style|section)\b.*?</\1>", "", article[1], flags=re.S)
            for p in re.findall(r"<p>([^<&]{60,})</p>", inner):
                text = " ".join(p.split())
                found, lost = found + (text in r.text), lost + (text not in r.text)
        for s in re.findall(r"<(?:script|style)\b[^>]*>([^<]{20,})</(?:script|style)>", source or ""):
            said += " ".join(s.split())[:40] in r.text
    assert found > 100 and lost <= 0.01 * found and said == 0


def test_scores_equal_brute_force(spark):
    """Base and score of every document, by the model of the query, word by word."""
    path, docs = tokenizer_path("byte_bpe_50k.json"), spark.read.parquet(f"{SF}/documents.parquet")
    table = common.written(lm.encoded(docs, path), "t")
    model = lm.train(table)
    rows = {r.doc_id: bytes(r.ids) for r in table.collect()}
    train = [d for d in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    tokens = {r.doc_id: [w.lower() for w in (r.text or "").encode().split()] for r in docs.collect()}
    counts = Counter(w for d in train for w in tokens[d])
    counts[None] = len(train)
    total, begins = sum(counts.values()), np.append(lm._word_tables(path)[0], True)
    got = {r.doc_id: r for r in op9_attention_lm(spark, SF).collect()}
    better = []
    for d in sorted(rows)[:40]:
        ids = np.frombuffer(rows[d], np.uint16)
        x, y, real = lm.windows_of(ids)
        c = model.forward(x)
        p = np.exp((c["z"] - c["total"])[..., model.of] + model.subword[x[:, lm.CONTEXT :]])[real]  # of each subword or the end, at each place
        own, ends = p[np.arange(len(p)), y[real]], p[:, begins].sum(1)
        score, at = 0.0, [*np.flatnonzero(begins[:-1][ids]), len(ids)] if len(ids) else [0]
        for k, i in enumerate(at):
            j = at[k + 1] if k + 1 < len(at) else len(ids) + 1
            word = np.prod(own[i:j].astype(float)) / ends[i] * (ends[j] if k + 1 < len(at) else 1)
            score += math.log10(lm.MIXED * word + (1 - lm.MIXED) * counts[[*tokens[d], None][k]] / total)
        assert got[d].score == pytest.approx(score, rel=2e-3, abs=2e-2)
        better.append(got[d].score - got[d].base_score)
    assert all(math.isfinite(b) for b in better)


@pytest.mark.parametrize("ids", [[None, 5, 5, 2, None, 9, 9, 1]])
def test_pipeline_of_odd_rows(spark, tmp_path, ids):
    """Null and repeated ids, null and empty texts, equal rows, columns of clashing and dotted names, through run()."""
    rng = np.random.default_rng(9)
    lexicon = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(lexicon, n))
    passage, item = prose(60), prose(12)
    texts = [prose(80) + " " + passage + " " + prose(30), prose(50) + " " + passage, prose(90) + " " + item + " " + prose(20), None, "", prose(70), prose(90), prose(40) + " " + item]
    rows = [(i, t, "en", "src", None if t is None else len(t), 1.5, "c", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows.append(rows[-1])
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` double, __gone string, fp long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r.fp, r.doc_id, r.text)
    kept = cp.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.schema == docs.schema and sorted(map(key, kept.collect()), key=str) == sorted(map(key, docs.collect()), key=str)  # no label: the share, a half, is enough
    stages = dict(cp.STAGES)
    one = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert one.schema == docs.schema
    fp = {r.fp: brute_fingerprint(r.text) for r in docs.collect()}
    root = brute_components(set(fp.values()))
    assert Counter(root[fp[r.fp]] for r in one.collect()) == Counter(set(root[f] for f in fp.values()))
    assert sorted(r.fp for r in one.collect()) == [0, 1, 2, 3, 5, 6, 7]  # of the two empty texts the one with an id stays
    cut = stages["substring_dedup"](spark, one, str(tmp_path))
    assert cut.schema == docs.schema
    left = {r.fp: r for r in cut.collect()}
    for r, (_, n, _) in zip(found := one.collect(), brute_dedup([r.text for r in found], 35), strict=True):
        assert (left[r.fp].text == r.text) == (n == 0) and left[r.fp].n_chars == (r.n_chars if n == 0 else len(left[r.fp].text))
    assert all(passage not in (left[k].text or "") for k in (0, 1))
    clean = stages["decontamination"](spark, cut, str(tmp_path))
    assert clean.schema == docs.schema
    after = {r.fp: r for r in clean.collect()}
    assert item not in after[2].text and item not in after[7].text and after[5].text == left[5].text
    assert after[2].n_chars == len(after[2].text)
    pieces = cp.run(spark, str(tmp_path)).collect()
    want = ids_of("byte_bpe_50k.json", [r.text for r in after.values()], 1)
    assert sum(p.length for p in pieces) == sum(map(len, want)) and {p.sequence_id for p in pieces}


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_run_equals_brute_force(spark):
    """run() over whole tables: each stage's rows by brute force from what the classifier keeps, then packing."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    now = {r.doc_id: r.text for r in cp.quality_stage(spark, docs, SF).collect()}
    fp = {d: brute_fingerprint(t) for d, t in now.items()}
    root, least = brute_components(set(fp.values())), {}
    for d in sorted(fp):
        least.setdefault(root[fp[d]], d)
    now = {d: now[d] for d in least.values()}
    seen = Counter(tuple(w[i : i + 35]) for w in map(words_of, now.values()) for i in range(len(w) - 34))
    for d, t in list(now.items()):
        w = words_of(t)
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        if gone:
            now[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
    windows = {tuple(w[i : i + 10]) for r in bench.collect() for w in [split(r.text)] for i in range(max(1, len(w) - 9) if w else 0)}
    for d, t in list(now.items()):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        at, hit = [m.span() for m in ITEM_WORDS.finditer(low)], set()
        w = [low[a:b] for a, b in at]
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        out, last, i = [], 0, 0
        while i < len(w):
            if i in hit:
                j = i
                while j + 1 in hit:
                    j += 1
                out.append(t[last : at[i][0]])
                last, i = at[j][1], j
            i += 1
        if hit:
            now[d] = "".join([*out, t[last:]])
    check_packing(cp.run(spark, SF).collect(), list(now), ids_of("byte_bpe_50k.json", now.values(), 1))


def test_scores_of_odd_rows(spark, nasty, empty):
    """Row by row, null and repeated ids included; without training documents; of nothing."""
    path = tokenizer_path("byte_bpe_50k.json")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.held_out) for r in lm.score(nasty, path).collect())
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    assert got == sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode().split()) + 1, held(r.doc_id)) for r in nasty.collect())
    only = spark.createDataFrame([(i, "a b") for i in range(200) if held(i)], "doc_id long, text string")
    rows = lm.score(only, path).collect()
    assert rows and all((r.train_tokens, r.n_known, r.held_out) == (0, 0, True) and math.isfinite(r.score) for r in rows)
    assert lm.score(empty, path).count() == 0


def test_shards_of_null_and_repeated_ids(spark, nasty, monkeypatch):
    """Whole rows of every id, in as many files as it takes, with gapless starts."""
    monkeypatch.setattr(sstable, "FILE_BYTES", 1)
    path = tokenizer_path("word_bpe_49k.json")
    manifest = sstable.write(nasty, path)
    got = sorted((tuple(r) for r in sstable.read(manifest).collect()), key=lambda r: r[1])
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in nasty.collect()]
    assert [(d is not None, d or 0) for d, *_ in got] == sorted(ids)
    want = Counter((r.doc_id, zlib.crc32(i.tobytes())) for r, i in zip(nasty.collect(), ids_of("word_bpe_49k.json", [r.text for r in nasty.collect()], 2), strict=True))
    assert Counter((d, crc) for d, _, _, crc in got) == want
    assert sstable.lookup(manifest, 3).tolist() == ids_of("word_bpe_49k.json", ["a"], 2)[0].tolist()


def test_packing_of_repeated_rows(spark, nasty):
    """Every row is packed, those of one id and text too."""
    rows = [r.text for r in nasty.collect()]
    got = packing.pack(nasty, tokenizer_path("byte_bpe_50k.json")).collect()
    ids = ids_of("byte_bpe_50k.json", rows, 1)
    assert sum(p.length for p in got) == sum(map(len, ids)) and sum(p.start == 0 for p in got) == len(rows)
    assert Counter((p.ids_crc32 if p.start == 0 and p.length == p.doc_tokens else None) for p in got if p.doc_tokens < 50) == Counter(zlib.crc32(i.tobytes()) for i in ids if len(i) < 50)


def test_what_operators_wrote_can_be_deleted(spark):
    """Nothing stands in the shared folder afterwards that didn't before, whatever ran."""
    from vigil.plans.streams import stream_throttled_events
    from vigil.sources.shared import run_dir, shared_dir

    common.clean(spark)
    place = Path(shared_dir(spark).removeprefix("file://"))
    before = set(place.iterdir()) if place.exists() else set()
    for query in ("op2_bm25_packing", "op3_simhash_trie", "op4_anchor_dedup", "op5_sstable", "op8_chat_round_trip", "op10_fm_decontamination", "op11_block_max_wand", "op12_conversation_repair"):
        assert QUERIES[query](spark, SF).count() > 0
    assert stream_throttled_events(spark, SF).count() > 0
    df = common.written(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and common.run_dir(spark) == run_dir(spark) and set(place.iterdir()) > before
    common.clean(spark)
    assert set(place.iterdir()) == before

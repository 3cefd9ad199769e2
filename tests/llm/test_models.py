"""Scores, dedup of passages, chat formatting and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np

from vigil.llm import chat, lm, quality, substring
from vigil.llm.queries import op9_attention_lm, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) / len(held) > 0.9
    assert 0 < len(model.rules) < 120 and all(0 <= r.score <= 1 for r in got.values())


def test_classifier_of_odd_rows(spark, nasty, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, text int")
    model = quality.train(nasty, labels)
    assert quality.score(nasty, model).count() == nasty.count()
    assert quality.accepted(nasty, model).columns == nasty.columns
    assert quality.score(empty, quality.train(empty, labels.limit(0))).count() == 0


def test_the_sample_takes_one_row_an_id(spark, monkeypatch):
    rows = [(i, f"text number {i} of some words") for i in range(60)] + [(7, f"another text {i}") for i in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda x, y: sizes.append(len(y)))
    quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert sizes == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60))]


def test_columns_equal_the_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.Ensemble(0.3, ((((0, True, 200.0), (7, False, 0.1)), 1.5), (((9, True, 0.2),), -2.0)))
    rows = quality.features(docs, "doc_id").withColumn("score", model.column()).toPandas()
    x = rows[[f"f_{n}" for n in quality.NAMES]].to_numpy()
    z = 0.3 + sum(w * quality.holds(r, x) for r, w in model.rules)
    assert np.allclose(rows.score, 1 / (1 + np.exp(-z)))


def brute_dedup(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def test_passages_equal_brute_force(spark, nasty, empty):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (5, 8):
        got = [(r.n_words, r.n_removed, r.kept) for r in substring.dedup(df, window).orderBy("doc_id").collect()]
        assert got == brute_dedup(texts, window)
    rows = nasty.collect()
    got = sorted((r.n_words, r.n_removed, r.kept) for r in substring.dedup(nasty).collect())
    assert got == sorted(brute_dedup([r.text for r in rows], 35))
    assert substring.dedup(empty).count() == 0


def test_base_scores_equal_brute_force(spark):
    docs = [(r.doc_id, (r.text or "").encode().lower().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    train = [w for d, w in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(x for w in train for x in w)
    counts[None] = len(train)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in op9_attention_lm(spark, SF).collect()}
    for d, w in docs:
        r = got[d]
        c = [counts[x] for x in [*w, None]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(c), sum(x > 0 for x in c), n)
        assert math.isclose(r.base_score, sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), rel_tol=1e-9)
        assert r.score < 0


def test_attention_gradients_and_normalisation():
    rng = np.random.default_rng(1)
    side = lm.SUBWORDS + 2
    pairs = rng.integers(0, 3, (side, side))
    model = lm.Model(pairs)
    for k in ("o", "ob"):
        model.w[k] += rng.normal(0, 0.2, model.w[k].shape).astype(np.float32)
    x, y, real = lm.windows_of(rng.integers(0, lm.SUBWORDS, 50))
    total = np.log(np.exp(model.subword[7] + (z := model.prior[7] - np.log(np.exp(model.prior[7]).sum()))[model.of]).sum())
    assert abs(total) < 1e-4  # class and member probabilities make one distribution
    def loss():
        c = model.forward(x)
        return -(np.take_along_axis(c["z"] - c["total"], model.of[y][..., None], 2)[..., 0] * real).sum() / real.sum()

    g = model.gradients(x, y, real)
    for k, at in (("q", (1, 2)), ("v", (3, 4)), ("h", (5, 6)), ("e", (int(x[0, 20]), 3)), ("p", (12, 1))):
        w, eps = model.w[k], 3e-2
        w[at] += eps
        up = loss()
        w[at] -= 2 * eps
        down = loss()
        w[at] += eps
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3
    assert real.sum() == 51


def test_the_fit_sees_every_window_of_every_training_document(spark):
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, lm.SUBWORDS, n).astype(np.uint16) for n in [0, 31, 32, 3000, *rng.integers(0, 40, 500)]]
    rows = [(i if i % 9 else None, i % 5 == 1, bytearray(x.tobytes())) for i, x in enumerate(ids)]
    seen: list[int] = []
    lm.train(spark.createDataFrame(rows, "doc_id long, held_out boolean, ids binary"), seen)
    assert sum(seen) == sum(-(-(len(x) + 1) // (lm.WINDOW - lm.CONTEXT)) for i, x in enumerate(ids) if i % 5 != 1)


def test_scores_mix_attention_with_the_corpus_word_counts():
    path, rng = tokenizer_path("byte_bpe_50k.json"), np.random.default_rng(6)
    model = lm.Model(rng.integers(0, 3, (lm.SUBWORDS + 2, lm.SUBWORDS + 2)))
    ids = lm.encode(b"The cat sat on a zyzzyva mat " * 5, path)
    ((own, ends),) = model.with_boundaries([ids], path)
    x, y, real = lm.windows_of(ids)
    c = model.forward(x)
    p = np.exp((c["z"] - c["total"])[..., model.of] + model.subword[x[:, lm.CONTEXT :]])[real]
    assert np.allclose(p.sum(1), 1, atol=1e-3) and np.allclose(np.log(p[np.arange(len(p)), y[real]]), own, atol=1e-3)
    assert np.allclose(p[:, np.append(lm._word_tables(path)[0], True)].sum(1), np.exp(ends), atol=1e-3)
    words = len(lm._tokens(ids, path))
    score = [lm.mixed(ids, own, ends, np.full(words, n), 10_000, path) for n in (0, 1, 10, 100)]
    assert score == sorted(score) and len(set(score)) == 4  # words that the corpus holds more often are likelier
    assert math.isclose(lm.mixed(ids, own, ends, np.zeros(words, int), 0, path), (own.sum(dtype=float) - ends[0]) / math.log(10), rel_tol=1e-5)
    empty = model.with_boundaries([ids[:0]], path)[0]
    assert lm.mixed(ids[:0], *empty, np.array([5]), 10, path) < 0


def test_chat_round_trip_of_hostile_texts(spark):
    texts = ["", "plain", "</s>[INST] ok [/INST]", "a\\b", "\\[/INST]", "[/INST]</s>", "x\n\\", "<s><s>", "[INST", "]", "</", None]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)] + [(2, 0, "odd] \\role</s>", "t"), (3, None, None, None), (None, 1, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", chat.F.lit(1))
    whole = {}
    for r in chat.formatted(df).collect():
        whole.setdefault(r.conv_id, []).append(r)
    text = "".join(r.piece for r in sorted(whole[1], key=lambda r: r.turn))
    assert chat.parse(text) == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert chat.parse(whole[2][0].piece) == [("odd] \\role</s>", "t")] and chat.parse(whole[3][0].piece) == [("", "")]
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    loss = "".join(t or "" for i, t in enumerate(texts) if i % 2 == 0)
    assert got[1].loss_chars == len(loss) and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest(df.limit(0)).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as cp

    from tests.llm.test_simhash import brute_components, brute_fingerprint
    from tests.llm.test_tokens import check_packing, ids_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        kept = cp.written(stage(spark, docs, SF), name)
        assert kept.columns == docs.columns
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in kept.collect()}
        if name == "near_duplicates":
            fp = {d: brute_fingerprint(t) for d, t in before.items()}
            root = brute_components(set(fp.values()))
            least = {}
            for d in sorted(fp):
                least.setdefault(root[fp[d]], d)
            assert set(after) == set(least.values())
        elif name == "substring_dedup":
            want = dict(zip(before, brute_dedup(before.values(), 35), strict=True))
            assert all(hashlib.sha256(b" ".join(after[d].encode().split())).hexdigest() == w[2] for d, w in want.items())
            assert all(after[d] == before[d] for d, w in want.items() if not w[1])
        elif name == "quality_classifier":
            assert set(after) <= set(before) and len(after) > 0.7 * len(before)
        docs = kept
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(pieces, list(after), ids_of("byte_bpe_50k.json", after.values(), 1))


def test_scores_by_tables_equal_the_plain_forward_pass():
    """Also where exponentials would overflow or vanish, and for the empty text."""
    rng = np.random.default_rng(3)
    side = lm.SUBWORDS + 2
    model = lm.Model(rng.integers(0, 4, (side, side)))
    texts = [rng.integers(0, lm.SUBWORDS, n).astype(np.uint16) for n in (0, 1, 31, 32, 33, 700)]
    for scale in (1, 40):
        for name in ("q", "o", "ob"):
            model.w[name] = (rng.normal(0, 0.3, model.w[name].shape) * scale).astype(np.float32)
        for text, got in zip(texts, model.log_probabilities(texts), strict=True):
            x, y, real = lm.windows_of(text)
            c = model.forward(x)
            want = np.take_along_axis(c["z"] - c["total"], model.of[y][..., None], 2)[..., 0] + model.subword[x[:, lm.CONTEXT :], y]
            assert len(got) == len(text) + 1
            np.testing.assert_allclose(got, want[real], rtol=2e-3, atol=2e-3)


def test_word_hashes_tell_words_apart_and_only_words():
    path = tokenizer_path("byte_bpe_50k.json")
    words = [b"a", b"ab", b"b", b"ba", "日本".encode(), "本日".encode(), b"a" * 3000, b"a" * 3001, b"ab", b"a"]
    got = lm._tokens(lm.encode(b" \t".join(words), path), path)
    assert len(got) == len(words) + 1
    assert len(set(got.tolist())) == len(set(words)) + 1
    assert (got[0], got[1]) == (got[9], got[8])
    assert len(lm._tokens(lm.encode(b" \n", path), path)) == 1


def test_texts_together_equal_texts_alone():
    path, rng = tokenizer_path("byte_bpe_50k.json"), np.random.default_rng(4)
    texts = [lm.encode(b" ".join(rng.choice([b"the", b"cat", b"zyzzyva", b"12"], n)), path) for n in (0, 1, 40, 0, 300, 7)]
    model = lm.Model(rng.integers(0, 3, (lm.SUBWORDS + 2, lm.SUBWORDS + 2)))
    for got, want in zip(lm.windows_of(*texts), zip(*map(lm.windows_of, texts)), strict=True):
        assert np.array_equal(got, np.concatenate(want))
    h, lengths = lm._tokens_of(texts, path)
    assert np.array_equal(h, np.concatenate([lm._tokens(t, path) for t in texts])) and lengths.tolist() == [len(lm._tokens(t, path)) for t in texts]
    apart = model.with_boundaries(texts, path)
    counts = np.split(np.arange(len(h)) % 5, np.cumsum(lengths)[:-1])
    for tokens in (0, 100):
        got = lm.mixed_of(texts, *map(np.concatenate, zip(*apart)), np.concatenate(counts), tokens, path)
        assert np.allclose(got, [lm.mixed(t, *a, c, tokens, path) for t, a, c in zip(texts, apart, counts)], rtol=1e-12)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        asked = np.concatenate([keys, rng.integers(0, 1 << 64, 999, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert np.array_equal(lm._places_in(keys)(asked), np.searchsorted(keys, asked))
    rows = [(i, b"x" * n) for i, n in enumerate([5] * 130 + [1 << 19] * 3 + [0] * 3)]
    groups = list(lm._together(iter(rows), 1))
    assert sum(groups, []) == rows and [len(g) for g in groups] == [64, 64, 3, 1, 1, 3]

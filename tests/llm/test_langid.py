"""Language identification: subwords, gradients and scores against plain versions, held-out accuracy, rejection, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import langid
from vigil.llm.queries import op13_language_id

SF = "/root/testdata/sf0.01"


def words(text):
    out, word = [], ""
    for c in text.lower():
        if c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def bucket(piece):
    h = 0
    for c in piece:
        h = (h * 1_000_003 + (0 if c == "\0" else ord(c)) + 1) % 2**64
    h = (h + len(piece)) % 2**64
    h ^= h >> 31
    h = h * 0x9E3779B97F4A7C15 % 2**64
    return (h ^ (h >> 29)) >> 49


def brute_buckets(text):
    found = Counter()
    for w in words(text):
        w = f"\0{w}\0"
        found.update(bucket(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1) if w[i : i + n] != "\0")
    return found


def shared_edges(text):
    """The array form has one edge between two words, so that each word has an edge before and after it."""
    return Counter(langid.subwords(langid.words_of(text)[0]).tolist())


@pytest.mark.parametrize("text", ["a", "Ab cd", "  Éé ß, x1y\n\nzz", "", "123 !?", "ÑÑÑ", "aé" * 50, "ǅ İ ıI", "漢字 かな"])
def test_subwords_are_those_of_the_words(text):
    assert shared_edges(text) == brute_buckets(text)


def test_random_texts_have_the_same_subwords():
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choices("abcÉé ß.1\n-", k=rnd.randrange(60)))
        assert shared_edges(text) == brute_buckets(text), repr(text)


def test_slices_do_not_matter():
    rnd = random.Random(3)
    for _ in range(60):
        text = "".join(rnd.choices("abcÉé ß.1\n-", k=rnd.randrange(200)))
        whole = Counter(langid.subwords(langid.words_of(text)[0]).tolist())
        for size in (1, 2, 3, 7, 50):
            n = langid.totals(text, size)
            assert {int(b): int(n[b]) for b in np.flatnonzero(n)} == whole, (text, size)


def test_gradients_are_those_of_the_loss():
    rnd = np.random.default_rng(1)
    embedded, linear, bias, share = rnd.normal(size=(5, 3)), rnd.normal(size=(3, 4)), rnd.normal(size=4), rnd.random(5)
    loss = lambda e, w, b: -math.log(langid.softmax((share @ e) @ w + b)[2])
    for got, which in zip(langid.gradients(embedded, linear, bias, share, 2), range(3), strict=True):
        for at in np.ndindex(got.shape):
            up, down = ([x.copy() for x in (embedded, linear, bias)] for _ in range(2))
            up[which][at] += 1e-6
            down[which][at] -= 1e-6
            assert math.isclose((loss(*up) - loss(*down)) / 2e-6, got[at], abs_tol=1e-6)


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_documents_and_short_pieces(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in op13_language_id(spark, SF).collect()}
    assert set(got) == {r.doc_id for r in rows} and all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert len(held) > 250 and np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got.values())
    short = [(r.lang, *model.answer(" ".join(r.text.split()[3:11]))) for r in held if len(r.text.split()) > 11]
    right = [lang == said for lang, said, _, _ in short]
    assert np.mean(right) > 0.9
    score = np.array([s for *_, s, _ in short])
    assert abs(score.mean() - np.mean(right)) < 0.06  # calibrated
    accepted = [a == b for a, b, _, rejected in short if not rejected]
    assert len(accepted) > 0.5 * len(short) and np.mean(accepted) >= np.mean(right) and np.mean(accepted) > 0.95


def test_scores_are_those_of_a_plain_forward_pass(spark, model):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect():
        found = brute_buckets(r.text)
        n = sum(found.values())
        z = [(sum(float(model.weights[b, i]) * k for b, k in found.items()) / n + float(model.bias[i])) * math.exp(model.slope[0] + model.slope[1] * math.log(n)) for i in range(len(model.languages))]
        e = [math.exp(x - max(z)) for x in z]
        said, score, _ = model.answer(r.text)
        assert said == model.languages[e.index(max(e))] and math.isclose(score, max(e) / sum(e), rel_tol=1e-3)


def test_gibberish_is_rejected(model):
    assert model.answer("漢字 かな")[2] and model.answer("")[0] == "und"


def test_learning_takes_neither_held_out_rows_nor_other_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = langid.train(docs)
    b = langid.train(docs.withColumn("lang", F.when(langid.third(1), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other")).repartition(5))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and (a.slope, a.least) == (b.slope, b.least)


def test_the_sample_is_bounded_and_takes_copies_once(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a copy").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.when(F.col("id") < 2900, "en").otherwise("fr").alias("lang"))
    got = Counter(r.lang for r in langid.sampled(docs, 100).collect())
    assert 60 < got["en"] < 140 and 30 < got["fr"] <= 67


def test_odd_rows(spark, nasty, empty, model):
    rows = sorted((tuple(r) for r in langid.identify(nasty, model).collect()), key=str)
    assert len(rows) == nasty.count()
    letters = {r.doc_id: bool(words(r.text or "")) for r in nasty.collect() if r.doc_id is not None}
    for doc_id, _, said, score, rejected in rows:
        if doc_id is not None:
            assert (said in model.languages and score > 0) == letters[doc_id] and (letters[doc_id] or (said, score, rejected) == ("und", 0.0, True))
    assert langid.identify(empty, model).collect() == []


def test_little_to_learn_from(spark, empty):
    one = spark.createDataFrame([(1, "hello", "en"), (2, "12", None), (3, None, "en")], "doc_id long, text string, lang string")
    nothing = langid.train(empty.withColumn("lang", F.lit(None).cast("string")))
    assert nothing.languages == () and {r.lang_pred for r in langid.identify(one, nothing).collect()} == {"und"}
    only = langid.train(one)
    assert [r.lang_pred for r in langid.identify(one, only).orderBy("doc_id").collect()] == ["en", "und", "und"]
    long = spark.createDataFrame([(1, "w " * 1_000_000), (2, "x" * 1_000_000)], "doc_id long, text string")
    assert len(langid.identify(long, only).collect()) == 2

"""Block-max WAND against the plain ranking: random texts, ties, many shards and blocks of questions, odd rows; the cut of postings against all cuts; the registered query against SQL."""

import math
import random
import re
from collections import Counter
from functools import partial
from itertools import product

import duckdb
import numpy as np
import pytest

from vigil.llm import common, wand
from vigil.llm.queries import op11_block_max_wand

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    texts = [(d, split(t)) for d, t in docs if split(t)]
    n_docs, total = len(texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for doc, w in texts:
            m = 100 - 75 + (75 * len(w) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in split(text) if t in w)
            if score > 0:
                found.append((-score, doc is not None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(found[:top])]
    return sorted(out, key=str)


def got(docs, items, shard_terms=wand.SHARD_TERMS, **options):
    return sorted((tuple(r) for r in wand.search(wand.index(docs, shard_terms), items, **options).collect()), key=str)


def texts_at_random(seed, n, longest=30):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "ß1", "A", "a"]
    some = lambda: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=rnd.randrange(longest)))
    return [some() for _ in range(n)]


def test_cut_is_the_best_of_all_cuts():
    rnd = random.Random(1)
    lists = [np.array([rnd.choice([1, 2, 5, 9, 9, 30]) for _ in range(rnd.randrange(1, 9))], np.int64) for _ in range(40)]

    def cost(s, ends):
        return sum(8 + (b - a) * int(s[a:b].max()) - int(s[a:b].sum()) for a, b in zip([0, *ends[:-1]], ends, strict=True))

    for s, ends in zip(lists, wand.cut(lists, 4, 8), strict=True):
        all_cuts = [[*(i + 1 for i, x in enumerate(c) if x), len(s)] for c in product((0, 1), repeat=len(s) - 1)]
        allowed = [e for e in all_cuts if all(b - a <= 4 for a, b in zip([0, *e[:-1]], e, strict=True))]
        assert list(ends) in allowed and cost(s, list(ends)) == min(cost(s, e) for e in allowed)


@pytest.mark.parametrize("size", [1 << 20, 400])
def test_random_texts_with_ties_over_many_shards(spark, size):
    docs = list(enumerate(texts_at_random(3, 150))) + [(i, "w1 w2 w39") for i in range(300, 330)] + [(None, "w1 w2 w39"), (7, "w1 w2 w39"), (7, "w1 w2 w39"), (400, None), (401, " .,!")]
    items = list(enumerate(texts_at_random(4, 30, 12))) + [(90, "w1 w2 w39 w39"), (91, None), (92, "nowhere"), (93, "W1 w1-W2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(df, spark.createDataFrame(items, "item_id long, text string"), 200, size=size) == brute(docs, items)


def test_shards_in_one_process_carry_the_threshold(monkeypatch):
    """Blocks are skipped, and the answer is that of the plain ranking all the same."""
    monkeypatch.setattr(wand, "FIRST_STEP", 4)
    monkeypatch.setattr(wand, "cut", partial(wand.cut, longest=4, block=300_000))
    docs = list(enumerate(texts_at_random(5, 400)))
    texts = [(d, t) for d, t in docs if split(t)]
    n_docs, total = len(texts), sum(len(split(t)) for _, t in texts)
    df = {}
    for _, t in texts:
        for x in set(split(t)):
            df[x.encode()] = df.get(x.encode(), 0) + 1
    shards, b = [], wand.Builder()
    for d, t in docs:
        b.add(d, t.encode())
        if b.full(600):
            shards.append(b.row())
            b = wand.Builder()
    shards.append(b.row())
    opened = [wand.Shard(r, n_docs, total) for r in shards]
    seen = []
    plain = wand.Shard._stretches
    for question in ["w30 w31 w0", "w5 w25 w0 w1 w2", "é w38"]:
        terms = sorted({x.encode() for x in split(question)})
        factors = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in terms])
        best = wand.Best(10)
        for s in opened:
            s.open(terms)
            s._stretches = lambda held, mosts, begins, bound, live, best, s=s: (seen.append((len(begins) - 1, len(live))), plain(s, held, mosts, begins, bound, live, best))
            s.search(terms, factors, best)
        assert sorted((0, i + 1, d, s) for i, (s, d) in enumerate(best.rows)) == sorted(brute(docs, [(0, question)]))
    assert len(shards) > 5 and sum(live for _, live in seen) < sum(n for n, _ in seen)


def test_odd_rows_clashing_columns_and_empty_tables(spark, nasty, empty):
    docs = [(r.doc_id, r.text) for r in nasty.collect()]
    items = spark.createDataFrame([("x", "the same words a w", 3), ("x", "a", 4), (None, "again x", 5), ("y", None, 6)], "item_id string, text string, rank int")
    rows = [(r.item_id, r.text) for r in items.collect()]
    assert got(nasty, items) == brute(docs, rows)
    assert got(empty, items) == [] and got(nasty, items.filter("false")) == []


def test_very_long_texts(spark):
    docs = [(1, "w " * 1_000_000), (2, "x" * 1_000_000), (3, "w v")]
    items = [(0, "w v"), (1, "x" * 1_000_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df, spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    want = sorted(con.execute(wand.ORACLE).fetchall())
    assert sorted(tuple(r) for r in op11_block_max_wand(spark, path).collect()) == want
    assert len(want) == 400


def test_the_index_holds_every_posting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {(r.doc_id, t, n) for r in docs.collect() for t, n in Counter(split(r.text)).items()}
    found = set()
    for r in wand.index(docs).toArrow().to_pylist():
        starts, at, tf = (np.frombuffer(r[c], "<u4") for c in ("starts", "docs", "tfs"))
        for i, t in enumerate(r["vocabulary"].split(b" ")):
            found |= {(r["ids"][d], t.decode(), n) for d, n in zip(at[starts[i] : starts[i + 1]].tolist(), tf[starts[i] : starts[i + 1]].tolist(), strict=True)}
    assert found == want and common.run_dir(spark)

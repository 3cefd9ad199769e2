import hashlib
import random
import re

from vigil.llm import decontaminate as dc

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = split(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, items = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[x]
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(docs, bench, **options):
    return sorted((tuple(r) for r in dc.report(docs, bench, **options).collect()), key=str)


def test_random_texts_over_a_small_vocabulary(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "b", "C", "d", "é1", "zz"])
    bench = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(2, 12)] + [(50, None)]
    docs = [(i, "; ".join(rnd.choice([word(), bench[rnd.randrange(5)][1], "out"]) for _ in range(rnd.randrange(60)))) for i in range(80)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert got(d, b) == brute(docs, bench)
    assert got(d, b, block_bytes=40) == brute(docs, bench)  # several blocks


def test_odd_rows(spark, nasty, empty):
    bench = spark.createDataFrame([(1, "the same words again and again the same words again", "x"), (2, "", "y"), (2, "INST", "z")], "item_id long, text string, spans string")
    assert got(nasty, bench) == brute([(r.doc_id, r.text) for r in nasty.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got(empty, bench) == []
    assert got(nasty, bench.limit(0)) == brute([(r.doc_id, r.text) for r in nasty.collect()], [])


def test_removal(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Keep this. One, two three four\nfive six seven eight nine TEN! And this."), (2, "clean  text\n")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dc.remove(docs, bench).collect()} == {1: "Keep this. ! And this.", 2: "clean  text\n"}

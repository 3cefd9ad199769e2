import random

import numpy as np
import xxhash

from vigil.llm import simhash
from vigil.llm.queries import op3_simhash_trie


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def expected(rows):
    return sorted(expected_in_order(rows), key=str)


def expected_in_order(rows):
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    root = brute_components({f for _, f in fp})
    least = {}
    for i, f in fp:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return [(i, f"{f:016x}", least.get(root[f])) for i, f in fp]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op3_simhash_trie(spark, d).collect()), key=str)
    assert got == expected(rows)


def test_odd_rows(spark, nasty, empty):
    got = sorted((tuple(r) for r in simhash.near_duplicates(nasty).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in nasty.collect()])
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(nasty)
    assert kept.schema == nasty.schema
    rows = nasty.collect()
    groups = {}
    for r, (_, _, group) in zip(rows, expected_in_order([(r.doc_id, r.text) for r in rows]), strict=True):
        groups.setdefault(group, []).append((r.doc_id is None, r.doc_id or 0))
    assert sorted(min(g) for g in groups.values()) == sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())


def test_trie_finds_every_link_split_or_not(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:6]:  # chains and dense groups
        for _ in range(120):
            x = b
            for _ in range(rnd.choice([1, 2, 3, 3, 4, 6])):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps |= {base[0] & (2**48 - 1) | (0xABCD << 48) ^ 0 for _ in range(1)} | {(0xABCD << 48) | rnd.getrandbits(48) for _ in range(400)}
    want = brute_components(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for split, count in ((10_000, 0), (40, 0), (40, 10_000_000), (300, 10**13)):  # whole subtrees, split ones, 10 tries, 20 tries
        chosen = simhash.tries(count, 50_000 if count < 10**8 else 1)
        root = {f: f for f in fps}
        for r in simhash.components(simhash.links(df, split, chosen)).collect():
            root[r.node & (2**64 - 1)] = r.root & (2**64 - 1)
        groups = lambda m: {frozenset(f for f in fps if m[f] == g) for g in set(m.values())}
        assert groups(root) == groups(want)


def test_bit_counts_of_long_texts():
    text = b" ".join(b"w%d" % (i % 977) for i in range(70_000))
    hs = np.concatenate(list(simhash.shingle_hashes(text)))
    assert len(hs) == 69_998
    want = sum(1 << b for b in range(64) if 2 * int(((hs >> np.uint64(b)) & np.uint64(1)).sum()) > len(hs))
    assert simhash.fingerprint(text) == want


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    text = "some words that stand in one text only and in no other"
    rows = [(None, text), (5, text), (5, "another text of other words, one two three four five six"), (2, text), (2, text), (None, "lone words without any id"), (None, "lone words without any id")]
    df = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "`doc_id` long, text string, `a.b` double, fp string")
    kept = simhash.keep_first(df)
    assert kept.schema == df.schema
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(2, text, 1.5, "x"), (5, rows[2][1], 1.5, "x"), (None, rows[5][1], 1.5, "x")], key=str)

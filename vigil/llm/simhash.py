"""SimHash near-duplicate groups by a binary trie self-join.

A fingerprint has 64 bits; two fingerprints link at 3 or fewer differing bits. Cut into k blocks, such a pair agrees on at least k - 3 of
them, so every distinct fingerprint goes to one trie for each choice of k - 3 blocks, with these blocks as its leading bits; k grows with
the number of fingerprints (4 blocks and 4 tries, then 10, then 20), so that the subtrees below the leading bits stay small. In
a subtree, node pairs are traversed together from there down; the differing bits accumulate, and a pair is pruned as soon as they exceed the
budget. A subtree or node pair with many fingerprints is split into pairs of its nodes six bits further down, again and again where
needed, so that no task needs to hold it. Inside a task links are merged at once (a spanning forest leaves it, never all pairs of a
group); the forests of all tasks are joined by the large-star, small-star algorithm.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other; repeated
rows give a row each; rows with a null doc_id take part, and a group of only such rows has a null component_id; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vigil.llm.common import delete, place_of, positional, text_bytes, written, written_at

BITS, SUB, BUDGET = 64, 6, 3
#: A subtree or node pair with more distinct fingerprints than this is split into pairs of its nodes; so many of their rows make a task.
SPLIT_ROWS, TASK_ROWS = 50_000, 500_000
_LANES = np.uint64(0x0101010101010101)
_CHUNK = 1 << 16


def shingle_hashes(text: bytes, words: int = 3) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles, in chunks."""
    w, h = text.lower().split(), xxhash.xxh64_intdigest
    if not w:
        return
    if len(w) < words:
        yield np.array([h(b" ".join(w), 42)], np.uint64)
        return
    n = len(w) - words + 1
    for at in range(0, n, _CHUNK):
        part = w[at : at + _CHUNK + words - 1]
        m = min(_CHUNK, n - at)
        yield np.fromiter((h(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(words)))), np.uint64, m)


def fingerprint(text: bytes) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text):
        n += len(h)
        starts = np.arange(0, len(h), 255)  # a byte lane counts to 255
        for k in range(8):
            lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts)
            ones[k::8] += lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, fp long")


def _link(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> bool:
    """Merges the groups of i and j in place; label[x] is the least index of x's group."""
    changed = False
    while True:
        a, b = label[i], label[j]
        if not (apart := a != b).any():
            return changed
        changed, i, j = True, i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := label[label], label):
            label[:] = up


def trie_forest(v: np.ndarray, nodes: np.ndarray, chunk: int = 100_000) -> np.ndarray:
    """Groups of linked values. v: rotated fingerprints, sorted within each node; nodes: rows (a0, a1, b0, b1, differing
    bits, depth), half-open ranges of v that share their first depth bits; a0 == b0: the node with itself. Returns for each
    index of v the least index that it is linked to."""
    label = np.arange(len(v))
    zeros = {}
    stack = [nodes]
    while stack:
        todo = stack.pop()
        if len(todo) > chunk:
            stack += [todo[chunk:], todo[:chunk]]
            continue
        depth = todo[:, 5]
        if (depth != depth[0]).any():
            stack += [todo[depth == d] for d in np.unique(depth)]
            continue
        a0, a1, b0, b1, d, depth = *todo.T[:5], int(depth[0])
        # node pairs that are one group already need no visit: nothing new can link
        edge = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, len(v))
        ends = edge[np.searchsorted(edge, np.stack([a0, b0]), side="right")]
        fresh = ~((ends[0] >= a1) & (ends[1] >= b1) & (label[a0] == label[b0]))
        a0, a1, b0, b1, d = a0[fresh], a1[fresh], b0[fresh], b1[fresh], d[fresh]
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[leaf], b0[leaf]
        near = np.bitwise_count(v[i] ^ v[j]) <= BUDGET
        _link(label, i[near], j[near])
        a0, a1, b0, b1, d = a0[~leaf], a1[~leaf], b0[~leaf], b1[~leaf], d[~leaf]
        if not len(a0) or depth == BITS:
            continue
        if depth not in zeros:
            zeros[depth] = np.concatenate([[0], np.cumsum(((v >> np.uint64(BITS - 1 - depth)) & np.uint64(1)) == 0)])
        z = zeros[depth]
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        own = a0 == b0
        cross = ~own
        children = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), (am[cross], a1[cross], b0[cross], bm[cross], d[cross] + 1)]
        below = np.concatenate([np.stack(x, 1) for x in children])
        a0, a1, b0, b1, d = below.T
        below = below[(a1 > a0) & (b1 > b0) & (d <= BUDGET) & ((a0 != b0) | (a1 - a0 > 1))]
        if len(below):
            stack.append(np.column_stack([below, np.full(len(below), depth + 1)]))
    return label


Blocks = tuple[tuple[int, int], ...]  # (bits below the block, bits of the block), the leading one first


def tries(count: int, split_rows: int = SPLIT_ROWS) -> list[tuple[Blocks, int]]:
    """Of each trie the order of the blocks, and the number of leading bits; subtrees of so many fingerprints are a quarter of split_rows or less on the mean."""
    for k in (4, 5, 6):
        edges = [BITS * i // k for i in range(k + 1)]
        blocks = [(BITS - b, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        chosen = list(combinations(blocks, k - BUDGET))
        least = min(sum(n for _, n in c) for c in chosen)
        if k == 6 or 4 * count <= split_rows << least:
            return [((*c, *(x for x in blocks if x not in c)), sum(n for _, n in c)) for c in chosen]


def _turned(fp: Column, order: Blocks) -> Column:
    out, at = None, BITS
    for low, n in order:
        at -= n
        part = F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND((1 << n) - 1), at)
        out = part if out is None else out.bitwiseOR(part)
    return out


def _turned_back(v: np.ndarray, order: Blocks) -> np.ndarray:
    out, at = np.zeros(len(v), np.uint64), BITS
    for low, n in order:
        at -= n
        out |= ((v >> np.uint64(at)) & np.uint64((1 << n) - 1)) << np.uint64(low)
    return out


def _subtrees(orders: list[Blocks]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (trie, v, depth, a, b, d) of a partition: the node pairs (a, b), with d differing bits, that it holds."""
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not held:
            return
        trie, v, depth, a, b, d = (np.concatenate(c) for c in zip(*held))
        v = v.view(np.uint64)
        order = np.lexsort((v, b, a, depth, trie))
        trie, v, depth, a, b, d = trie[order], v[order], depth[order], a[order], b[order], d[order]
        lo = np.flatnonzero(np.append(True, (trie[1:] != trie[:-1]) | (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        hi = np.append(lo[1:], len(v))
        first = np.append(0, np.cumsum((v >> (BITS - depth).astype(np.uint64)).view(np.int64) == a))
        own = a[lo] == b[lo]
        mid = lo + first[hi] - first[lo]  # of two nodes the values of the lesser come first
        nodes = np.stack([lo, np.where(own, hi, mid), np.where(own, lo, mid), hi, d[lo], depth[lo]], 1).astype(np.int64)
        a0, a1, b0, b1 = nodes.T[:4]
        nodes = nodes[(a1 > a0) & (b1 > b0) & ((a0 != b0) | (a1 - a0 > 1))]
        if not len(nodes):
            return
        label = trie_forest(v, nodes)
        i = np.flatnonzero(label != np.arange(len(v)))
        for t, blocks in enumerate(orders):
            at = i[trie[i] == t]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(_turned_back(x, blocks).view(np.int64)) for x in (v[at], v[label[at]])], ["u", "v"])

    return run


def links(distinct: DataFrame, split_rows: int = SPLIT_ROWS, chosen: list[tuple[Blocks, int]] | None = None) -> DataFrame:
    """u, v: a spanning forest of the links among the distinct fingerprints (column fp)."""
    chosen = chosen or tries(distinct.count(), split_rows)
    prefix = lambda depth: F.expr(f"shiftrightunsigned(v, {BITS} - {depth})")
    rows = distinct.select(F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), _turned(F.col("fp"), order).alias("v"), F.lit(lead).alias("depth")) for t, (order, lead) in enumerate(chosen)])).alias("x")).select("x.*")
    rows = rows.withColumn("a", prefix("depth")).withColumn("b", F.col("a")).withColumn("d", F.lit(0))
    node = ["trie", "depth", "a", "b"]
    while True:
        counts = rows.groupBy(*node).agg(F.count("*").alias("n"))
        dense = (F.col("n") > split_rows) & (F.col("depth") <= BITS - 2 * SUB)  # further down a pair holds a few values only
        total, splits = counts.agg(F.sum("n"), F.count_if(dense)).first()
        if not splits:
            break
        rows = written(_split(rows, counts.filter(dense).select(*node, F.lit(True).alias("dense")), node), "nodes")
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TASK_ROWS))
    return rows.repartition(tasks, *node).select("trie", "v", "depth", "a", "b", "d").mapInArrow(_subtrees([order for order, _ in chosen]), "u long, v long")


def _split(rows: DataFrame, dense: DataFrame, node: list[str]) -> DataFrame:
    """The rows, those of dense node pairs in pairs of nodes SUB bits further down: each with the nodes on the other side within the budget."""
    marked = rows.join(dense, node, "left")
    prefix = lambda depth: F.expr(f"shiftrightunsigned(v, {BITS} - {depth})")
    other = F.when(prefix("depth") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    below = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << SUB) - 1).cast("long")))
    wide = marked.filter("dense").select("trie", "v", (F.col("depth") + SUB).alias("depth"), "d", prefix(f"depth - {SUB}").alias("own"), F.shiftleft(other, SUB).alias("other"), below.alias("t"))
    node = F.col("other") + F.col("t")
    d = F.col("d") + F.bit_count(node.bitwiseXOR(F.col("own")).bitwiseAND((1 << SUB) - 1))
    wide = wide.filter(d <= BUDGET).select("trie", "v", "depth", F.least("own", node).alias("a"), F.greatest("own", node).alias("b"), d.alias("d"))
    return marked.filter("dense is null").select("trie", "v", "depth", "a", "b", "d").unionByName(wide)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least value reachable) of every node of the undirected edges (u, v): alternating large and small stars."""
    spark = edges.sparkSession
    read = lambda at: spark.read.schema("u long, v long").parquet(at)
    path = written_at(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    edges, state = read(path), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        before, path = path, written_at(small, "stars")
        delete(spark, before)  # the next round reads only this one's table
        edges = read(path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _classes(fps: DataFrame, split_rows: int) -> DataFrame:
    """fp, component_id of every distinct fingerprint."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, split_rows)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id of every row."""
    fps = written(fingerprints(docs), "fingerprints")
    return fps.join(_classes(fps, split_rows).drop("root"), "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """One row of each group, columns as they were: that of the least id, then of the least hash of its text, then the first. Rows without an
    id come after those with one."""
    names, doc_id, text = docs.columns, place_of(docs, "doc_id"), place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint((t.as_py() or "").encode()) for t in batch.column(names.index("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, "fp"])

    rows = positional(docs)
    marked = rows.mapInArrow(run, StructType([*rows.schema, StructField("fp", LongType())])).withColumn("row", F.monotonically_increasing_id())
    marked = written(marked, "fingerprinted")  # from here on a row's number stands fast
    fps = marked.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), "fp", "row")
    first = fps.join(_classes(fps, split_rows), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row")).alias("least"))
    return marked.join(first.select(F.col("least.row").alias("row")), "row", "left_semi").drop("fp", "row").toDF(*names)

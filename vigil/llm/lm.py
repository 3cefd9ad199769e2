"""Language-model scores: a causal self-attention model over subword ids, and a word unigram baseline.

Subwords are those of a public byte-level vocabulary cut to its first SUBWORDS entries (a merge of a byte-pair vocabulary never
needs a later one). Corpus statistics cover every training document: counts of words, exchanged in packed form
(see exchange), and of subword pairs, whose size the vocabulary bounds. From the pair counts follow P(subword | class,
subword before) and a prior P(class | subword before); self-attention over the context corrects the prior. Its
weights are fitted on every window of every training document: in rounds that take disjoint and growing shares of the documents, each
task runs Adam in numpy over its part from the round's weights, and the tasks' weights are averaged by their windows. Where all windows make fewer than FIT_STEPS steps, they are gone
over again, up to 30 times.

Scoring: the subwords of a text are cut into windows of WINDOW with CONTEXT overlapping ones; each subword is scored once, with a
causal mask, many windows at a time. A word's probability by attention, that its subwords come and that the word then ends, is mixed
with its share of all words of the training documents, whose table grows with them. The score is log10 P(text, end).

Defined cases: null text counts as empty (its end is scored alone); null and repeated ids are kept, row by row; with no
training document all counts are zero and the pair model is uniform; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Out, held_out, mix, parts_for, rows_of, text_bytes, written
from vigil.llm.exchange import HELD, PACKED, bucket_of, buckets_of, packed, unique_counts
from vigil.llm.packing import _byte_alphabet

SUBWORDS, CLASSES, WIDTH, HIDDEN, WINDOW, CONTEXT = 1024, 32, 16, 32, 40, 8
END, BEGIN = SUBWORDS, SUBWORDS + 1
FIT_STEPS, FIT_BATCH, FIT_HELD, FIT_TASK = 900, 96, 3072, 1 << 17
#: Of each round of the fit: the end of its share of the documents, in 64ths, and the rates it starts and ends with.
FIT_ROUNDS = ((1, 0.01, 0.01), (4, 0.01, 0.01), (16, 0.01, 0.008), (64, 0.008, 0.001))
#: The weight of attention in the mixture.
MIXED = 0.8
_END_WORD = np.uint64(0x5851F42D4C957F2D)


@cache
def subwords(path: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)["model"]["vocab"]
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in w): i for w, i in held.items() if i < SUBWORDS}
    return tiktoken.Encoding("cut", pat_str=" ?[^ ]+| ", mergeable_ranks=ranks, special_tokens={})


def encode(text: bytes, path: str) -> np.ndarray:
    """The subwords of the lower-case words, each with a blank before it."""
    words = b" ".join(text.lower().split())
    return np.frombuffer(array("H", subwords(path).encode_ordinary(" " + words.decode()) if words else ()), np.uint16)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary())]))
        for doc_id, text, held in rows_of(batches):
            ids = encode(text, path).tobytes()
            yield from out.add((doc_id, held, ids), len(ids) + 32)
        yield from out.flush()

    return text_bytes(docs).withColumn("held_out", held_out(1)).mapInArrow(run, "doc_id long, held_out boolean, ids binary")


@cache
def _word_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each subword: does it begin a word (it then begins with the blank), and a 64-bit value."""
    cut = subwords(path)
    begins = np.array([cut.decode_single_token_bytes(i)[:1] == b" " for i in range(SUBWORDS)])
    return begins, np.random.default_rng(29).integers(0, 1 << 64, SUBWORDS, np.uint64)


def _tokens(ids: np.ndarray, path: str) -> np.ndarray:
    """Hashes of the words that the subwords spell, then of the end. A word has one sequence of subwords; its hash is the sum of
    its subwords' values, each times a value of the place in the word."""
    return _tokens_of([ids], path)[0]


def _tokens_of(texts: list[np.ndarray], path: str) -> tuple[np.ndarray, np.ndarray]:
    """_tokens() of texts, one after the other, and how many each has."""
    ids = np.concatenate(texts)
    begins, value = _word_tables(path)
    at = np.flatnonzero(begins[ids])
    words = np.searchsorted(at, np.cumsum([len(t) for t in texts]))
    ends = words + np.arange(len(texts))
    out = np.full(len(at) + len(texts), _END_WORD)
    if len(at):
        place = np.arange(len(ids)) - np.repeat(at, np.diff(at, append=len(ids)))
        factor = mix(mix(np.arange(1, place.max() + 2, dtype=np.uint64))) | np.uint64(1)
        spelt = np.ones(len(out), bool)
        spelt[ends] = False
        out[spelt] = mix(np.add.reduceat(value[ids] * factor[place], at))
    return out, np.diff(ends, prepend=-1)


def _together(rows: Iterator[tuple], ids: int, size: int = 1 << 18) -> Iterator[list[tuple]]:
    """The rows in lists of at most 64, which end once they hold so many bytes in the column ids."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[ids])
        if n >= size or len(held) == 64:
            yield held
            held, n = [], 0
    if held:
        yield held


def _places_in(keys: np.ndarray):
    """h -> np.searchsorted(keys, h), for sorted hashes: the leading bits of one nearly say its place, and a few steps lead there."""
    bits = max(1, min(24, len(keys).bit_length() + 1))
    first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    keys = np.append(keys, np.uint64(2**64 - 1))

    def places(h: np.ndarray) -> np.ndarray:
        at = first[(h >> np.uint64(64 - bits)).astype(np.int64)]
        behind = np.flatnonzero(keys[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[keys[at[behind]] < h[behind]]
        return at

    return places


def _word_counts(path: str, parts: int):
    """(held_out, ids, b) -> packed word hashes with their counts in training documents."""

    def send(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        found = [unique_counts(np.concatenate([x[0] for x in pieces]), np.concatenate([np.full(len(x[0]), x[1], np.int64) for x in pieces])) for pieces in held.values()]
        if found:
            keys = np.concatenate([f[0] for f in found])
            bucket = np.repeat(np.array(list(held), np.int32), [len(f[0]) for f in found])
            part = ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
            yield from packed(part, bucket, keys.view(np.uint8).reshape(-1, 8), np.concatenate([f[1] for f in found]).astype("<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = 0
        for some in _together(rows_of(batches), 1):
            keys, lengths = _tokens_of([np.frombuffer(ids, np.uint16) for _, ids, _ in some], path)
            for (out_of_it, _, b), k in zip(some, np.split(keys, np.cumsum(lengths)[:-1]), strict=True):
                held.setdefault(b, []).append((k, int(not out_of_it)))
            n += len(keys)
            if n >= HELD:
                yield from send(held)
                held, n = {}, 0
        yield from send(held)

    return run


def _totals(t: pa.Table) -> pa.Table:
    """One hash partition: to each bucket the training counts of its words; to bucket -1 how many words and tokens there are."""
    keys = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in t["keys"]])
    counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in t["counts"]]).astype(np.int64)
    bucket = buckets_of(t)
    words, total = unique_counts(keys, counts)
    c = total[np.searchsorted(words, keys)]
    known = c > 0
    order = np.lexsort((keys[known], bucket[known]))
    keys, c, bucket = keys[known][order], c[known][order], bucket[known][order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, c, bucket = keys[new], c[new], bucket[new]
    rows = [{"b": -1, "keys": np.array([(total > 0).sum(), total.sum()], "<i8").tobytes(), "counts": b""}]
    at = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(keys)] if len(keys) else []
    rows += [{"b": int(bucket[i]), "keys": keys[i:j].tobytes(), "counts": c[i:j].astype("<i8").tobytes()} for i, j in zip(at, at[1:])]
    return pa.Table.from_pylist(rows, schema=pa.schema([("b", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training ids -> per task, counts of (subword before, subword), one row per subword before."""
    side = SUBWORDS + 2
    table = np.zeros(side * side, np.int64)
    held, size = [], 0

    def add() -> None:
        before = np.concatenate([x for ids in held for x in ([BEGIN], ids)]).astype(np.int64)
        after = np.concatenate([x for ids in held for x in (ids, [END])]).astype(np.int64)
        np.add(table, np.bincount(before * side + after, minlength=side * side), out=table)

    for (ids,) in rows_of(batches):
        held.append(np.frombuffer(ids, np.uint16))
        size += len(ids)
        if size >= 1 << 20:
            add()
            held, size = [], 0
    if held:
        add()
    table = table.reshape(side, side)
    at = np.flatnonzero(table.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([table[i].tobytes() for i in at], pa.binary())], ["before", "counts"])


def _sum_rows(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in t["counts"])
    return pa.table({"before": t["before"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def pair_table(train: DataFrame) -> np.ndarray:
    """Counts of (before, subword) over all training documents; the vocabulary bounds what comes here."""
    side = SUBWORDS + 2
    table = np.zeros((side, side), np.int64)
    for r in train.select("ids").mapInArrow(_pair_counts, "before int, counts binary").groupBy("before").applyInArrow(_sum_rows, "before int, counts binary").collect():
        table[r.before] = np.frombuffer(r.counts, np.int64)
    return table


def classes_of(pairs: np.ndarray) -> np.ndarray:
    """Classes of subwords that follow alike: k-means, with fixed seeds, on the leading directions of what stands before them."""
    m = np.sqrt(pairs[:, : END + 1].T.astype(np.float64))
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    _, vectors = np.linalg.eigh(m.T @ m)
    x = m @ vectors[:, -12:]
    weight = pairs[:, : END + 1].sum(0)
    centre = x[np.argsort(-weight, kind="stable")[:CLASSES]]
    for _ in range(15):
        of = ((x[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for k in range(CLASSES):
            if (of == k).any():
                centre[k] = x[of == k].mean(0)
    return of


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | np.float32]:
    """exp(z - top), its sums over the last axis, and top: zero, or where an exponential would overflow or a sum vanish, each row's maximum."""
    one = np.ones(z.shape[-1], np.float32)
    if z.size and z.max() < 80:
        e = np.exp(z)
        total = (e.reshape(-1, len(one)) @ one).reshape(z.shape[:-1])
        if total.min() > 1e-25:
            return e, total, np.float32(0)
    top = z.max(-1)
    e = np.exp(z - top[..., None])
    return e, e @ one, top


def _blocks(n: int) -> int:
    """Into how many equal blocks n windows go: BLAS multiplies blocks of a few hundred rows by narrow matrices faster than all rows at once."""
    return n // next(k for k in range(12, 0, -1) if n % k == 0) if n else 1


def _times(a: np.ndarray, b: np.ndarray, blocks: int) -> np.ndarray:
    """a @ b for many rows of a."""
    return (a.reshape(blocks, -1, a.shape[1]) @ np.ascontiguousarray(b)).reshape(len(a), -1)


def _over(a: np.ndarray, b: np.ndarray, blocks: int) -> np.ndarray:
    """a.T @ b for many rows of both."""
    return (a.reshape(blocks, -1, a.shape[1]).transpose(0, 2, 1) @ b.reshape(blocks, -1, b.shape[1])).sum(0)


class Model:
    def __init__(self, pairs: np.ndarray, seed: int = 11):
        rnd, d = np.random.default_rng(seed), WIDTH
        n = pairs[:, : END + 1].astype(np.float64)
        self.of = of = classes_of(pairs)
        member = np.zeros((END + 1, CLASSES))
        member[np.arange(END + 1), of] = 1
        one = n.sum(0) + 0.1
        within = one / (one @ member)[of]
        by_class = n @ member
        self.subword = np.log((n + 2.0 * within) / (by_class[:, of] + 2.0)).astype(np.float32)
        size = np.maximum(member.sum(0), 0)
        prior = (one @ member + 1e-6 * (size > 0)) / one.sum()
        with np.errstate(divide="ignore"):
            self.prior = np.maximum(np.log((by_class + 5.0 * prior) / (by_class.sum(1, keepdims=True) + 5.0)), -30).astype(np.float32)
        g = lambda *s, scale: rnd.normal(0, scale, s).astype(np.float32)
        self.w = {"e": g(SUBWORDS + 2, d, scale=0.3), "p": g(WINDOW, d, scale=0.1), "q": g(d, d, scale=0.25), "k": g(d, d, scale=0.25), "v": g(d, d, scale=0.25), "h": g(2 * d, HIDDEN, scale=0.2), "hb": np.zeros(HIDDEN, np.float32), "o": np.zeros((HIDDEN, CLASSES), np.float32), "ob": np.zeros(CLASSES, np.float32)}
        keys, queries = np.arange(WINDOW)[None, :], np.arange(CONTEXT, WINDOW)[:, None]
        self.mask = np.where(keys <= queries, 0, -1e9).astype(np.float32)

    def forward(self, x: np.ndarray) -> dict:
        """x: windows of subwords [n, WINDOW]; z, the class logits after each of the last WINDOW - CONTEXT, and total, the logarithm of their exponentials' sum."""
        w, c = self.w, {}
        c["x"] = w["e"][x] + w["p"]
        xq = c["x"][:, CONTEXT:]
        c["q"], c["k"], c["v"] = xq @ w["q"], c["x"] @ w["k"], c["x"] @ w["v"]
        s = c["q"] @ c["k"].transpose(0, 2, 1)
        s *= 1 / np.sqrt(WIDTH)
        s += self.mask
        s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(2, keepdims=True)
        c["a"] = s
        c["in"] = np.concatenate([xq, s @ c["v"]], 2)
        c["hid"] = np.maximum(c["in"] @ w["h"] + w["hb"], 0)
        z = c["hid"] @ w["o"] + w["ob"] + self.prior[x[:, CONTEXT:]]
        c["z"] = z
        c["total"] = np.log(np.exp(z - (top := z.max(2, keepdims=True))).sum(2, keepdims=True)) + top
        return c

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability of the classes of y where real. forward() again, with fewer passes over large arrays."""
        w, g, n, d, before = self.w, {}, len(x), WIDTH, x[:, CONTEXT:].ravel()
        root, cut = np.float32(np.sqrt(d)), _blocks(n)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        turned = lambda t: t.transpose(0, 2, 1)
        xe = np.take(w["e"], x, 0)
        xe += w["p"]
        both = np.concatenate([w["k"], w["v"]], 1)
        kv = _times(flat(xe), both, cut).reshape(n, -1, 2 * d)
        k, v = kv[..., :d], kv[..., d:]
        wide = np.empty((n, x.shape[1] - CONTEXT, 2 * d), np.float32)  # what the hidden layer gets
        wide[..., :d] = xe[:, CONTEXT:]
        fin = flat(wide)
        q = wide[..., :d] @ (w["q"] / root)
        s = q @ turned(k)
        s += self.mask
        a, total, _ = _exponentials(s)
        a *= (1 / total)[..., None]
        seen = np.matmul(a, v, out=wide[..., d:])
        hid = _times(fin, w["h"], cut)
        hid += w["hb"]
        np.maximum(hid, 0, out=hid)
        z = _times(hid, w["o"], cut)
        z += np.take(self.prior + w["ob"], before, 0)
        dz, total, _ = _exponentials(z)
        share = (real.ravel() / max(real.sum(), 1)).astype(np.float32)
        dz *= (share / total)[:, None]
        dz.ravel()[np.arange(0, dz.size, CLASSES) + self.of[y].ravel()] -= share
        one = np.ones(len(dz), np.float32)
        g["o"], g["ob"] = _over(hid, dz, cut), one @ dz
        dh = _times(dz, w["o"].T, cut)
        dh *= hid > 0
        g["h"], g["hb"] = _over(fin, dh, cut), one @ dh
        da = _times(dh, w["h"][d:].T, cut).reshape(n, -1, d)
        ds = da @ turned(v)
        ds -= np.einsum("nij,nij->ni", da, seen)[..., None]
        ds *= a
        dq = flat(ds @ k)
        dkv = np.empty_like(kv)
        np.matmul(turned(ds), q, out=dkv[..., :d])
        np.matmul(turned(a), da, out=dkv[..., d:])
        g["q"], gkv = _over(fin[:, :d], dq, cut) / root, _over(flat(xe), flat(dkv), cut)
        g["k"], g["v"] = gkv[:, :d], gkv[:, d:]
        dx = _times(flat(dkv), both.T, cut).reshape(xe.shape)
        dxq = _times(dh, w["h"][:d].T, cut)
        dxq += _times(dq, (w["q"] / root).T, cut)
        dx[:, CONTEXT:] += dxq.reshape(n, -1, d)
        g["p"] = dx.sum(0)
        g["e"] = np.zeros_like(w["e"])
        order = np.argsort(x.astype(np.uint16), axis=None, kind="stable")  # 16 bits are sorted by radix
        of = x.ravel()[order]
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        g["e"][of[at]] = np.add.reduceat(np.take(flat(dx), order, 0), at, 0)
        return g

    def start(self) -> dict[str, np.ndarray]:
        """What the fit carries: the weights, and Adam's means of gradients (m_) and of their squares (s_)."""
        return {**self.w, **{f"{t}_{k}": np.zeros_like(v) for t in "ms" for k, v in self.w.items()}, "steps": np.zeros(1, np.float32)}

    def learn(self, state: dict[str, np.ndarray], texts: Iterator[np.ndarray], passes: int, rates: tuple[float, float], steps: float) -> tuple[dict[str, np.ndarray], int]:
        """The state after Adam over all windows of the texts, FIT_HELD windows at a time in mixed order, each `passes` times, and the
        number of windows. The rate falls from the first to the second of rates over so many steps."""
        cuts, at = {}, 0
        for k, v in self.w.items():
            cuts[k], at = slice(at, at + v.size), at + v.size
        flat = {t: np.concatenate([state[t + k].ravel() for k in cuts]) for t in ("", "m_", "s_")}  # one step for all weights
        state = {t + k: flat[t][c].reshape(self.w[k].shape) for t in flat for k, c in cuts.items()} | {"steps": state["steps"].copy()}
        self.w = {k: state[k] for k in cuts}
        rnd, n, done, held, size = np.random.default_rng(5), 0, 0, [], 0

        def step(x: np.ndarray, y: np.ndarray, real: np.ndarray) -> None:
            nonlocal done
            done += 1
            state["steps"] += 1
            t = float(state["steps"][0])
            rate = (rates[0] + (rates[1] - rates[0]) * min(1, done / steps)) * min(1, t / 20)
            found = self.gradients(x, y, real)
            g, m, s = np.concatenate([found[k].ravel() for k in cuts]), flat["m_"], flat["s_"]
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.01) * (g * g - s)
            flat[""] -= np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(s * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-8))

        def flush() -> None:
            x, y, real = windows_of(*held)
            for _ in range(passes):
                for at in np.array_split(rnd.permutation(len(x)), -(-len(x) // FIT_BATCH)):
                    step(x[at], y[at], real[at])

        for ids in texts:
            held.append(ids)
            n, size = n + (more := windows_in(ids)), size + more
            if size >= FIT_HELD:
                flush()
                held, size = [], 0
        if held:
            flush()
        return state, n

    def tables(self, begins: np.ndarray) -> dict[str, np.ndarray]:
        """What the first products come to for each subword and for each place: with them scoring needs no product over single
        subwords but that of the attended values with the hidden layer."""
        w = self.w
        key = np.concatenate([w["k"], w["v"]], 1)
        query = np.concatenate([w["q"] / np.float32(np.sqrt(WIDTH)), w["h"][:WIDTH]], 1)
        place = w["p"][CONTEXT:] @ query
        place[:, WIDTH:] += w["hb"]
        member = np.zeros((END + 1, CLASSES), np.float32)
        member[np.flatnonzero(begins), self.of[begins]] = 1
        return {"boundary": np.exp(self.subword) @ member, "key": w["e"] @ key, "key_place": w["p"] @ key, "query": w["e"] @ query, "query_place": place, "prior": self.prior + w["ob"]}

    def _chunk(self, t: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln P of the targets y [n, WINDOW - CONTEXT] of the windows x, and that a word begins or the text ends there: forward(), by tables()."""
        n, step = y.shape
        cut = _blocks(n)
        before = x[:, CONTEXT:]
        key = np.take(t["key"], x, 0)
        key += t["key_place"]
        query = np.take(t["query"], before, 0)
        query += t["query_place"]
        s = query[..., :WIDTH] @ key[..., :WIDTH].transpose(0, 2, 1)
        s += self.mask
        e, total, _ = _exponentials(s)
        seen = (e @ key[..., WIDTH:]).reshape(-1, WIDTH)
        seen /= total.reshape(-1, 1)
        hid = _times(seen, self.w["h"][WIDTH:], cut)
        hid += query[..., WIDTH:].reshape(-1, HIDDEN)
        np.maximum(hid, 0, out=hid)
        z = _times(hid, self.w["o"], cut)
        z += np.take(t["prior"], before.ravel(), 0)
        own = z[np.arange(len(z)), self.of[y].ravel()]
        e, total, top = _exponentials(z)
        log_total = np.log(total)
        boundary = np.einsum("ij,ij->i", e, np.take(t["boundary"], before.ravel(), 0))
        boundary = np.log(np.maximum(boundary, np.float32(1e-30))) - log_total
        return (own - log_total - top + self.subword[before.ravel(), y.ravel()]).reshape(n, step), np.minimum(boundary, 0).reshape(n, step)

    def log_probabilities(self, texts: list[np.ndarray], chunk: int = 96) -> list[np.ndarray]:
        """ln P of each subword and of the end, given all before it in its window."""
        return np.split(self._scores(texts, self.tables(np.zeros(END + 1, bool)), chunk)[0], np.cumsum([len(t) + 1 for t in texts])[:-1])

    def with_boundaries(self, texts: list[np.ndarray], path: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """log_probabilities(), and ln P that a word begins or the text ends there."""
        cuts = np.cumsum([len(t) + 1 for t in texts])[:-1]
        return list(zip(*(np.split(c, cuts) for c in self._scores(texts, self.tables(np.append(_word_tables(path)[0], True)))), strict=True))

    def _scores(self, texts: list[np.ndarray], t: dict[str, np.ndarray], chunk: int = 96) -> tuple[np.ndarray, np.ndarray]:
        """Both of with_boundaries(), texts one after the other; t: of tables()."""
        x, y, real = windows_of(*texts)
        out, ends = np.empty(y.shape, np.float32), np.empty(y.shape, np.float32)
        for i in range(0, len(x), chunk):
            out[i : i + chunk], ends[i : i + chunk] = self._chunk(t, x[i : i + chunk], y[i : i + chunk])
        return out[real], ends[real]


def mixed(ids: np.ndarray, own: np.ndarray, ends: np.ndarray, counts: np.ndarray, tokens: int, path: str) -> float:
    """log10 P(text, end) by words: MIXED times a word's probability by attention, and for the rest its count over all tokens. own and
    ends: of with_boundaries(); counts: of each word and of the end. Both parts sum to one over words and the end, given what is before."""
    return float(mixed_of([ids], own, ends, counts, tokens, path)[0])


def mixed_of(texts: list[np.ndarray], own: np.ndarray, ends: np.ndarray, counts: np.ndarray, tokens: int, path: str) -> np.ndarray:
    """mixed() of texts; own, ends and counts of one after the other."""
    sizes = np.array([len(t) + 1 for t in texts])
    last = np.cumsum(sizes) - 1
    begins = np.zeros(len(own), bool)
    begins[last] = True
    spelt = ~begins
    begins[spelt] = _word_tables(path)[0][np.concatenate(texts)]
    at = np.flatnonzero(begins)
    word = np.add.reduceat(own.astype(np.float64), at) - ends[at]
    inside = spelt[at]
    word[inside] += ends[at[1:]][inside[:-1]]
    first = np.searchsorted(at, last - sizes + 1)
    if tokens:
        with np.errstate(divide="ignore"):
            word = np.logaddexp(np.log(MIXED) + word, np.log(1 - MIXED) + np.log(counts) - np.log(tokens))
    return np.add.reduceat(word, first) / np.log(10)


def windows_in(ids: np.ndarray) -> int:
    return -(-(len(ids) + 1) // (WINDOW - CONTEXT))


def windows_of(*texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of inputs [n, WINDOW], their targets [n, WINDOW - CONTEXT], and which targets are real: each subword and the end once; of
    texts one after the other."""
    step = WINDOW - CONTEXT
    first = np.cumsum([0, *map(windows_in, texts)])
    n = int(first[-1])
    x, y, real = np.full((n, WINDOW), BEGIN, np.int32), np.full(n * step, END, np.int32), np.zeros(n * step, bool)
    before = np.full(n * step, BEGIN, np.int32)
    for at, ids in zip((first * step).tolist(), texts):
        before[at + 1 : at + 1 + len(ids)] = ids
        y[at : at + len(ids)] = ids
        real[at : at + len(ids) + 1] = True
    before = before.reshape(n, step)
    x[:, CONTEXT:] = before
    x[1:, :CONTEXT] = before[:-1, step - CONTEXT :]
    x[first[:-1], :CONTEXT] = BEGIN
    return x, y.reshape(n, step), real.reshape(n, step)


def _mean(rows: Iterator[tuple[int, int, bytes]]) -> tuple[int, np.ndarray]:
    """Windows, and the mean of states by their windows; rows: task, windows, state."""
    total, state = 0, np.zeros(1)
    for _, n, raw in sorted(rows):
        total, state = total + n, state + n * np.frombuffer(raw, np.float64)
    return total, state / max(total, 1)


def _mean_of(t: pa.Table) -> pa.Table:
    n, state = _mean(zip(*(t[c].to_pylist() for c in ("task", "n", "state")), strict=True))
    return pa.table({"task": [min(t["task"].to_pylist())], "n": [n], "state": pa.array([state.tobytes()], pa.binary())}, schema=pa.schema([("task", pa.int32()), ("n", pa.int64()), ("state", pa.binary())]))


def train(table: DataFrame, seen: list[int] | None = None) -> Model:
    """A model of the training rows of encoded(). Each of them is in one round of the fit; seen gets the rounds' numbers of windows.
    What comes here is a state for each of at most 16 groups of tasks."""
    rows, sc = table.filter("not held_out"), table.sparkSession.sparkContext
    model = Model(pairs := pair_table(rows))
    windows = max(1, int(pairs.sum()) // (WINDOW - CONTEXT))
    tasks = min(-(-windows // FIT_TASK), rows.rdd.getNumPartitions()) or 1
    passes = min(30, max(1, -(-FIT_STEPS * FIT_BATCH * tasks // windows)))  # of small tables; large ones are gone through once
    state, schema = model.start(), "task int, n long, state binary"
    shapes = [(k, v.shape, v.size) for k, v in state.items()]
    first = 0
    for last, *rates in FIT_ROUNDS:
        sent = sc.broadcast((model, state))
        steps = max(1.0, windows * (last - first) / 64 / tasks * passes / FIT_BATCH)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rates=tuple(rates), steps=steps) -> Iterator[pa.RecordBatch]:
            got, n = sent.value[0].learn(sent.value[1], (np.frombuffer(ids, np.uint16) for (ids,) in rows_of(batches)), passes, rates, steps)
            if n:
                raw = np.concatenate([got[k].ravel() for k, _, _ in shapes]).astype(np.float64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([raw], pa.binary())], ["task", "n", "state"])

        share = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(64))
        found = rows.filter((share >= first) & (share < last)).select("ids").coalesce(tasks).mapInArrow(run, schema)
        n, mean = _mean((r.task, r.n, r.state) for r in found.groupBy(F.pmod("task", F.lit(16))).applyInArrow(_mean_of, schema).collect())
        if n:
            cuts = np.split(mean.astype(np.float32), np.cumsum([size for _, _, size in shapes])[:-1])
            state = {k: c.reshape(shape) for (k, shape, _), c in zip(shapes, cuts, strict=True)}
        if seen is not None:
            seen.append(n)
        first = last
    model.w = {k: state[k] for k in model.w}
    return model


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    parts = parts_for(docs.select("text"))
    table = written(encoded(docs, path), "subwords").withColumn("b", bucket_of(parts, "doc_id", "ids"))
    counts = written(table.select("held_out", "ids", "b").mapInArrow(_word_counts(path, parts), PACKED).groupBy("p").applyInArrow(_totals, "b int, keys binary, counts binary"), "words")
    distinct = tokens = 0
    for r in counts.filter("b = -1").select("keys").collect():  # one row per hash partition
        d, t = np.frombuffer(r["keys"], "<i8")
        distinct, tokens = distinct + int(d), tokens + int(t)
    model = train(table)
    sent = spark.sparkContext.broadcast((model, model.tables(np.append(_word_tables(path)[0], True))))  # its size follows from the vocabulary

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        model, ready = sent.value
        keys = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in words["keys"]] or [np.zeros(0, np.uint64)])
        found = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in words["counts"]] or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        keys, found = np.append(keys[order], np.uint64(0)), np.append(found[order], 0)
        places, out = _places_in(keys[:-1]), []
        for some in _together(rows_of(docs.select(["doc_id", "held_out", "ids"]).to_batches()), 2):
            doc, held, raw = zip(*some, strict=True)
            ids = [np.frombuffer(x, np.uint16) for x in raw]
            h, lengths = _tokens_of(ids, path)
            place = places(h)
            c = np.where(keys[place] == h, found[place], 0)
            sums = lambda x, first=np.cumsum(lengths) - lengths: np.add.reduceat(x, first)
            base = sums(np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1))))
            score = mixed_of(ids, *model._scores(ids, ready), c, tokens, path)
            columns = doc, held, lengths, sums((c > 0).astype(np.int64)), np.full(len(ids), tokens), base, score
            out.append(pa.table([pa.array(x, t.type) for x, t in zip(columns, RESULT, strict=True)], schema=RESULT))
        return pa.concat_tables(out) if out else RESULT.empty_table()

    return table.groupBy("b").cogroup(counts.filter("b >= 0").groupBy("b")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Language identification: averaged embeddings of hashed subwords, a linear softmax, stochastic gradient descent in numpy, calibrated rejection.

A text's subwords are the runs of one to four lower-case letters of its words, with the word's edges as letters of their own, whole text, hashed into BUCKETS. The mean of their
embeddings goes through a linear layer and a softmax over the languages. Both are learned together from texts and from pieces of texts (so that short texts are met in
training), document by document. A text is read a slice at a time, so that one of any length takes the memory of a slice. A part of the sample that isn't trained on calibrates: the logits' slope and how it grows with the number of subwords are fitted, so that a score is
the chance of being right, and the least score is found down to which at most MISSES of the answers are wrong; below it an answer is marked as rejected.

What is learned comes from a bounded sample: about SAMPLE texts of each language (chosen by the hash of language and text at a rate of SAMPLE over the language's rows; copies count once), of each
the whole and at most PIECES pieces spread over all of it; of the LANGUAGES of most rows. Only text and lang of rows whose crc32(doc_id as text) mod 3 isn't 1 are learned from. Scoring covers whole texts.

Defined cases: null text and a text without letters have language `und` and score 0; null lang isn't learned from, an empty one is a language like any other; where nothing can be learned
every text is `und`; of one language only, every text with letters has it; null and repeated ids are scored row by row; an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Out, mix, rows_of

BUCKETS, WIDTH, LONGEST = 1 << 15, 16, 4
SAMPLE, PIECES, LANGUAGES, EPOCHS, RATE, MISSES = 1200, 8, 1000, 3, 0.5, 0.01
#: Words of the pieces, in turn.
PIECE_WORDS = (1, 2, 4, 8, 16, 40)
UNKNOWN = "und"


def third(remainder: int) -> Column:
    """crc32 of the id as text, mod 3. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == remainder


class Letters:
    """Which code points are letters; found out as they come up."""

    def __init__(self):
        self.known = np.zeros(0x110000, np.int8)  # 1: no letter, 2: letter

    def __call__(self, points: np.ndarray) -> np.ndarray:
        kinds = self.known[points]
        if not kinds.all():
            for c in np.unique(points[kinds == 0]).tolist():
                self.known[c] = 1 + chr(c).isalpha()
            kinds = self.known[points]
        return kinds == 2


_LETTERS = Letters()


#: Characters of a text that are worked on at once.
SLICE = 1 << 20


def flats(text: str, size: int = SLICE) -> Iterator[np.ndarray]:
    """The lower-case letters of a text with 0 before, between and after its words, some at a time."""
    yield np.zeros(1, np.uint32)
    last = False  # was the last character a letter?
    for i in range(0, len(text), size):
        points = np.frombuffer(text[i : i + size].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _LETTERS(points)
        yield np.where(letter, points, 0)[letter | np.append(last, letter[:-1])]
        last = bool(letter[-1]) if len(letter) else last
    if last:
        yield np.zeros(1, np.uint32)


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The letters and edges of a whole text, and where the words begin."""
    flat = np.concatenate(list(flats(text)))
    return flat, np.flatnonzero((flat[:-1] == 0) & (flat[1:] != 0)) if len(flat) > 1 else np.zeros(0, np.int64)


def subwords(flat: np.ndarray, starts: int | None = None) -> np.ndarray:
    """The bucket of each subword (of those that begin at the first so many places); a subword holds no edge but as its first or last letter."""
    found, letters = [], flat != 0
    h, inner = np.zeros(len(flat), np.uint64), np.ones(len(flat), bool)
    for n in range(1, LONGEST + 1):
        size = min(len(flat) - n + 1, len(flat) if starts is None else starts)
        if size <= 0:
            break
        h = h[:size] * np.uint64(1_000_003) + flat[n - 1 : n - 1 + size].astype(np.uint64) + np.uint64(1)
        if n > 2:  # letters between the first and the last
            inner = inner[:size] & letters[n - 2 : n - 2 + size]
        some = inner[:size] & (letters[:size] | letters[n - 1 : n - 1 + size]) if n < 3 else inner[:size]
        found.append(mix(h[some] + np.uint64(n)) >> np.uint64(64 - BUCKETS.bit_length() + 1))
    return np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)


def totals(text: str, size: int = SLICE) -> np.ndarray:
    """How often each bucket comes up in a text of any length; the last letters of a slice wait for the next one."""
    n, held = np.zeros(BUCKETS, np.int64), np.zeros(0, np.uint32)
    for flat in flats(text, size):
        held = np.concatenate([held, flat])
        if (ready := len(held) - LONGEST + 1) >= size // 2:
            n += np.bincount(subwords(held, ready), minlength=BUCKETS)
            held = held[ready:]
    return n + np.bincount(subwords(held), minlength=BUCKETS)


def counted(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares of the text's subwords."""
    at, n = np.unique(subwords(flat), return_counts=True)
    return at.astype(np.uint16), n.astype(np.float32)


def pieces_of(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The whole text, and at most PIECES pieces of PIECE_WORDS words, spread over all of it."""
    flat, starts = words_of(text)
    if not len(starts):
        return
    yield counted(flat)
    ends = np.append(starts[1:], len(flat) - 1)
    for i in range(min(PIECES, len(starts) - 1)):
        first = i * len(starts) // PIECES if len(starts) > PIECES else i
        last = min(first + PIECE_WORDS[i % len(PIECE_WORDS)], len(starts)) - 1
        yield counted(flat[starts[first] : ends[last] + 1])


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang and text to learn from: about sample of each language, copies once."""
    rows = docs.select("text", F.col("lang").cast("string").alias("lang"), third(1).alias("held_out")).filter("lang is not null and text is not null and not held_out")
    rates = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang", (F.lit(float(sample)) / F.col("count")).alias("rate"))  # at most LANGUAGES rows
    rows = rows.withColumn("h", F.xxhash64("lang", "text"))
    chosen = rows.join(F.broadcast(rates), "lang").filter(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    return chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))


EXAMPLES = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])


def examples(sample: DataFrame) -> DataFrame:
    """lang, h and the packed counts of each text and piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(EXAMPLES)
        for lang, h, text in rows_of(batches):
            for at, n in pieces_of(text):
                yield from out.add((lang, h, at.tobytes(), n.tobytes()), 6 * len(at))
        yield from out.flush()

    return sample.select("lang", "h", "text").mapInArrow(run, "lang string, h long, at binary, n binary")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # of a bucket for each language: embeddings times the linear layer
    bias: np.ndarray
    slope: tuple[float, float]  # of the logits, and how it grows with the subwords' number
    least: float  # score from which an answer is accepted

    def logits(self, counts: np.ndarray) -> np.ndarray:
        """The linear layer over the mean embedding: each bucket's weights as often as it comes up."""
        return counts.astype(np.float32) @ self.weights / counts.sum() + self.bias

    def scale(self, n: np.ndarray | int) -> np.ndarray:
        return np.exp(self.slope[0] + self.slope[1] * np.log(n))

    def answer(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether it is rejected."""
        counts = totals(text or "")
        if not counts.any() or not self.languages:
            return UNKNOWN, 0.0, True
        z = self.logits(counts) * self.scale(counts.sum())
        best = int(z.argmax())
        score = float(1 / np.exp(z - z[best]).sum())
        return self.languages[best], score, score < self.least


Example = tuple[np.ndarray, np.ndarray, int]  # buckets, how often, language


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(embedded: np.ndarray, linear: np.ndarray, bias: np.ndarray, share: np.ndarray, language: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the loss of one text, for the embeddings of its buckets, the linear layer and the bias."""
    mean = share @ embedded
    e = softmax(mean @ linear + bias)
    e[language] -= 1
    return np.outer(share, linear @ e), np.outer(mean, e), e


def descend(found: list[Example], languages: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Bucket weights and bias, by a text at a time, languages equally often in expectation, the rate falling to nothing."""
    rnd = np.random.default_rng(seed)
    embedding = rnd.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    linear, bias = rnd.normal(0, 0.1, (WIDTH, languages)).astype(np.float32), np.zeros(languages, np.float32)
    rows = np.bincount([x[2] for x in found], minlength=languages)
    weight = np.minimum(len(found) / (np.maximum(rows, 1) * languages), 10).astype(np.float32)
    steps = EPOCHS * len(found)
    for i, k in enumerate(np.concatenate([rnd.permutation(len(found)) for _ in range(EPOCHS)])):
        at, n, language = found[k]
        share = n / n.sum()
        of_embedding, of_linear, of_bias = gradients(embedding[at], linear, bias, share, language)
        rate = np.float32(RATE * (1 - i / steps)) * weight[language]
        embedding[at] -= rate * of_embedding / np.float32((share * share).sum())  # a step of equal effect for texts of any length
        linear -= rate * of_linear * np.float32(0.1)
        bias -= rate * of_bias * np.float32(0.1)
    return embedding @ linear, bias


def calibrate(z: np.ndarray, n: np.ndarray, language: np.ndarray) -> tuple[tuple[float, float], float]:
    """The slope that makes scores the likeliest, by gradient descent, and the least score with at most MISSES wrong above it."""
    if not len(z):
        return (0.0, 0.0), 0.0
    a, b, size = 0.0, 0.0, np.log(n) - np.log(n).mean()
    for i in range(300):
        s = np.exp(np.clip(a + b * size, -6, 6))
        p = softmax(z * s[:, None])
        e = (p * z).sum(1) - z[np.arange(len(z)), language]  # the loss by the slope
        step = 0.5 * (1 - i / 300)
        a, b = a - step * np.clip((e * s).mean(), -1, 1), b - step * np.clip((e * s * size).mean(), -1, 1)
    a = float(np.clip(a, -3, 3))
    b = float(np.clip(b, -1, 1))
    p = softmax(z * np.exp(a + b * size)[:, None])
    score, wrong = p.max(1), p.argmax(1) != language
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(wrong[order]) <= MISSES * np.arange(1, len(z) + 1))
    return (float(a - b * np.log(n).mean()), b), float(score[order[good[-1]]]) if len(good) else 1.0


def fit(rows: list[tuple[str, int, np.ndarray, np.ndarray]]) -> Model:
    """rows: language, hash of the text, buckets, how often. Texts whose hash leaves 0 by 5 calibrate."""
    languages = tuple(sorted({r[0] for r in rows}))
    of = {x: i for i, x in enumerate(languages)}
    trained = [(at, n, of[x]) for x, h, at, n in rows if h % 5]
    kept = [(at, n, of[x]) for x, h, at, n in rows if h % 5 == 0]
    if len(languages) < 2 or not trained:
        return Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)), (0.0, 0.0), 0.0)
    weights, bias = descend(trained, len(languages))
    z = np.array([(n / n.sum()) @ weights[at] + bias for at, n, _ in kept]).reshape(len(kept), len(languages))
    slope, least = calibrate(z, np.array([n.sum() for _, n, _ in kept], np.float64), np.array([x for *_, x in kept], np.int64))
    return Model(languages, weights, bias, slope, least)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    rows = examples(sampled(docs, sample)).toArrow().to_pylist()  # bounded by the sample, its pieces and the buckets
    rows.sort(key=lambda r: (r["lang"], r["h"], r["at"], r["n"]))
    return fit([(r["lang"], r["h"], np.frombuffer(r["at"], np.uint16), np.frombuffer(r["n"], np.float32)) for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the chance that it is right), rejected (the score is below the calibrated least, or nothing can be said)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, answer = Out(schema), sent.value.answer
        for doc_id, held, text in rows_of(batches):
            yield from out.add((doc_id, held, *answer(text)))
        yield from out.flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), third(1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")

"""Toxicity from subword bags.

A word is the bag of its character n-grams (with word ends) and itself, hashed into buckets with an embedding each. A text is the mean of its words,
a word the mean of its bag, and a linear softmax over that mean gives the score. Embeddings and softmax are trained together in numpy on a bounded sample of
labelled rows; a word never seen in training still shares vectors with words that look like it.

As everything after the embeddings is linear, a trained model is applied as one number per bucket: a text's margin is the mean of its words'
numbers. Texts are scored whole, inside Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, mixed, packed, unpacked, word_hashes

SAMPLE_ROWS = 4096  # bound of the labelled rows a fit uses: those with the smallest hashes of their ids
BUCKETS = 1 << 15
DIM = 8
GRAMS = (3, 4, 5)
EPOCHS = 12
BATCH = 128
RATE = 0.02
DECAY = 1.0
PACKED = np.float32(256.0)  # shares travel as 16-bit numbers of so many times their size; buckets, under 65,536, as 16-bit numbers too
SCALE = np.float32(100.0)  # shares are small numbers; the softmax sees them enlarged
MIN_DOCS = 5
MIN_SHARE = 0.01  # of the sample's rows that a bucket has to be in, MIN_DOCS at least
FOLDS = 4
BETA = 1.5
SEED = 5
THRESHOLD = 0.3
CACHED_WORDS = 200_000
TOKEN = re.compile(r"\w+")


@dataclass
class Model:
    weights: np.ndarray  # per bucket: difference of the softmax's inputs that its embedding makes
    bias: float
    buckets: int = BUCKETS


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords (n-grams with word ends, and the word itself), and the number of the word each belongs to. Words of any length are cut in full."""
    line = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    edge = line == 32
    word = np.cumsum(edge) - 1  # a mark counts to the word after it
    out, of = [(word_hashes([w.encode("utf-8", "replace") for w in words]) % np.uint64(buckets)).astype(np.int64)], [np.arange(len(words))]
    for n in GRAMS:
        m = len(line) - n + 1
        if m <= 0:
            continue
        inner = edge[:m] & edge[n - 1 : n - 1 + m]  # the whole word again, or two marks of neighbours
        for i in range(1, n - 1):
            inner |= edge[i : i + m]
        at = np.flatnonzero(~inner)
        value = np.full(len(at), n, np.uint64)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + line[at + i]
        out.append((mixed(value) % np.uint64(buckets)).astype(np.int64))
        of.append(word[at])
    return np.concatenate(out), np.concatenate(of)


def bag(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares in its mean; a text without words has none."""
    words = TOKEN.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    found, of = subwords(list(counts), buckets)
    part = np.array(list(counts.values())) / len(words) / np.bincount(of)
    used, at = np.unique(found, return_inverse=True)
    return used.astype(np.int32), np.bincount(at, part[of]).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS) -> Model:
    """Embeddings and softmax by Adam on mini-batches, in a fixed order, so a fit can be repeated. Shares come enlarged by PACKED. One class only, or no row: a constant.

    Shares are weighted by the rarity of their bucket, buckets in few rows are left out. Every row of the sample counts.
    A fit's margins on its own rows say little, so the bias is moved by the margins that models of the other folds give to each row: THRESHOLD is where these are cut best (`cut_of`).
    """
    positive, n = int(labels.sum()), len(labels)
    if positive in (0, n):
        return Model(np.zeros(buckets, np.float32), float(np.log((positive + 0.5) / (n - positive + 0.5))) if n else -5.0, buckets)
    docs = np.zeros(buckets)
    for at, _ in bags:
        docs[at] += 1
    rarity = np.where(docs >= max(MIN_DOCS, MIN_SHARE * n), np.log((n + 1) / (docs + 1)), 0).astype(np.float32)
    rarity /= PACKED
    z, fold = np.zeros(n), np.random.default_rng(SEED).permutation(n) % FOLDS
    for k in range(FOLDS):
        others, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        weights, bias = _adam([bags[i] for i in others], labels[others], rarity)
        z[own] = [bias + float((weights * rarity)[bags[i][0]] @ bags[i][1].astype(np.float32)) for i in own]
    weights, bias = _adam(bags, labels, rarity)
    return Model(weights * rarity * PACKED, bias + np.log(THRESHOLD / (1 - THRESHOLD)) - cut_of(z, labels), buckets)


def cut_of(z: np.ndarray, labels: np.ndarray, beta: float = BETA) -> float:
    """The margin from which on calling a row toxic gives the best F-measure; recall counts `beta` times as much as precision. The mean of it and the next margin below."""
    order = np.argsort(-z, kind="stable")
    hits, called = np.cumsum(labels[order]), np.arange(1, len(z) + 1)
    ends = np.flatnonzero(np.diff(z[order], append=-np.inf))  # equal margins are called together
    score = (1 + beta**2) * hits[ends] / (beta**2 * labels.sum() + called[ends])
    at = ends[int(score.argmax())]
    return float(z[order[at]] if at + 1 == len(z) else (z[order[at]] + z[order[at + 1]]) / 2)


def _adam(bags, labels: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, float]:
    buckets = len(rarity)
    rng, n = np.random.default_rng(SEED), len(labels)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    params = [rng.normal(0, 0.05, (buckets, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.log(np.array([1 - share, share], np.float32))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            x = np.zeros((len(at), buckets), np.float32)
            for r, i in enumerate(at):
                x[r, bags[i][0]] = bags[i][1] * (rarity[bags[i][0]] * SCALE)
            e, w, b = params
            mean = x @ e
            z = mean @ w + b
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = z / z.sum(axis=1, keepdims=True)
            g[np.arange(len(at)), labels[at]] -= 1
            g /= len(at)
            step += 1
            for k, d in enumerate((x.T @ (g @ w.T), mean.T @ g, g.sum(axis=0))):
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.001 * (d * d - second[k])
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + np.float32(1e-6))
                if k < 2:
                    params[k] *= 1 - rate * DECAY
    e, w, b = params
    return (e @ (w[:, 1] - w[:, 0]) * SCALE).astype(np.float32), float(b[1] - b[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `rows` labelled rows of `docs`, whole texts. Rows with a null id or label are left out; of several labels of an id the largest counts."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one text of a repeated id: the bound holds

    def bags(batches):
        for batch in batches:
            made = [bag(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("y"), pa.array([a.astype(np.uint16).tobytes() for a, _ in made], pa.binary()),
                 pa.array([(b * PACKED).astype(np.float16).tobytes() for _, b in made], pa.binary())],
                names=["doc_id", "y", "at", "share"])

    found = bounded_batches(texts).mapInArrow(bags, "doc_id string, y int, at binary, share binary").toLocalIterator()
    got = sorted(((r["doc_id"], r["y"], r["at"], r["share"]) for r in found), key=lambda r: r[0])
    return train([(np.frombuffer(at, np.uint16), np.frombuffer(share, np.float16)) for _, _, at, share in got], np.array([r[1] for r in got], np.int64))


class _Words(dict):
    """Margins of words, worked out once each while the table holds."""

    def __init__(self, model: Model):
        self.model = model

    def of(self, words: list[str]) -> list[float]:
        if len(self) > CACHED_WORDS:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            found, of = subwords(part, self.model.buckets)
            self.update(zip(part, (np.bincount(of, self.model.weights[found]) / np.bincount(of)).tolist()))
        return list(map(self.__getitem__, words))


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """`docs` packed as `row`, with the score of its whole text. A text without words, or null, gets the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = packed(docs)
    kind = rows.schema.simpleString()[len("struct<"):-1]

    def score(batches):
        words = _Words(shared.value)
        for batch in batches:
            out = []
            for text in batch.column("row").field("text").to_pylist():
                found = words.of(TOKEN.findall((text or "").lower()))
                z = shared.value.bias + (sum(found) / len(found) if found else 0.0)
                out.append(1.0 / (1.0 + np.exp(-min(max(z, -50.0), 50.0))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.float64())], names=["row", column])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(column, T.DoubleType())])
    return bounded_batches(rows).mapInArrow(score, schema)


def held_out(doc_id="doc_id"):
    """Rows no label is learned from: the remainder of crc32(id) by 4 is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`; labels of held-out rows are not looked at.

    Only the text makes the score. Null and empty texts are scored too; repeated rows score alike; extra columns are not read; empty tables give no rows, and without labels every
    score is one small constant.
    """
    model = fit(docs, labels.where(~held_out()))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    return unpacked(scored(docs, fit(docs, labels.where(~held_out()))).where(F.col("score") < THRESHOLD), docs)

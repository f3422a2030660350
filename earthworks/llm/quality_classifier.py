"""Quality classifier: random-indexing word vectors, pooled per document, and a calibrated two-layer network.

Words are runs of letters and digits, or of signs, as they are written; each falls in a bucket of a hash. A bucket has a
fixed sparse random index vector; its word vector is the sum of the index vectors of all buckets met beside it, over the
texts of all documents, scaled to length one. A document is pooled to the mean and the spread of its words' vectors, its
length and how its neighbouring words agree. A network with one hidden layer is fitted on labelled documents; a part of
them that training does not see sets a temperature, so that scores are probabilities.

There are so many buckets that four words of five met in a text are the main word of their bucket (81 % at sf0.1, 80 % with
seven times the text): a vector belongs to one word in the main, and the rare words beside it say little.

Bounded: word vectors are ``BUCKETS`` rows whatever the input, labelled rows for the fit at most ``TRAIN_ROWS``, taken in
the order of a hash of their id. Word statistics cover all documents and all their words.

Defined results: null and empty texts have no words, are pooled to zeros and get a score like any other. Rows without a
label, with an unknown document or a held-out one teach nothing. If no labels are left, or only one, the score is that
label's share (0.5 without any). Repeated rows each get a result; a document labelled twice counts twice. Very long texts
are read whole, in pieces cut at white space. Empty tables give empty results. lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.llm.store import kept
from earthworks.llm.words import pieces

BUCKETS = 1 << 15
DIMENSIONS = 64
FEATURES = 2 * DIMENSIONS + 4
ENTRIES = 2
REACH = 2
TRAIN_ROWS = 20_000
HIDDEN = 32
SEED = 11
WORD = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


class Buckets(dict):
    """Bucket of a word; the memory of words seen is emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = at = crc32(word.encode("utf-8", "replace")) % BUCKETS
        return at


def bucketed(text: str | None, buckets: Buckets) -> np.ndarray:
    parts = [np.fromiter(map(buckets.__getitem__, WORD.findall(p)), np.int64) for p in pieces(text or "")]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMENSIONS, (BUCKETS + 1, ENTRIES)), rng.choice([-1.0, 1.0], (BUCKETS + 1, ENTRIES))


def word_sums(df: DataFrame, text: str = "text") -> DataFrame:
    """``bucket`` and the sums ``c0``, ``c1``, ... of its neighbours' index vectors. Each task sends one row per bucket."""
    names = [f"c{k}" for k in range(DIMENSIONS)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros((BUCKETS + 1) * DIMENSIONS)
        buckets, gap = Buckets(), np.full(REACH, BUCKETS)  # texts are kept apart by a bucket that doesn't count
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                parts = []
                for one in batch.column(0).slice(at, 256):
                    parts += [bucketed(one.as_py(), buckets), gap]
                words = np.concatenate(parts)
                for far in range(1, REACH + 1):
                    for own, other in ((words[:-far], words[far:]), (words[far:], words[:-far])):
                        real = (own < BUCKETS) & (other < BUCKETS)
                        own, other = own[real] * DIMENSIONS, other[real]
                        for e in range(ENTRIES):
                            np.add.at(total, own + places[other, e], signs[other, e])
        table = total.reshape(-1, DIMENSIONS)[:BUCKETS]
        some = np.flatnonzero(table.any(axis=1))
        yield pa.record_batch([pa.array(some.astype(np.int32)), *[pa.array(table[some, k].astype(np.float32))
                                                                  for k in range(DIMENSIONS)]], names=["bucket", *names])

    sums = df.select(text).mapInArrow(gather, "bucket int, " + ", ".join(f"{n} float" for n in names))
    return sums.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """One row per bucket, of length one or zero; ``BUCKETS`` rows reach the driver at most."""
    found = kept(word_sums(df, text), "word-vectors").toArrow()
    table = np.zeros((BUCKETS, DIMENSIONS))
    if found.num_rows:
        table[found.column("bucket").to_numpy()] = np.column_stack([found.column(k + 1).to_numpy() for k in range(DIMENSIONS)])
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' vectors; log length; of followers, the share of distinct pairs, of equal words, and
    the mean product of their vectors."""
    if not len(words):
        return np.zeros(FEATURES, np.float32)
    total, square, near = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0
    for at in range(0, len(words), 1 << 14):
        part = vectors[words[at : at + (1 << 14) + 1]]
        near += float(np.einsum("ij,ij->", part[:-1], part[1:]))
        part = part[: 1 << 14]
        total += part.sum(axis=0)
        square += (part * part).sum(axis=0)
    mean = total / len(words)
    spread = np.sqrt(np.maximum(square / len(words) - mean * mean, 0))
    followers = max(len(words) - 1, 1)
    pairs = np.unique(words[:-1] * BUCKETS + words[1:]).size / followers
    same = np.count_nonzero(words[:-1] == words[1:]) / followers
    return np.concatenate([mean, spread, [np.log1p(len(words)) / 10, pairs, same, near / followers]]).astype(np.float32)


@dataclass(frozen=True)
class Network:
    """logit = w2 . tanh(w1 . x + b1) + b2 over scaled features, divided by the temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 3e-3) -> Network:
    """Adam on nine tenths of the rows; the last tenth chooses the temperature."""
    rng = np.random.default_rng(SEED)
    size = x.shape[1]
    shift, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(size), np.ones(size))
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Network(shift, scale, np.zeros((size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    order = rng.permutation(len(x))
    held, seen = order[: len(x) // 10], order[len(x) // 10 :]
    z = ((x - shift) / scale)[seen]
    target = y[seen]
    p = [rng.normal(0, 1 / np.sqrt(size), (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        mixed = rng.permutation(len(z))
        for at in range(0, len(z), batch):
            a, t = z[mixed[at : at + batch]], target[mixed[at : at + batch]]
            h = np.tanh(a @ p[0] + p[1])
            error = (_sigmoid(h @ p[2] + p[3]) - t) / len(a)
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [a.T @ back + decay * p[0], back.sum(axis=0), h.T @ error + decay * p[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]))
    if not len(held):
        return net
    logits = net.logits(x[held])
    best = min(np.geomspace(0.5, 8, 101), key=lambda t: _loss(logits / t, y[held]))
    return Network(net.shift, net.scale, net.w1, net.b1, net.w2, net.b2, float(best))


def _features(df: DataFrame, keys: list[str], vectors: np.ndarray, text: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(vectors)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", x array<float>"

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = [pooled(bucketed(t.as_py(), buckets), sent.value) for t in batch.column(len(keys))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float32()))], names=[*keys, "x"])

    return df.select(*keys, text).mapInArrow(pool, schema)


def learn(df: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors over all of ``df``, and a network fitted on at most ``rows`` labelled rows of it.

    ``labels`` has ``doc_id`` and the label; leave out what is not to be learned from.
    """
    vectors = word_vectors(df, text)
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("_y"))
    some = kept(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled")
    taught = df.select("doc_id", text).join(F.broadcast(some), "doc_id")  # at most ``rows`` narrow rows
    found = _features(taught, ["_y"], vectors, text).toArrow() if some.limit(1).count() else None
    if found is None or not found.num_rows:
        return vectors, fit(np.zeros((0, FEATURES)), np.zeros(0))
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1).astype(float)
    y = found.column("_y").to_numpy().astype(float)
    order = np.lexsort(x.T)  # tasks end in any order; the fit must not
    return vectors, fit(x[order], y[order])


def scored(df: DataFrame, keys: list[str], vectors: np.ndarray, net: Network, text: str = "text") -> DataFrame:
    """The keys and ``score``, the probability of label 1."""
    sent = df.sparkSession.sparkContext.broadcast((vectors, net))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, (table, of) = Buckets(), sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = np.array([pooled(bucketed(t.as_py(), buckets), table) for t in batch.column(len(keys))], float)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(of.scores(x))], names=[*keys, "score"])

    return df.select(*keys, text).mapInArrow(score, schema)

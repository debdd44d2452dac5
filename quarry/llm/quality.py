"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word, punctuation run and repetition falls into one of VOCABULARY hashed
entries.  An entry has a sparse random index vector; its context vector is the
sum of the index vectors of its neighbours over the whole corpus, whole
numbers that Spark adds up, so the sums agree whichever way tasks run.  A
document is the mean index and context vector of its words.  A two-layer
network over these, fitted in numpy, gives a logit that a temperature, fitted
on rows that the network has not seen, turns into a probability.

Defined results: a null or empty text has the zero vector and scores like it;
rows are scored one by one, so repeated ids and other columns matter not;
labels repeated for a document count as the largest; without usable labels of
both classes every score is the mean label (0 where there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import frugal, small_batches
from .toxicity import THRESHOLD, fold, labelled_sample
from .wordhash import Words, blocks, mix, split_classes

#: Labelled rows that the network is fitted on at most, taken in the order of a hash of their ids.
FIT_ROWS = 20_000
VOCABULARY, DIMENSIONS, NONZERO, REACH = 1 << 13, 24, 3, 2
HIDDEN, EPOCHS = 24, 300
_U = np.uint64


def entries(words: Words) -> np.ndarray:
    """Vocabulary entry of each token: capitals share entries by length, a repeated word is a repetition."""
    h = words.hashes(fold_case=True)
    exact = words.hashes()
    length = words.ends - words.starts
    first, last = words.data[words.starts], words.data[words.ends - 1]
    capital = (length > 1) & (first >= 65) & (first < 91) & (last >= 65) & (last < 91)
    h = np.where(capital, mix(np.minimum(length, 12).astype(np.uint64) + _U(0xCA9)), h)
    letter = ((first >= 48) & (first < 58)) | ((first | 32) >= 97) & ((first | 32) < 123) | (first >= 128)
    # The token one or two back is the same: with or without punctuation between.
    again = np.zeros(len(h), bool)
    owner = words.owner()
    for back in (1, 2):
        again[back:] |= (exact[back:] == exact[:-back]) & (owner[back:] == owner[:-back])
    h = np.where(again & letter, _U(1), h)
    return (h & _U(VOCABULARY - 1)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of the nonzero components of each entry."""
    x = mix(np.arange(VOCABULARY * NONZERO, dtype=np.uint64) + _U(99)).reshape(VOCABULARY, NONZERO)
    return (x % _U(DIMENSIONS)).astype(np.int64), ((x >> _U(40)) & _U(1)).astype(np.int64) * 2 - 1


def context_sums(docs: DataFrame) -> np.ndarray:
    """A row per entry: the sum of its neighbours' index vectors and, last, how many there were; a fixed size."""
    names = [f"d{i}" for i in range(DIMENSIONS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, signs = index_vectors()
        total = np.zeros(VOCABULARY * (DIMENSIONS + 1))
        for batch in batches:
            for _, _, words in blocks(batch, cut=split_classes):
                e, owner = entries(words), words.owner()
                for back in range(1, REACH + 1):
                    same = owner[back:] == owner[:-back]
                    a, b = e[back:][same], e[:-back][same]
                    for to, of in ((a, b), (b, a)):
                        at = to * (DIMENSIONS + 1)
                        for k in range(NONZERO):
                            total += np.bincount(at + dims[of, k], signs[of, k], len(total))
                        total += np.bincount(at + DIMENSIONS, minlength=len(total))
        table = total.reshape(VOCABULARY, -1).astype(np.int64)
        seen = np.flatnonzero(table[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(table[seen, i]) for i in range(DIMENSIONS + 1))], names=["entry", *names])

    parts = small_batches(docs).select("doc_id", "text").mapInArrow(frugal(run), ", ".join(["entry int", *(f"{n} long" for n in names)]))
    summed = parts.groupBy("entry").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((VOCABULARY, DIMENSIONS + 1))
    out[summed.column("entry").to_numpy()] = np.stack([summed.column(n).to_numpy() for n in names], axis=1) if summed.num_rows else 0
    return out


@dataclass
class WordVectors:
    table: np.ndarray  # a row per entry: index vector, then context vector

    @classmethod
    def of(cls, sums: np.ndarray) -> WordVectors:
        dims, signs = index_vectors()
        index = np.zeros((VOCABULARY, DIMENSIONS))
        for k in range(NONZERO):
            np.add.at(index, (np.arange(VOCABULARY), dims[:, k]), signs[:, k])
        context = sums[:, :-1] / np.maximum(1, sums[:, -1:])
        return cls(np.concatenate([index, context], axis=1))

    def pooled(self, words: Words) -> np.ndarray:
        """Mean vector of each document of a block, then the log of its length."""
        e, owner, n = entries(words), words.owner(), len(words.doc_ids)
        counts = np.maximum(1, words.counts())
        out = np.empty((n, self.table.shape[1] + 1))
        for k in range(self.table.shape[1]):
            out[:, k] = np.bincount(owner, self.table[e, k], n) / counts if len(e) else 0
        out[:, -1] = np.log1p(words.counts())
        return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Logistic loss with L2, by Adam over all rows; every fifth row only fits the temperature."""
    d, mean = x.shape[1], float(y.mean()) if len(y) else 0.0
    rng = np.random.default_rng(seed)
    net = Network(x.mean(axis=0) if len(x) else np.zeros(d), x.std(axis=0) + 1e-3 if len(x) else np.ones(d), rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log((mean + 1e-9) / (1 - mean + 1e-9))), 1.0)
    if len(y) == 0 or mean in (0.0, 1.0):
        return net
    calibrate = np.arange(len(y)) % 5 == 4
    z = (x - net.mean) / net.scale
    zt, yt = z[~calibrate], y[~calibrate]
    params = [net.w1, net.b1, net.w2, np.array(net.b2)]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        w1, b1, w2, b2 = params
        h = np.tanh(zt @ w1 + b1)
        e = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - yt) / len(yt)
        back = np.outer(e, w2) * (1 - h * h)
        grads = [zt.T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ e + 1e-4 * w2, e.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            params[i] = params[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3])
    logits, labels = net.logits(x[calibrate]), y[calibrate]
    if len(labels):
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        net.temperature = float(min(grid, key=lambda t: np.logaddexp(0, np.where(labels == 1, -1, 1) * logits / t).mean()))
    return net


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows: int = FIT_ROWS) -> tuple[WordVectors, Network]:
    """Word vectors from all documents, a network from at most `rows` labelled ones."""
    vectors = WordVectors.of(context_sums(docs))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    width = vectors.table.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, words in blocks(batch, cut=split_classes):
                x = shared.value.pooled(words)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([pa.array(words.doc_ids), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), pa.array(label[a:b])], names=["doc_id", "x", "label"])

    # `rows` ids at most, so small enough to send to every task.
    sample = F.broadcast(labelled_sample(labels, "quality", folds, held_out, rows))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").mapInArrow(frugal(run), "doc_id long, x array<double>, label double").toArrow().sort_by("doc_id")
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, width)
    return vectors, fit(x, found.column("label").to_numpy())


def quality_scores(docs: DataFrame, vectors: WordVectors, network: Network, folds: int = 5, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    columns = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            scores = [network.scores(vectors.pooled(words)) for _, _, words in blocks(batch, cut=split_classes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, "score"])

    docs = small_batches(docs).select(*columns)
    scored = docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumns({"held_out": F.coalesce(fold(folds) == held_out, F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})

"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a whole text and their four- and five-byte
beginnings, which compounds share.  The terms that tell the classes apart best
in the labelled rows become binary features; the machine learns a weight for
each and, through factors, for each pair of them, so an insult together with a
mention of a group can weigh more than the sum of both.

Defined results: a null or empty text has no terms and scores the machine's
bias; rows are scored one by one, so repeated ids and other columns matter not;
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

from .shared import cut, frugal, small_batches
from .wordhash import Words, blocks, mix, split_classes

#: Labelled rows that the machine is fitted on at most, taken in the order of a hash of their ids.
FIT_ROWS = 6_000
#: Bytes of text whose terms are hashed at a time.
BLOCK_BYTES = 1 << 20
FEATURES, FACTORS, EPOCHS = 4096, 8, 60
THRESHOLD = 0.3
#: Least log-likelihood ratio of a term: what chance gives one term in tens of thousands.
EVIDENCE = 10.0
PREFIXES = (4, 5)
_U = np.uint64


def document_terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Different term hashes of each document of a block, one after the other, and where each document's start."""
    letters = np.flatnonzero((words.data[words.starts] != 0) & (words.ends - words.starts > 1)) if len(words.starts) else np.zeros(0, np.int64)
    owner, whole = words.owner()[letters], words.hashes(fold_case=True)[letters]
    terms, owners = [whole], [owner]
    starts, ends = words.starts[letters], words.ends[letters]
    for n in PREFIXES:
        long = ends - starts > n
        terms.append(words.parts(starts[long], starts[long] + n, fold_case=True, salt=31))
        owners.append(owner[long])
    term, owner = np.concatenate(terms), np.concatenate(owners)
    order = np.lexsort((term, owner))
    term, owner = term[order], owner[order]
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
    return term[fresh], np.searchsorted(owner[fresh], np.arange(len(words.doc_ids) + 1))


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted hashes of the features
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # a row per feature

    def logits(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """term: hashes of all documents, at: where each document's start."""
        place = np.searchsorted(self.terms, term)
        place[place == len(self.terms)] = 0
        known = self.terms[place] == term if len(self.terms) else np.zeros(len(term), bool)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))[known]
        return _fm(row, place[known], len(at) - 1, self.bias, self.weights, self.factors)[0]


def _fm(row: np.ndarray, feature: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    linear = np.bincount(row, w[feature], n) if len(row) else np.zeros(n)
    sums, squares = np.zeros((n, v.shape[1])), np.zeros((n, v.shape[1]))
    for k in range(v.shape[1]):
        x = v[feature, k]
        sums[:, k] = np.bincount(row, x, n)
        squares[:, k] = np.bincount(row, x * x, n)
    return bias + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums


def fit(names: np.ndarray, f: np.ndarray, at: np.ndarray, label: np.ndarray, seed: int = 1) -> FactorizationMachine:
    """Logistic loss with L2, by full-batch Adam; deterministic.

    names: sorted hashes of the features; f: features of all rows, at: where each row's start.
    """
    n = len(label)
    mean = float(label.mean()) if n else 0.0
    none = FactorizationMachine(np.zeros(0, np.uint64), float(np.log((mean + 1e-9) / (1 - mean + 1e-9))), np.zeros(1), np.zeros((1, FACTORS)))
    if n == 0 or mean in (0.0, 1.0) or not len(names):
        return none
    row = np.repeat(np.arange(n), np.diff(at))
    rng = np.random.default_rng(seed)
    bias, w, v = none.bias, np.zeros(len(names)), rng.normal(0, 0.01, (len(names), FACTORS))
    m = [0.0, np.zeros_like(w), np.zeros_like(v)]
    s = [0.0, np.zeros_like(w), np.zeros_like(v)]
    for step in range(1, EPOCHS + 1):
        z, sums = _fm(row, f, n, bias, w, v)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / n
        gw = np.bincount(f, e[row], len(w)) + 1e-5 * w
        gv = np.empty_like(v)
        square = np.bincount(f, e[row], len(w))
        for k in range(FACTORS):
            gv[:, k] = np.bincount(f, (e[:, None] * sums)[row, k], len(w)) - square * v[:, k]
        grads = [float(e.sum()), gw, gv + 1e-4 * v]
        params = [bias, w, v]
        for i, rate in enumerate((0.1, 0.1, 0.02)):
            m[i] = 0.9 * m[i] + 0.1 * grads[i]
            s[i] = 0.99 * s[i] + 0.01 * grads[i] ** 2
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
        bias, w, v = float(params[0]), params[1], params[2]
    return FactorizationMachine(names, bias, w, v)


def labelled_sample(labels: DataFrame, column: str, folds: int, held_out: int, rows: int = FIT_ROWS) -> DataFrame:
    """At most `rows` ids with their labels, outside the held-out fold, in the order of a hash of the id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("double").alias("label"))
    return usable.where(fold(folds) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fold(folds: int, doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def telling_terms(found: DataFrame) -> np.ndarray:
    """found: terms, label.  Sorted hashes of at most FEATURES terms of two rows or more that tell the labels apart best; counted by Spark."""
    n, ones = found.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < ones < n:
        return np.zeros(0, np.uint64)
    counted = found.select(F.explode("terms").alias("term"), "label").groupBy("term").agg(F.count("*").alias("df"), F.sum("label").alias("hits")).where("df >= 2")
    # G statistic of each term against the label, from either side.
    expected, hits, rest = F.col("df") * (ones / n), F.col("hits"), F.col("df") - F.col("hits")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    g = part(hits, expected) + part(rest, F.col("df") - expected)
    top = counted.select("term", g.alias("g")).where(F.col("g") > EVIDENCE).orderBy(F.desc("g"), "term").limit(FEATURES).toArrow()
    return np.sort(top.column("term").to_numpy().view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, rows: int = FIT_ROWS) -> FactorizationMachine:
    """Fit on the terms of at most `rows` labelled documents.

    Terms are made and counted by Spark; the driver gets the numbers of the
    features that each of these documents has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, words in blocks(batch, cut=split_classes, size=BLOCK_BYTES):
                term, at = document_terms(words)
                terms = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(term.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(words.doc_ids), terms, pa.array(label[a:b])], names=["doc_id", "terms", "label"])

    # `rows` ids at most, so small enough to send to every task.
    sample = F.broadcast(labelled_sample(labels, "toxic", folds, held_out, rows))
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(texts.join(sample, "doc_id").mapInArrow(frugal(run), "doc_id long, terms array<long>, label double"))
    names = telling_terms(found)
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for batch in batches:
            features = []
            for terms in batch.column(1):
                term = terms.values.to_numpy().view(np.uint64)
                place = np.searchsorted(names, term)
                place[place == len(names)] = 0
                features.append(place[names[place] == term].astype(np.int32) if len(names) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "features", "label"])

    kept = found.mapInArrow(frugal(known), "doc_id long, features array<int>, label double").toArrow().sort_by("doc_id")
    features = kept.column("features").to_pylist()
    at = np.concatenate(([0], np.cumsum([len(x) for x in features]))).astype(np.int64)
    return fit(names, np.array([x for f in features for x in f], np.int64), at, kept.column("label").to_numpy())


def toxicity_scores(docs: DataFrame, machine: FactorizationMachine, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    columns = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [1 / (1 + np.exp(-np.clip(model.logits(*document_terms(words)), -30, 30))) for _, _, words in blocks(batch, cut=split_classes, size=BLOCK_BYTES)]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    docs = small_batches(docs).select(*columns)
    scored = docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumns({"held_out": F.coalesce(fold(folds) == held_out, F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})

"""Rank of a full-text hit from the places of its terms.

A query that is one conjunction or one phrase ranks by proximity: every two
terms at every two of their places add the root of both weights times a factor
that falls with their distance, joined like independent chances.  Any other
query ranks by occurrence: of each term the heaviest place counts in full and
every further one less, by the square of its number, averaged over the terms.
Excluded words take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the title, the body, the tags, and what has no weight of its own.
PART_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: The limit of the sum of 1 / n**2, the rank of a conjunction none of whose terms meet, the distance beyond which terms hardly count, and their factor there.
SQUARES, LOWEST, FAR, FAR_FACTOR = 1.64493406685, 1e-20, 100, 1e-30
#: What the rank may be divided by.
BY_LOG_LENGTH, BY_LENGTH, BY_WORDS, BY_LOG_WORDS, BY_ITSELF = 1, 2, 8, 16, 32


def occurrence(weights: Column) -> Column:
    """What one term adds, from the weights of its places in order; 0 without any."""

    def of(w: Column) -> Column:
        top = F.array_max(w)
        at = F.array_position(w, top).cast("double")
        falling = F.aggregate(F.transform(w, lambda x, i: x / ((i + 1) * (i + 1)).cast("double")), F.lit(0.0), lambda s, x: s + x)
        return (top + falling - top / (at * at)) / F.lit(SQUARES)

    # Bound as a variable, the weights are made once.
    return F.coalesce(F.get(F.transform(F.array(F.when(F.size(weights) > 0, weights)), of), F.lit(0)), F.lit(0.0))


def nearness(distance: np.ndarray) -> np.ndarray:
    return np.where(distance > FAR, FAR_FACTOR, 1.0 / (1.005 + 0.05 * np.exp(np.minimum(distance, FAR) / 1.5 - 2.0)))


def _pair(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Log of the chance that no near pair counts, and the sum of the far ones."""
    (at_a, w_a), (at_b, w_b) = a, b
    low, high = np.searchsorted(at_b, at_a - FAR, "left"), np.searchsorted(at_b, at_a + FAR, "right")
    counts = high - low
    of = np.repeat(np.arange(len(at_a)), counts)
    other = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + low[of]
    distance, both = np.abs(at_a[of] - at_b[other]), w_a[of] * w_b[other]
    apart = distance > 0
    far = np.sqrt(w_a).sum() * np.sqrt(w_b).sum() - np.sqrt(both).sum()
    near = np.sqrt(both[apart] * nearness(distance[apart]))
    return float(np.log1p(-np.minimum(near, 1 - 1e-12)).sum()), max(0.0, float(far)) * FAR_FACTOR**0.5


def proximity_of(terms: Sequence[tuple[np.ndarray, np.ndarray]]) -> float:
    """Rank of a conjunction from the places and weights of each of its terms; pairs further apart than FAR are summed, not visited."""
    none, far, met = 0.0, 0.0, False
    for i, one in enumerate(terms):
        for other in terms[:i]:
            if len(one[0]) and len(other[0]):
                n, f = _pair(one, other)
                none, far, met = none + n, far + f, True
    rank = -np.expm1(none) + np.exp(none) * far
    return float(rank) if met and rank > 0 else LOWEST


def _proximity(terms: pa.Array) -> pa.Array:
    return pa.array([None if row is None else proximity_of([(np.array(t["places"], np.int64), np.array(t["weights"], np.float64)) for t in row]) for row in terms.to_pylist()], pa.float64())


def proximity(terms: Column) -> Column:
    """Rank of a conjunction; `terms` is an array of places (array<int>, ascending) and weights (array<double>) of each term."""
    return F.arrow_udf(_proximity, "double")(terms)


def normalized(rank: Column, length: Column, words: Column, flags: int) -> Column:
    """The rank divided by what `flags` names: length of all words, number of different ones, their logarithms, itself plus one."""
    for flag, divisor in ((BY_LOG_LENGTH, F.log2(length + 1)), (BY_LENGTH, length), (BY_WORDS, words), (BY_LOG_WORDS, F.log2(words + 1))):
        if flags & flag:
            rank = F.when(length > 0, rank / divisor).otherwise(rank)
    return rank / (rank + 1) if flags & BY_ITSELF else rank

"""Gradient descent whose gradients are summed over the partitions of a table.

Each round ships the weights (their size is a parameter of the model, not of the
data) to every partition, and the partitions return one partial gradient each. The
table should have few partitions: a round moves ``partitions x weights`` numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Gradient = Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, float]]


def descend(table: DataFrame, gradient: Gradient, weights: np.ndarray, rounds: int, rate: float,
            decay: float = 0.0) -> np.ndarray:
    """Adagrad over ``rounds`` full passes.

    ``gradient(batch, weights)`` returns the summed gradient of the loss and the
    number of cases. Partial sums are added in partition order, so that reruns agree.
    An empty table leaves the weights as they are.
    """
    weights = weights.astype(np.float32)
    squares = np.full(weights.shape, 1e-8, np.float64)
    for _ in range(rounds):
        def step(batches: Iterator[pa.RecordBatch], w: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            total, cases = np.zeros(w.shape, np.float64), 0.0
            for batch in batches:
                if batch.num_rows:
                    g, n = gradient(batch, w)
                    total += g
                    cases += n
            if cases:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([cases], pa.float64()),
                     pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "cases", "gradient"])

        parts = sorted(table.mapInArrow(step, "part int, cases double, gradient binary").collect())
        cases = sum(p.cases for p in parts)
        if not cases:
            return weights
        total = np.zeros(weights.shape, np.float64)
        for p in parts:
            total += np.frombuffer(p.gradient, np.float32).reshape(weights.shape)
        total = total / cases + decay * weights
        squares += total * total
        weights = (weights - rate * total / np.sqrt(squares)).astype(np.float32)
    return weights


Fit = Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, float, float]]


def fit_kept(table: DataFrame, fit: Fit, starts: list[np.ndarray], rounds: int, rate: float, pull: np.ndarray) -> np.ndarray:
    """Adagrad from the best of ``starts``, stopped at the round that rows kept back like best.

    ``fit(batch, weights)`` returns the gradient and the number of the cases to fit, and the
    log-likelihood of the cases kept back. The weights are drawn back to their start
    by ``pull`` (a number of cases for each weight), which is a Gaussian prior whose weight
    falls with the corpus. The start itself counts as a round, so that the result is never
    worse on the kept cases than where it began. An empty table gives the first start.
    """
    def summed(weights: list[np.ndarray], gradient: bool) -> tuple[np.ndarray, float, list[float]]:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            total, cases, kept, rows = np.zeros(weights[0].shape, np.float64), 0.0, np.zeros(len(weights)), 0
            for batch in batches:
                rows += batch.num_rows
                for i, w in enumerate(weights):
                    g, n, k = fit(batch, w)
                    kept[i] += k
                    if gradient:
                        total += g
                        cases += n
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([cases], pa.float64()), pa.array([kept.tobytes()], pa.binary()),
                     pa.array([total.astype(np.float32).tobytes() if gradient else b""], pa.binary())], ["part", "cases", "kept", "gradient"])

        parts = sorted(table.mapInArrow(step, "part int, cases double, kept binary, gradient binary").collect())
        total = np.zeros(weights[0].shape, np.float64)
        for p in parts:
            if gradient:
                total += np.frombuffer(p.gradient, np.float32).reshape(total.shape)
        return total, sum(p.cases for p in parts), list(sum((np.frombuffer(p.kept) for p in parts), np.zeros(len(weights))))

    starts = [w.astype(np.float32) for w in starts]
    _, _, liked = summed(starts, False)
    start = weights = starts[int(np.argmax(liked))]
    best, best_liked = start, -np.inf
    squares = np.full(start.shape, 1e-8, np.float64)
    for _ in range(rounds + 1):
        total, cases, (now,) = summed([weights], True)
        if now > best_liked:
            best, best_liked = weights, now
        elif now < best_liked:
            break
        if not cases:
            break
        total = (total + pull * (weights - start)) / cases
        squares += total * total
        weights = (weights - rate * total / np.sqrt(squares)).astype(np.float32)
    return best

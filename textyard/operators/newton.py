"""Logistic regression by Newton steps on dense features.

A step needs the weighted Gram matrix and the gradient over all rows: one job, whose tasks add up their rows and send
a matrix each, whatever their number of rows; matrix rows are then added in parallel. A few steps reach the optimum,
where first-order methods take dozens of jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Widest features: a task holds one matrix of this many squared doubles, 8 MB.
WIDEST = 1_024
STEPS = 10
TOLERANCE = 1e-8

SUMS = "i int, sums array<double>"


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _partial(beta: np.ndarray, dim: int):
    """Batches (x, y, w) -> the task's Gram rows 0..dim and, as row dim + 1, gradient and loss; the intercept comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, gradient, loss = np.zeros((dim + 1, dim + 1)), np.zeros(dim + 1), 0.0
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            x = np.hstack([x, np.ones((len(x), 1))])
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            z = x @ beta
            p = _sigmoid(z)
            gram += (x * (w * p * (1 - p))[:, None]).T @ x
            gradient += x.T @ (w * (p - y))
            loss += float((w * (np.logaddexp(0, z) - y * z)).sum())
        flat = np.concatenate([gram.ravel(), gradient, [loss]])
        ends = np.append(np.arange(dim + 2) * (dim + 1), len(flat)).astype(np.int32)
        rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 2, dtype=np.int32)), rows], names=["i", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal ``i`` added; a partition holds all of its rows, and as many sums as it has different ones."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
        for i, row in zip(batch.column(0).to_pylist(), np.split(values, ends[:-1])):
            sums[i] = sums[i] + row if i in sums else row
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()])], names=["i", "sums"])


def _totals(rows: DataFrame, beta: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, float]:
    parts = rows.mapInArrow(_partial(beta, dim), SUMS)
    # one matrix of at most WIDEST squared entries reaches the driver
    found = sorted(parts.repartition("i").mapInArrow(_add, SUMS).collect(), key=lambda r: r["i"])
    last = np.array(found[-1]["sums"])
    return np.array([r["sums"] for r in found[:-1]]), last[:-1], float(last[-1])


@dataclass(frozen=True)
class LinearModel:
    """A fitted classifier. ``gradient_norm`` is the largest entry of the gradient where the steps ended."""

    coefficients: np.ndarray
    intercept: float
    steps: int
    gradient_norm: float

    def margin(self, features: Column) -> Column:
        """The score of an array column."""
        weights = F.array(*[F.lit(float(c)) for c in self.coefficients])
        return F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(self.intercept), lambda s, v: s + v)

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Add ``prediction``; a whole Arrow batch is scored at a time."""
        beta, bias, dim = self.coefficients, self.intercept, len(self.coefficients)
        kept = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                said = (_matrix(batch.column(len(kept)), dim) @ beta + bias > 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said)], names=[*kept, "prediction"])

        schema = T.StructType([*rows.schema.fields, T.StructField("prediction", T.DoubleType())])
        return rows.select("*", as_array(rows, features).alias("_x")).mapInArrow(run, schema)


def as_array(rows: DataFrame, features: str) -> Column:
    if isinstance(rows.schema[features].dataType, T.ArrayType):
        return F.col(features).cast("array<double>")
    return vector_to_array(features)


def fit_newton(
    rows: DataFrame, dim: int, weights: dict, label: str = "label", features: str = "features", c: float = 1.0,
    steps: int = STEPS, tolerance: float = TOLERANCE,
) -> LinearModel:
    """Minimise ½|β|² + C · Σ weight · logloss over rows with labels 0 and 1, the intercept free.

    A step that raises the loss is halved. It ends where no entry of the gradient passes ``tolerance`` times the sum
    of the weights, or after ``steps`` steps; each step is one job over ``rows``, which should be stored.
    """
    if dim > WIDEST:
        raise ValueError(f"{dim} features are more than {WIDEST}")
    kind = F.when(F.col(label) == 1, F.lit(float(weights.get(1, 1.0)))).otherwise(F.lit(float(weights.get(0, 1.0))))
    ready = rows.select(as_array(rows, features).alias("x"), F.col(label).cast("double").alias("y"), (kind * c).alias("w"))
    penalty = np.append(np.ones(dim), 0.0)
    beta, moved, best, taken = np.zeros(dim + 1), np.zeros(dim + 1), np.inf, 0
    norm = np.inf
    for taken in range(steps + 1):
        gram, gradient, loss = _totals(ready, beta, dim)
        gradient = gradient + penalty * beta
        loss += 0.5 * float((penalty * beta * beta).sum())
        if loss > best + 1e-9 * abs(best):
            moved = moved / 2
            beta = beta - moved
            continue
        best, norm = loss, float(np.abs(gradient).max())
        if norm <= tolerance * max(float(np.trace(gram)), 1.0) or taken == steps:
            break
        # one class alone leaves the intercept without curvature
        moved = -np.linalg.lstsq(gram + np.diag(penalty), gradient, rcond=None)[0]
        beta = beta + moved
    return LinearModel(beta[:-1], float(beta[-1]), taken, norm)


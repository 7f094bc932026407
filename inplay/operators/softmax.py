"""Multinomial regression with row weights: gradients of row blocks as matrix products in the tasks, steps in the driver."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from itertools import chain
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

PIECE = 1 << 16  # rows a task holds as one
BLOCK = 1 << 11  # rows whose class scores are held at once
MEMORY = 10  # steps that the curvature is guessed from
TOLERANCE = 1e-6  # of the loss, relative


@dataclass
class Softmax:
    """Class scores (x - mean) * scale @ coefficients + intercepts."""

    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    intercepts: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) * self.scale) @ self.coefficients + self.intercepts
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


@dataclass
class Piece:
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray

    def moments(self) -> np.ndarray:
        x, w = self.x.astype(float), self.w
        return np.stack([w @ x, w @ (x * x)])

    def loss(self, model: Softmax) -> np.ndarray:
        """The sum of weighted losses, then its gradient by intercept and by coefficient."""
        d, k = model.coefficients.shape
        total, out = 0.0, np.zeros((d + 1, k))
        mean, scale = model.mean.astype(np.float32), model.scale.astype(np.float32)
        coefficients, intercepts = model.coefficients.astype(np.float32), model.intercepts.astype(np.float32)
        for at in range(0, len(self.y), BLOCK):
            x, y, w = (v[at:at + BLOCK] for v in (self.x, self.y, self.w))
            x, own = (x - mean) * scale, np.arange(len(y))
            z = x @ coefficients + intercepts
            z -= z.max(1, keepdims=True)
            log_p = z[own, y].astype(float)
            np.exp(z, out=z)
            sums = z.sum(1, keepdims=True)
            total += float(w @ (np.log(sums[:, 0].astype(float)) - log_p))
            z /= sums
            z[own, y] -= 1
            z *= w.astype(np.float32)[:, None]
            out[0] += z.sum(0)
            out[1:] += x.T @ z
        return np.concatenate([[total], out.ravel()])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        part += [batch] if batch is not None and batch.num_rows else []
        if sum(b.num_rows for b in part) >= (PIECE if batch is not None else 1):
            table = pa.Table.from_batches(part).combine_chunks()
            n = table.num_rows
            x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float32)
            one = Piece(x, table.column("label").to_numpy().astype(np.int64), table.column("w").to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(one)], pa.binary())], names=["rows"])
            part = []


def minimum(value: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, iterations: int) -> np.ndarray:
    """Where value (with its gradient) is least, by steps of a limited memory of its curvature (L-BFGS); a step is halved until
    the loss falls enough. One value a step, as a rule."""
    now, g = value(at)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        way, parts = -g, []
        for s, y in reversed(steps):
            parts.append((s @ way) / (s @ y))
            way = way - parts[-1] * y
        if steps:
            s, y = steps[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(parts)):
            way = way + (a - (y @ way) / (s @ y)) * s
        slope, size = float(g @ way), 1.0 if steps else min(1.0, 1 / max(np.linalg.norm(g), 1e-12))
        for _ in range(20):
            new, g_new = value(at + size * way)
            if new <= now + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return at
        s, y = size * way, g_new - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        at, g, last, now = at + s, g_new, now, new
        if last - now <= TOLERANCE * max(abs(now), 1e-12):
            break
    return at


def fit(frame: DataFrame, weight: str = "w", iterations: int = 50, ridge: float = 1e-4) -> Softmax:
    """Multinomial regression of `label` (0, 1, ...) on the array `x`, with row weights and a ridge on the coefficients of
    standardised features. The executors keep all rows in pieces, with features of four bytes; a job a step adds up their
    gradients, classes x (features + 1) numbers whatever the number of rows. Features must not be null or NaN."""
    spark = frame.sparkSession
    data = frame.select("x", F.col("label").cast("bigint").alias("label"), F.col(weight).cast("double").alias("w"))
    data = data.repartition(spark.sparkContext.defaultParallelism)
    pieces = data.mapInArrow(_pieces, "rows binary").rdd.map(lambda r: pickle.loads(r["rows"])).persist(StorageLevel.MEMORY_AND_DISK_DESER)

    def weights(p: Piece) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(p.y, p.w), p.moments()

    def both(a, b):
        longer, shorter = sorted((a[0], b[0]), key=len, reverse=True)
        return longer + np.pad(shorter, (0, len(longer) - len(shorter))), a[1] + b[1]

    classes, moments = pieces.map(weights).reduce(both)
    total = classes.sum()
    mean = moments[0] / total
    spread = np.sqrt(np.maximum(moments[1] / total - mean * mean, 0))
    varies = spread > 1e-6 * np.maximum(np.abs(mean), 1e-6)
    scale = np.where(varies, 1 / np.where(varies, spread, 1), 0)
    shape = (len(mean) + 1, len(classes))
    start = np.zeros(shape)
    start[0] = np.log1p(classes) - np.log1p(classes).mean()

    def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
        b = flat.reshape(shape)
        model = Softmax(mean, scale, b[1:], b[0])
        got = pieces.map(lambda p: p.loss(model)).reduce(np.add) / total
        if not math.isfinite(got[0]):
            raise ValueError("features or weights hold missing values")
        g = got[1:].reshape(shape).copy()
        g[1:] += ridge * b[1:]
        return got[0] + ridge / 2 * float((b[1:] ** 2).sum()), g.ravel()

    best = minimum(value, start.ravel(), iterations).reshape(shape)
    pieces.unpersist()
    return Softmax(mean, scale, best[1:], best[0])


def probability(model: Softmax, x: Column, label: Column) -> Column:
    """Probability of each row's own class; the model travels with the task."""

    @F.pandas_udf(DoubleType())
    def score(rows: pd.Series, labels: pd.Series) -> pd.Series:
        out = np.zeros(len(rows))
        for at in range(0, len(rows), BLOCK):
            p = model.probabilities(np.stack([np.asarray(r, float) for r in rows[at:at + BLOCK]]))
            out[at:at + BLOCK] = p[np.arange(len(p)), labels[at:at + BLOCK].to_numpy()]
        return pd.Series(out)

    return score(x, label)

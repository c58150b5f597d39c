"""Multinomial logistic regression over hashed words, trained and applied where the rows are.

A text's features are its words' and neighbouring pairs' hashes in ``BUCKETS``, each once, over the root of their number. The loss is the mean
of -log p(label) plus a ridge; L-BFGS steps need a gradient each, to which every task adds its rows in numpy, and which is
summed over tasks in Spark, block by block. What comes to the driver is one gradient (buckets x classes, whatever the rows). The table of features is written once, as
lists of bucket numbers; scoring is one pass with the weights as a bounded broadcast.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethewise.functions import text as tx
from lethewise.tables import written

from .context import pairs_of

BUCKETS, RIDGE, STEPS, MEMORY, BLOCK = 1 << 13, 1e-3, 40, 8, 512
#: Rows that a task works on at once.
ROWS = 2048


def hashed(text: str | Column, buckets: int = BUCKETS) -> Column:
    """The distinct buckets of a text's words and neighbouring pairs, in the JVM."""
    words = tx.words(text)
    both = F.concat(words, F.transform(pairs_of(words), lambda p: F.concat_ws(" ", p["prev"], p["token"])))
    return F.array_distinct(F.transform(both, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")))


def _sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each feature."""
    sizes = np.diff(np.asarray(column.offsets))
    cols = np.asarray(column.flatten())
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, cols, np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)


def _logits(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """[row, class]; the last row of the weights is the bias."""
    out = np.empty((n, weights.shape[1]))
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(rows, values * weights[cols, k], minlength=n) + weights[-1, k]
    return out


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


class Classifier:
    """``weights`` [buckets + 1, classes] for the labels 0, 1, ..."""

    def __init__(self, weights: np.ndarray, losses: list[float]):
        self.weights, self.losses = weights, losses
        self.buckets = len(weights) - 1

    def probabilities(self, df: DataFrame, text: str, name: str = "prob") -> DataFrame:
        """``df`` with the probability of each class, an array. A null or empty text has the bias alone."""
        spark = df.sparkSession
        weights = spark.sparkContext.broadcast(self.weights)
        rest = df.columns

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    z = _logits(*_sparse(some.column("_features")), some.num_rows, weights.value)
                    p = np.exp(_log_softmax(z))
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), listed], names=[*rest, name])

        featured = df.withColumn("_features", hashed(text, self.buckets))
        return featured.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def loss_and_gradient(data: DataFrame, weights: np.ndarray, ridge: float) -> tuple[float, np.ndarray, int]:
    """Of rows (features, label): the mean loss with the ridge, its gradient, and the number of rows."""
    shipped = data.sparkSession.sparkContext.broadcast(weights)
    shape = weights.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, grad = shipped.value, np.zeros(2), np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                n, label = some.num_rows, np.asarray(some.column("label"))
                rows, cols, values = _sparse(some.column("features"))
                lp = _log_softmax(_logits(rows, cols, values, n, w))
                off = np.exp(lp)
                off[np.arange(n), label] -= 1
                for k in range(shape[1]):
                    grad[:-1, k] += np.bincount(cols, values * off[rows, k], minlength=shape[0] - 1)
                grad[-1] += off.sum(0)
                total += [n, -lp[np.arange(n), label].sum()]
        flat = np.concatenate([total, grad.ravel()])
        cut = [flat[k : k + BLOCK] for k in range(0, len(flat), BLOCK)]
        some = [k for k, x in enumerate(cut) if x.any()]
        yield pa.RecordBatch.from_pydict({"block": pa.array(some, pa.int32()), "body": pa.array([cut[k].tobytes() for k in some], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(body)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "body": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    parts = data.mapInArrow(work, "block int, body binary").repartition("block").mapInArrow(added, "block int, body binary").collect()
    shipped.unpersist()
    flat = np.zeros(2 + weights.size)
    for r in parts:
        x = np.frombuffer(r.body)
        flat[r.block * BLOCK : r.block * BLOCK + len(x)] += x
    n = max(flat[0], 1)
    penalty = weights.copy()
    penalty[-1] = 0  # the bias is free
    return flat[1] / n + ridge / 2 * float((penalty**2).sum()), flat[2:].reshape(shape) / n + ridge * penalty, int(flat[0])


def minimized(of: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = STEPS, memory: int = MEMORY, tolerance: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with halving of steps that don't lower the loss enough; ends when the gradient is small."""
    x, (loss, grad) = start, of(start)
    losses, past = [loss], deque(maxlen=memory)
    for _ in range(steps):
        if np.abs(grad).max() <= tolerance * max(1.0, np.abs(x).max()):
            break
        way, held = grad.copy(), []
        for s, y, r in reversed(past):
            a = r * (s * way).sum()
            way -= a * y
            held.append(a)
        if past:
            s, y, r = past[-1]
            way *= 1 / (r * (y * y).sum())
        else:
            way /= max(np.sqrt((grad**2).sum()), 1e-12)
        for (s, y, r), a in zip(past, reversed(held), strict=True):
            way += s * (a - r * (y * way).sum())
        slope, size = (grad * way).sum(), 1.0
        for _ in range(20):
            new = x - size * way
            new_loss, new_grad = of(new)
            if new_loss <= loss - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - x, new_grad - grad
        if (s * y).sum() > 1e-12:
            past.append((s, y, 1 / (s * y).sum()))
        x, loss, grad = new, new_loss, new_grad
        losses.append(loss)
    return x, losses


def train(df: DataFrame, text: str, label: str, classes: int = 2, buckets: int = BUCKETS, ridge: float = RIDGE, steps: int = STEPS) -> Classifier:
    """From rows with a label 0 .. classes - 1 (others and nulls are left out). The loss is convex, so where it begins does not
    matter; without a row all classes are alike."""
    rows = df.where(F.col(label).between(0, classes - 1)).select(hashed(text, buckets).alias("features"), F.col(label).cast("int").alias("label"))
    data = written(rows, "features")
    weights, losses = minimized(lambda w: loss_and_gradient(data, w, ridge)[:2], np.zeros((buckets + 1, classes)), steps)
    return Classifier(weights, losses)

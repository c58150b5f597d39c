"""Whitening of embeddings by randomised principal components.

A vector's entries c become whole numbers x = floor(64 c) + 1,000,000; the fit list is each distinct x vector once, so
copies carry no weight. Its leading covariance directions come from a random start of ``COMPONENTS`` + ``OVERSAMPLED``
directions, multiplied by the covariance in ``POWER_PASSES`` passes over all centred rows and made orthonormal after each;
the covariance within the directions then gives components (Rayleigh-Ritz). If a component's residual is
over ``TOLERANCE`` of its distance to the next eigenvalue, the directions are expanded to all dimensions, where the same
step gives eigenvectors to rounding.

A pass centres rows before it multiplies, and adds up one matrix per task in Spark; what comes to the driver is one matrix
of dimension x directions whatever the number of rows (dimension squared at most: 128 MB at ``MAX_DIMENSION``). The
fit list is written once, as eight bytes an entry, and read by every pass. Equal vectors are combined before they are
shuffled, so a vector that a third of all rows hold is no burden.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are dropped; vectors of different
lengths are an error; an empty table, or one without variance, has no components and gives no rows; directions whose
eigenvalue is rounding (under 1e-12 of the trace) are no components; repeated rows each get their rows; entries over
2**40 count as 2**40; a deviation beyond 64 bits is null. Columns of the input but the vector are kept (those named as in
``ADDED``, in any case of letters, give way).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

COMPONENTS, OVERSAMPLED, POWER_PASSES, TOLERANCE = 16, 10, 3, 1e-11
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**40
MAX_DIMENSION = 4096
#: Rows that a pass multiplies at once.
ROWS = 1 << 13
ADDED = ["n", "component", "deviation", "whitened", "explained", "identity_error"]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _whole_numbers(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Which rows stay, and the x vectors of those as bytes."""
    column = column.cast(pa.list_(pa.float64())) if not pa.types.is_large_list(column.type) else column.cast(pa.large_list(pa.float64()))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    values = column.flatten()  # those of null rows are left out
    c = np.asarray(pc.fill_null(values, float("nan")), np.float64)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    x = np.floor(SCALE * np.clip(np.where(np.isfinite(c), c, 0), -LARGEST, LARGEST)).astype("<i8") + SHIFT
    return good, [x[e - s : e].tobytes() for s, e in zip(sizes[good].tolist(), ends[good].tolist(), strict=True)]


def prepared(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows with a usable vector, which becomes the bytes of its whole numbers, eight each."""
    rest = [c for c in vectors.columns if c != vector]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            good, x = _whole_numbers(batch.column(vector))
            kept = batch.select(rest).filter(pa.array(good)) if rest else None
            yield pa.RecordBatch.from_arrays([*(kept.columns if rest else []), pa.array(x, pa.binary())], names=[*rest, vector])

    schema = T.StructType([*vectors.select(*rest).schema.fields, T.StructField(vector, T.BinaryType())])
    return vectors.select(*rest, vector).mapInArrow(work, schema)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dimension)


class Fit:
    """The fit list with its number of vectors and their sums, and passes over it."""

    def __init__(self, vectors: DataFrame, vector: str):
        x = vectors.select(F.col(vector).alias("x")).distinct()
        self.rows = storage.written(x, "fit")
        sizes = [r[0] for r in self.rows.select(F.octet_length("x")).distinct().limit(2).collect()]
        if len(sizes) > 1:
            raise ValueError("vectors of different lengths")
        self.dimension = sizes[0] // 8 if sizes else 0
        if self.dimension > MAX_DIMENSION:
            raise ValueError(f"vectors of more than {MAX_DIMENSION} entries")
        self.n = self.rows.count() if sizes else 0
        self.sums = self._added(1, lambda x: x.sum(0)[:, None].astype(object), "decimal(38,0)")[:, 0] if self.n else np.zeros(0, object)

    @property
    def mean(self) -> np.ndarray:
        return np.array([int(s) / self.n for s in self.sums])

    def _added(self, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
        """The sum over the fit list of matrices (as many rows as ``of`` gives, ``width`` columns): each task adds up its own
        rows, the cells of all tasks are added up in Spark."""
        dimension, exact = self.dimension, kind != "double"

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in _batches(batches):
                if batch.num_rows:
                    part = of(_matrix(batch.column(0), dimension))
                    total = part if total is None else total + part
            if total is not None:
                flat = total.ravel()
                value = pa.array([str(v) for v in flat]) if exact else pa.array(flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), value], names=["cell", "value"])

        cells = self.rows.mapInArrow(work, f"cell long, value {'string' if exact else 'double'}").groupBy("cell").agg(F.sum(F.col("value").cast(kind)).alias("value")).orderBy("cell").collect()
        return np.array([int(r.value) if exact else r.value for r in cells], object if exact else np.float64).reshape(-1, width)

    def times_covariance(self, directions: np.ndarray) -> np.ndarray:
        """The covariance times the directions: rows are centred, projected, and multiplied back."""
        mean = self.mean

        def of(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ directions)

        return self._added(directions.shape[1], of) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(self._added(1, lambda x: np.square(x - mean).sum(0)[:, None]).sum() / self.n)

    def whitened_error(self, project: np.ndarray) -> float:
        """The largest entry by which the covariance of the whitened fit list is off the identity."""
        mean, k = self.mean, project.shape[1]

        def of(x: np.ndarray) -> np.ndarray:
            y = (x - mean) @ project
            return np.concatenate([y.T @ y, y.sum(0)[None]])

        got = self._added(k, of) / self.n
        return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def components(fit: Fit, wanted: int = COMPONENTS, seed: int = 42) -> tuple[np.ndarray, np.ndarray, bool]:
    """Eigenvalues by falling size, unit eigenvectors as columns, and whether all dimensions were needed."""
    d = fit.dimension
    width = min(d, wanted + OVERSAMPLED)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for _ in range(POWER_PASSES if width < d else 0):
        q = np.linalg.qr(fit.times_covariance(q))[0]
    values, vectors, residual, gap = _ritz(q, fit.times_covariance(q), wanted)
    if width < d and not np.all(residual <= TOLERANCE * gap):
        q = np.eye(d)
        values, vectors, _, _ = _ritz(q, fit.times_covariance(q), wanted)
        width = d
    return values, vectors, width == d


def _ritz(q: np.ndarray, z: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From an orthonormal basis and its product with the covariance: eigenvalues and vectors within the basis, how far
    each is from being one outright, and its distance to the nearest other eigenvalue of the basis."""
    inner = q.T @ z
    values, inside = np.linalg.eigh((inner + inner.T) / 2)
    values, inside = values[::-1], inside[:, ::-1]
    residual = np.linalg.norm(z @ inside - (q @ inside) * values, axis=0)
    step = np.concatenate([[np.inf], values[:-1] - values[1:], [np.inf]])
    gap = np.minimum(step[:-1], step[1:])
    vectors = q @ inside
    return values[:wanted], vectors[:, :wanted] / np.linalg.norm(vectors[:, :wanted], axis=0), residual[:wanted], gap[:wanted]


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Per row, the sum over dimensions of (n x - S) squared; exact, in whole numbers of 64 bits where they hold it."""
    low, high = x.min(0, initial=0), x.max(0, initial=0)
    largest = max((max(abs(n * int(a) - int(s)), abs(n * int(b) - int(s))) for a, b, s in zip(low, high, sums, strict=True)), default=0)
    if largest * largest * x.shape[1] < 1 << 63 and max(map(abs, map(int, sums)), default=0) < 1 << 63 and n * int(np.abs(x).max(initial=0)) < 1 << 63:
        return np.square(n * x - sums.astype(np.int64)).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, vector: str = "embedding", wanted: int = COMPONENTS, seed: int = 42) -> DataFrame:
    """Rows of ``vectors`` that stay, without the vector, once for each component: ``component`` (from 1, by falling
    eigenvalue), ``n`` of the fit list, ``deviation``, ``whitened``, ``explained`` (the eigenvalue's share of the trace) and
    ``identity_error``. The fit is made at once; the rows follow lazily."""
    return storage.apart(vectors, ADDED, lambda rows: _whitened(rows, wanted, seed), _vector=vector)


def _whitened(vectors: DataFrame, wanted: int, seed: int) -> DataFrame:
    ready = prepared(vectors, "_vector")
    rest = [c for c in ready.columns if c != "_vector"]
    made = [T.StructField("n", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))]
    schema = T.StructType([*ready.select(*rest).schema.fields, *made])
    fit = Fit(ready, "_vector")
    trace = fit.trace() if fit.n else 0.0
    if not trace:
        return vectors.sparkSession.createDataFrame([], schema)
    values, directions, _ = components(fit, wanted, seed)
    real = values > 1e-12 * trace
    values, directions = values[real], directions[:, real]
    project, n, sums, mean, dimension = directions / np.sqrt(values), fit.n, fit.sums, fit.mean, fit.dimension
    error, share, k = fit.whitened_error(project), values / trace, len(values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            if not batch.num_rows:
                continue
            x, m = _matrix(batch.column("_vector"), dimension), batch.num_rows
            of = np.repeat(np.arange(m), k)
            repeated = [batch.column(c).take(pa.array(of)) for c in rest]
            new = [
                pa.array(np.full(m * k, n, np.int64)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(of)),
                pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays([*repeated, *new], names=[*rest, *ADDED])

    return ready.mapInArrow(work, schema)

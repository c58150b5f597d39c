"""Vectors in array columns: softmax and its kin, filters and compositions of logits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once. (What a lambda names from outside is worked out anew for every
    element, so that a norm or a maximum within one would cost the square of the length.)"""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Vector:
    return v.cast("array<double>")


def total(v: Vector) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Vector, b: Vector) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Vector, b: Vector) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a) * dot(b, b)), F.lit(1e-12))


def lp_norm(v: Vector, p: float) -> Column:
    """The norm of order 1, 2 or infinity."""
    if p == 1:
        return total(F.transform(v, F.abs))
    if p == 2:
        return F.sqrt(dot(v, v))
    if p == float("inf"):
        return F.array_max(F.transform(v, F.abs))
    raise ValueError(f"no norm of order {p}")


def l2_normalized(v: Vector) -> Vector:
    return let(v, lambda v: let(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda size: F.transform(v, lambda x: x / size)))


def logsumexp(v: Vector) -> Column:
    return let(v, lambda v: let(F.array_max(v), lambda top: top + F.ln(total(F.transform(v, lambda x: F.exp(x - top))))))


def log_softmax(v: Vector) -> Vector:
    return let(v, lambda v: let(logsumexp(v), lambda z: F.transform(v, lambda x: x - z)))


def softmax(v: Vector) -> Vector:
    return F.transform(log_softmax(v), F.exp)


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def relative_top_mask(logits: Vector, share: float) -> Column:
    """True where a log-probability is under the filter: below both the k-th largest (k = share of the size, one at
    least) and the largest plus ln(share)."""
    k = F.greatest(F.floor(F.size(logits) * F.lit(float(share))).cast("int"), F.lit(1))

    def masked(logp: Vector) -> Column:
        limit = F.least(F.get(F.sort_array(logp, asc=False), k - 1), F.array_max(logp) + F.ln(F.lit(float(share))))
        return let(limit, lambda low: F.transform(logp, lambda x: x < low))

    return let(log_softmax(logits), masked)


def composed(base: Vector, assistants: list[tuple[Vector, float]], mask: Column | None = None) -> Vector:
    """base + the sum of w * assistant; an assistant adds nothing where the base is masked."""

    def add(sum_: Vector, part: tuple[Vector, float]) -> Vector:
        vector, weight = part
        if mask is None:
            return F.zip_with(sum_, vector, lambda a, b: a + b * weight)
        kept = F.zip_with(vector, mask, lambda x, m: F.when(m, 0.0).otherwise(x * weight))
        return F.zip_with(sum_, kept, lambda a, b: a + b)

    return reduce(add, assistants, base)


def decoding_scores(base: Vector, assistants: list[tuple[Vector, float]], share: float = 0.0, masked: float = -1e3) -> Vector:
    """Scores of a decoding step: with the filter on, masked places get a constant; with it off, every operand becomes
    log-probabilities first."""
    if share <= 0:
        return composed(log_softmax(base), [(log_softmax(v), w) for v, w in assistants])
    mask = relative_top_mask(base, share)
    return F.zip_with(composed(base, assistants, mask), mask, lambda x, m: F.when(m, F.lit(masked)).otherwise(x))


def greedy(scores: Vector, mask: Column | None = None) -> Column:
    """The place of the largest score, the lowest of equals; masked places never win."""
    if mask is not None:
        scores = F.zip_with(scores, mask, lambda x, m: F.when(m, F.lit(float("-inf"))).otherwise(x))
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def sampled(scores: Vector, uniform: Column) -> Column:
    """A draw from the softmax by inverse distribution function, for a number in [0, 1)."""

    def place(p: Vector) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"))
        end = F.aggregate(p, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["below"] + F.when(s["sum"] + x <= uniform, 1).otherwise(0)).alias("below")))
        return F.least(end["below"], F.size(p) - 1)

    return let(softmax(scores), place)

"""Statistics over distributed samples, and scalar ones on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethewise.operators.ranks import running_sums

EPS = 1e-10


def harmonic_mean(value: Column) -> Column:
    """Aggregate: n / sum(1 / v); 0 if any value is 0, an error if one is negative, null of no value."""
    bad = F.max(F.when(value < 0, 1).otherwise(0)) > 0
    zero = F.max(F.when(value == 0, 1).otherwise(0)) > 0
    mean = F.count(value) / F.sum(F.when(value != 0, 1 / value))
    return F.when(bad, F.raise_error(F.lit("a harmonic mean takes no negative value")).cast("double")).when(zero, F.lit(0.0)).otherwise(mean)


def relative_change(score: Column, reference: Column) -> Column:
    """Per cent by which a score is off a reference."""
    return (score - reference) / (reference + F.lit(EPS)) * 100


def privacy_leakage(auc: Column, reference: Column) -> Column:
    """The relative change of 1 - AUC."""
    return relative_change(1 - auc, 1 - reference)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve of ``score`` for ``label`` 1 against 0, ties counted half.

    Scores are reduced to distinct values with their two counts before they are ordered, so ties cost one row.
    """
    tied = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n0"))
    ranked = running_sums(tied, "s", {"upto": F.col("n0")})
    wins = F.sum(F.col("n1") * (F.col("upto") - F.col("n0") / 2.0))
    return ranked.agg((wins / (F.sum("n1").cast("double") * F.sum("n0").cast("double"))).alias("auc"))


def ks_statistic(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: the largest distance between the empirical distributions of ``value`` where ``group`` is 0 and 1, and the
    numbers of values."""
    tied = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.sum(F.when(F.col(group) == 0, 1).otherwise(0)).alias("k0"), F.sum(F.when(F.col(group) == 0, 0).otherwise(1)).alias("k1"))
    summed = running_sums(tied, "x", {"c0": F.col("k0"), "c1": F.col("k1")})
    one = summed.agg(F.sum("k0").alias("n0"), F.sum("k1").alias("n1"))
    far = F.max(F.abs(F.col("c0") / F.col("n0") - F.col("c1") / F.col("n1")))
    return summed.join(F.broadcast(one)).groupBy("n0", "n1").agg(far.alias("ks")).select("ks", "n0", "n1")


def lower_median(df: DataFrame, value: str) -> DataFrame:
    """One row: of an even number of values the lower of the two in the middle, in the column's own type."""
    tied = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ranked = running_sums(tied, value, {"upto": F.col("n")})
    total = tied.agg(F.sum("n").alias("total"))
    return ranked.join(F.broadcast(total)).where(F.col("upto") * 2 >= F.col("total")).agg(F.min(value).alias("median"))


def ks_pvalue(d: float, n1: int, n2: int, exact_below: int = 10_000) -> float:
    """Two-sided p-value of a two-sample KS distance: exact by counting lattice paths that stay within the distance while
    the larger sample has at most ``exact_below`` values, else from Kolmogorov's series."""
    if n1 == 0 or n2 == 0:
        return math.nan
    if max(n1, n2) > exact_below:
        en = n1 * n2 / (n1 + n2)
        x = math.sqrt(en) * d
        if x < 0.2:
            return 1.0
        return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
    import numpy as np

    g = math.gcd(n1, n2)
    h = round(d * n1 * n2 / g)  # the distance in steps of g / (n1 n2)
    if h == 0:
        return 1.0
    a, b = n1 // g, n2 // g
    # share of paths from (0, 0) to (n1, n2) that never reach a distance of h, row by row, scaled to probabilities
    j = np.arange(n2 + 1)
    inside = np.abs(-j * a) < h
    row = np.where(np.cumprod(inside), 1.0, 0.0)
    scale = 0.0  # natural logarithm of what row was divided by
    for i in range(1, n1 + 1):
        inside = np.abs(i * b - j * a) < h
        new = np.zeros_like(row)
        live = np.flatnonzero(inside)
        if not len(live):
            return 1.0
        lo, hi = live[0], live[-1] + 1
        new[lo:hi] = np.cumsum(row[lo:hi])
        top = new.max()
        if top == 0:
            return 1.0
        row, scale = new / top, scale + math.log(top)
    if row[-1] == 0:
        return 1.0
    whole = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    return max(0.0, min(1.0, 1 - math.exp(math.log(row[-1]) + scale - whole)))


def memory_columns(forget_prob: Column, forget_rouge: Column, forget_truth: Column, utility: Column, floor: float = 1e-6) -> tuple[Column, Column]:
    """As ``memory_aggregate``, of columns; null if any part is."""

    def hm(*v: Column) -> Column:
        return len(v) / sum((1 / F.greatest(x, F.lit(floor)) for x in v[1:]), 1 / F.greatest(v[0], F.lit(floor)))

    whole = forget_prob.isNotNull() & forget_rouge.isNotNull() & forget_truth.isNotNull() & utility.isNotNull()
    mem = F.when(whole, hm(1 - forget_prob, 1 - forget_rouge, forget_truth))
    return mem, F.when(whole, hm(mem, utility))


def memory_aggregate(forget_prob: float | None, forget_rouge: float | None, forget_truth: float | None, utility: float | None, floor: float = 1e-6) -> tuple[float, float] | None:
    """Harmonic means with floors: of what was forgotten, and of that and the utility; None if any part is missing."""
    if None in (forget_prob, forget_rouge, forget_truth, utility):
        return None

    def hm(*v: float) -> float:
        return len(v) / sum(1 / max(x, floor) for x in v)

    mem = hm(1 - forget_prob, 1 - forget_rouge, forget_truth)
    return mem, hm(mem, utility)

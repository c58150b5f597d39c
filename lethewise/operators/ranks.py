"""Order over a whole table without putting it into one partition.

A table is cut into ranges of its key at approximate quantiles, each range is ordered by itself, and what stands before
a range is a sum over a table with one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _below(df: DataFrame, cuts: list[float], key: Column) -> Column:
    """How many of the cuts are below a key; none for a null. In two steps of some thirty comparisons: the stretch, then
    the place in it."""
    if not cuts:
        return F.lit(0)
    step = 32
    coarse, fine = (F.lit(c).cast("array<double>") for c in (cuts[step - 1 :: step], cuts))

    def less(of: Column) -> Column:
        return F.coalesce(F.size(F.filter(of, lambda c: c < key)), F.lit(0))

    stretch = less(coarse)
    return stretch * step + less(F.slice(fine, stretch * step + 1, step))


def _as_number(df: DataFrame, column: str) -> Column:
    """A number that grows with a column (not always strictly): its own, or the first six bytes of a string."""
    if isinstance(df.schema[column].dataType, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(column).cast("double")


def _ranges(df: DataFrame, key: str, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``_range``, which grows with the numeric ``key``; a null key is in the first.

    A key that several ranges' worth of rows hold is a range of its own; with ``ties`` it is cut into as many ranges as
    its share calls for, at quantiles of the first of them (over all such keys' rows)."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = min(n, 1000)
    found = df.approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n)
    cuts = sorted(set(found))
    df = df.withColumn("_range", _below(df, cuts, F.col(key)).cast("long") * (2 * n))
    times = {c: found.count(c) for c in cuts if found.count(c) > 1}
    if not times or not ties or ties[0] == key:
        return df
    heavy = F.broadcast(df.sparkSession.createDataFrame([(float(c), t) for c, t in times.items()], "_heavy double, _times int"))
    df = df.withColumn("_tie", _as_number(df, ties[0])).join(heavy, F.col(key).cast("double") == F.col("_heavy"), "left")
    inner = sorted(set(df.where("_times is not null").approxQuantile("_tie", [i / n for i in range(1, n)], 0.25 / n)))
    part = 1 + F.floor(_below(df, inner, F.col("_tie")) * F.col("_times") / F.lit(len(inner) + 1))
    return df.withColumn("_range", F.col("_range") + F.coalesce(part.cast("long"), F.lit(0))).drop("_tie", "_heavy", "_times")


def running_sums(df: DataFrame, key: str, sums: dict[str, Column], ties: list[str] | None = None, within: str | None = None) -> DataFrame:
    """``df`` with the sum of each column over all rows whose ``key`` is as small or smaller.

    Without ``ties`` rows with equal keys get the same sums, and a key that a large share of rows holds belongs into an
    aggregate first; with it they stand in the order of those columns, each counted behind the ones before it, and such
    a key is dealt over several ranges. ``within`` sums each group of that column by itself (null is a group); a group is
    dealt over the ranges too, and there may be any number of them.
    """
    df = _ranges(df.withColumns({f"_v_{k}": v for k, v in sums.items()}), key, ties)
    groups = [F.struct(within).alias("_group")] if within else []
    by = ["_group"] if within else []
    each = df.groupBy(*groups, "_range").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    # one row for each range (of a group), some thousand at most
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    order = Window.partitionBy(*([within] if within else []), "_range").orderBy(key, *(ties or []))
    order = order.rowsBetween(Window.unboundedPreceding, 0) if ties else order.rangeBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({k: F.sum(f"_v_{k}").over(order) for k in sums}).drop(*[f"_v_{k}" for k in sums])
    out = out.withColumn("_group", F.struct(within)).join(each, ["_group", "_range"]) if within else out.join(F.broadcast(each), "_range")
    return out.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop("_range", "_group", *[f"_b_{k}" for k in sums])


def add_row_index(df: DataFrame, key: str, name: str = "index", ties: list[str] | None = None) -> DataFrame:
    """``df`` with a number 0 .. n - 1 in the order of ``key`` (then ``ties``)."""
    return running_sums(df, key, {name: F.lit(1)}, ties or [key]).withColumn(name, (F.col(name) - 1).cast("long"))


def head_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest keys."""
    return df.orderBy(key).limit(n)


def tail_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the largest keys, all if there are fewer. n may be a share of the table: rows are numbered by
    ranges, so no task holds them together."""
    return add_row_index(df, key, "_place").where(F.col("_place") >= df.count() - n).drop("_place")


def matched_tail(df: DataFrame, key: str, wanted: int, clamp: bool = True) -> DataFrame:
    """The rows with the largest keys, as many as wanted; with ``clamp`` it is an error to want more than there are,
    without it all rows come."""
    if clamp and wanted > df.count():
        raise ValueError(f"{wanted} rows wanted of fewer")
    return tail_n(df, key, wanted)


def hash_key(seed: int, *keys: str) -> Column:
    """A reproducible random order: the digest of a seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_number(seed: int, *keys: str) -> Column:
    """A reproducible random number below 2 ** 32."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("long")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, taken at random but the same every time."""
    return df.orderBy(hash_key(seed, key), key).limit(n)

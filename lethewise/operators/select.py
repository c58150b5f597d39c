"""Selecting retained rows by similarity, and composing them into roles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethewise.functions.stats import lower_median

from .ranks import running_sums

#: Vectors of a side of a tile: at 1000 numbers each, 65 MB.
BLOCK_ROWS = 1 << 13
#: Tiles along a side where the tables have enough rows for them, so that small ones are shared out too.
LEAST_TILES, LEAST_ROWS = 4, 256

_TILE = "key long, max_sim double, sum_sim double, n_pairs long"


def _unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("key").to_numpy().astype(np.int64)
    x = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
    return ids, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def similarity(rows: DataFrame, others: DataFrame, key: str = "vec_id", vector: str = "embedding", not_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row: the largest cosine to any of ``others``, the sum of all, and their number (columns key, max_sim, sum_sim,
    n_pairs). With ``not_self`` a row isn't compared with itself. Without anything to compare with, max_sim is null.

    Both sides are dealt by hash into blocks of about ``block_rows``; a tile is a block of either side, met in a shuffle.
    Each tile is matrix products of a few rows at a time, so the matrix of all pairs exists nowhere, and what it says of
    a row is combined by key. Vectors are normalised; a vector of zeros has cosine 0.
    """
    sides = [d.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")) for d in (rows, others)]

    def tiles(d: DataFrame) -> int:
        n = d.count()
        return max(1, -(-n // block_rows), min(LEAST_TILES, n // LEAST_ROWS))

    n = [tiles(d) for d in sides]
    own, their = (F.pmod(F.xxhash64("key"), F.lit(k)).cast("int") for k in n)
    every = [F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in n]
    left, right = sides[0].select("key", "v", own.alias("i"), every[1].alias("j")), sides[1].select("key", "v", every[0].alias("i"), their.alias("j"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "max_sim": pa.array([], pa.float64()), "sum_sim": pa.array([], pa.float64()), "n_pairs": pa.array([], pa.int64())})
        (ids, x), (their_ids, y) = _unit(a), _unit(b)
        best, total, pairs = np.empty(len(ids)), np.empty(len(ids)), np.full(len(ids), len(their_ids))
        for k in range(0, len(ids), 256):
            sims, at = x[k : k + 256] @ y.T, slice(k, k + 256)
            total[at] = sims.sum(1)
            if not_self:
                same = ids[at, None] == their_ids
                total[at] -= np.where(same, sims, 0).sum(1)
                pairs[at] -= same.sum(1)
                sims[same] = -np.inf
            best[at] = sims.max(1)
        return pa.table({"key": pa.array(ids), "max_sim": pa.array(best, mask=pairs == 0), "sum_sim": pa.array(total), "n_pairs": pa.array(pairs, pa.int64())})

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(tile, _TILE)
    none = sides[0].select("key", F.lit(None).cast("double").alias("max_sim"), F.lit(0.0).alias("sum_sim"), F.lit(0).cast("long").alias("n_pairs"))
    return met.unionByName(none).groupBy("key").agg(F.max("max_sim").alias("max_sim"), F.sum("sum_sim").alias("sum_sim"), F.sum("n_pairs").alias("n_pairs")).withColumnRenamed("key", key)


#: Digits to which scores are rounded before they are ranked, so that ties do not depend on the order of a sum.
RANK_DIGITS = 9


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "vec_id") -> DataFrame:
    """The k best rows, a few; of equal scores the smaller key."""
    return scored.orderBy(F.desc(F.round(score, RANK_DIGITS)), key).limit(k)


def top_share(scored: DataFrame, share: float, score: str = "score", key: str = "vec_id", name: str = "chosen") -> DataFrame:
    """All rows, with whether they are among the best share of them (of equal scores the smaller key): ranks by ranges,
    so however many are chosen no task holds them together."""
    k = top_fraction_size(share, scored.count())
    ranked = running_sums(scored.withColumn("_down", -F.round(score, RANK_DIGITS)), "_down", {"_r": F.lit(1)}, [key])
    return ranked.withColumn(name, F.col("_r") <= k).drop("_down", "_r")


def top_fraction_size(share: float, n: int) -> int:
    """max(1, share * n) rounded half to even."""
    return max(1, round(share * n))


def gated_top_k(scored: DataFrame, k: int, gate: str = "s_f", score: str = "s_r", key: str = "vec_id") -> DataFrame:
    """The k best by one score among rows whose other score is under its median; an error if there are fewer."""
    median = lower_median(scored, gate).withColumnRenamed("median", "_median")
    under = scored.join(F.broadcast(median)).where(F.col(gate) < F.col("_median")).drop("_median")
    n = under.count()
    if n < k:
        raise ValueError(f"{n} rows under the median, {k} wanted")
    return top_k(under, k, score, key)


def with_roles(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Rows of several frames with a role column; rows and duplicates are kept."""
    out = None
    for df, role in parts:
        df = df.withColumn("role", F.lit(role))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def in_set(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return df.join(chosen.select(key), key, "left_semi")


def not_in_set(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return df.join(chosen.select(key), key, "left_anti")


def compose_a1(forget: DataFrame, retain: DataFrame, chosen: DataFrame, key: str, augmented: DataFrame | None = None, perturbed: DataFrame | None = None, far: bool = True) -> DataFrame:
    """Roles of the first assistant: forget rows, their augmentations and the chosen rows are 0, the rest 1."""
    parts = [(forget, 0), (in_set(retain, chosen, key), 0)] + ([(augmented, 0)] if augmented is not None else [])
    parts += [(not_in_set(retain, chosen, key), 1)] if far else []
    return with_roles(parts + ([(perturbed, 1)] if perturbed is not None else []))


def compose_a2(forget: DataFrame, retain: DataFrame, chosen: DataFrame, key: str, perturbed: DataFrame | None = None, retain_weight: float = 1.0) -> DataFrame:
    """Roles of the second assistant: the chosen rows are 0, all others 1; without weight there is no role 1."""
    parts = [(in_set(retain, chosen, key), 0)]
    if retain_weight:
        parts += [(forget, 1), (not_in_set(retain, chosen, key), 1)] + ([(perturbed, 1)] if perturbed is not None else [])
    return with_roles(parts)


def expanded_or_doubled(forget: DataFrame, expansion: DataFrame | None) -> DataFrame:
    """Forget rows with their expansion; without one, twice."""
    return forget.unionByName(forget if expansion is None else expansion)


def union_overwrite(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; of a key in both, the new rows."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def refuse_duplicates(df: DataFrame, key: str) -> DataFrame:
    """``df``, or an error if a key occurs twice."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]!r} occurs {twice[0][1]} times")
    return df


def only_match(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Rows whose whole name matches; an error unless exactly one does."""
    found = df.where(F.col(name).rlike(f"^(?:{pattern})$"))
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} {name} matches {pattern!r}")
    return found


def mean_pool(df: DataFrame, key: str, vector: Column, weight: Column) -> DataFrame:
    """Per key, the weighted mean of vectors: sums by place, over the sum of weights (1e-6 at least)."""
    long = df.select(key, F.posexplode(vector.cast("array<double>")).alias("place", "x"), weight.cast("double").alias("w"))
    each = long.groupBy(key, "place").agg((F.sum(F.col("x") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("pooled"))

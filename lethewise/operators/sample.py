"""Pairing and interleaving with reproducible random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import hash_number


def random_partner(anchors: DataFrame, others: DataFrame, other_index: str, n_others: int, key: str, seed: int = 42) -> DataFrame:
    """Each anchor with one row of ``others`` (numbered from 0 by ``other_index``), drawn with replacement; with no
    others the partner's columns are null."""
    drawn = anchors.withColumn("_draw", F.pmod(hash_number(seed, key), F.lit(max(n_others, 1))))
    return drawn.join(others, F.col("_draw") == F.col(other_index), "left").drop("_draw")


def block_slot(index: Column, total: Column, size: int) -> Column:
    """Sort key that alternates blocks of two equal halves; n rows of an even total are numbered from 0."""
    half = F.floor(total / 2)
    h, o = F.when(index < half, 0).otherwise(1), F.when(index < half, index).otherwise(index - half)
    return F.floor(o / size) * (2 * size) + h * size + o % size


def balanced_slots(index: Column, is_short: Column, n_short: Column, n_long: Column) -> Column:
    """Place in an interleaving that puts round(long / short) longer items behind each shorter one; null for what is
    left over. Of n_short items, those stay for which items are left, and the last group may be short."""
    ratio = F.bround(n_long / n_short).cast("long")
    slot = F.when(is_short, index * (ratio + 1)).otherwise(F.floor(index / ratio) * (ratio + 1) + 1 + index % ratio)
    return F.when(~is_short & (ratio == 0), F.lit(None)).when(is_short | (F.floor(index / ratio) < n_short), slot)

"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds one row in so many; there are no more heavy keys than this, however many rows.
HEAVY_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` left-joined to ``table`` on ``key``, which is unique and not null in the table.

    ``weight`` is the table's column with the number of rows that hold the key, ``total`` the number of all rows. Keys of
    at least total / HEAVY_SHARE rows are broadcast: there can be HEAVY_SHARE of them at most. The others are joined by
    a shuffle, in which no key is large any more. Rows with a null key take part in neither and get nulls. Both inputs
    should be written tables, as they are read more than once.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    heavy = F.col(weight) * HEAVY_SHARE >= F.lit(total)
    top = F.broadcast(table.where(heavy).select(key, *values))
    known = rows.where(F.col(key).isNotNull())
    light = known.join(F.broadcast(table.where(heavy).select(key)), key, "left_anti").join(table.where(~heavy).select(key, *values), key, "left")
    blank = rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in values])
    return known.join(top, key).unionByName(light).unionByName(blank).select(*rows.columns, *values)


def salted_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left", salts: int = 16) -> DataFrame:
    """``rows`` joined to ``table`` on ``key``, each key of ``rows`` dealt over ``salts`` tasks.

    For long tables of tokens: one token may make up a few hundredths of all rows, and the table of counts is far smaller
    than the rows, so that its copies cost little.
    """
    cut = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return cut.join(copies, [key, "_salt"], how).drop("_salt")

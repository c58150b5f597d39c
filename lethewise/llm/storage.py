"""How documents go through an operator: batches of a bounded size, columns apart, tables written between steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise.session import ready
from lethewise.tables import shared_dir, written

__all__ = ["apart", "beside", "shared_dir", "small_batches", "written"]


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound what goes to a Python worker at once. The JVM and the worker each hold a batch, and a few rows of long texts
    make a large one; the operators cut batches further by themselves. Also lets the workers import this package."""
    ready(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def beside(docs: DataFrame, keep: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` of the documents, with the columns of ``docs``: all but those in ``keep`` go through it under names that
    no operator adds, and get their own names and values back."""
    names = [(c, c if c in keep else f"_col{i}") for i, c in enumerate(docs.columns)]
    return work(docs.select(*[F.col(f"`{c}`").alias(inner) for c, inner in names])).select(*[F.col(inner).alias(c) for c, inner in names])


def apart(docs: DataFrame, added: list[str], work: Callable[[DataFrame], DataFrame], **roles: str) -> DataFrame:
    """``work`` of the documents under names that no operator adds: each of ``roles`` (inner name = column of ``docs``)
    under its inner name, the others as ``_col0`` and on. The result has the columns of ``docs`` that ``work`` kept, under
    their own names again, and then those that it made; columns of ``docs`` named as one of ``added``, in any case of
    letters, give way to those."""
    gone, inner = {a.lower() for a in added}, {c: r for r, c in roles.items()}
    names = [(c, inner.get(c, f"_col{i}")) for i, c in enumerate(docs.columns) if c in inner or c.lower() not in gone]
    out = work(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names]))
    taken = {n for _, n in names}
    return out.select(*[F.col(n).alias(c) for c, n in names if n in out.columns and c.lower() not in gone], *[c for c in out.columns if c not in taken])

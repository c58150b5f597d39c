"""Connected components of a graph of links, by alternating large and small stars (Kiveris et al. 2014).

Links stay distributed: every step writes its table to the shared folder. A hub's links are never gathered; its smallest
neighbour is an aggregate, and hubs meet their links by a broadcast of provably few heavy keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, textbuf
from lethewise.operators.joins import lookup

#: Links that one task holds at once while it drops those that close a ring.
HELD_LINKS = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) with the same components as the links a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    for batch in batches:
        held.append((np.asarray(batch.column("u")), np.asarray(batch.column("v"))))
        size += batch.num_rows
        if size >= HELD_LINKS:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()
        held.clear()
    textbuf.give_back()


def _smallest(rows: DataFrame, name: str) -> DataFrame:
    """Rows (u, v) with m, the smallest v of their u."""
    rows = storage.written(rows, name)
    low = storage.written(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-low")
    return lookup(rows, low, "u", "n", rows.count())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (u, v: long) to (u, v): each linked node but the smallest of its component, and that smallest node."""
    edges = storage.written(links.mapInArrow(_thinned, "u long, v long").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the smallest node near u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both, "star").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        near = _smallest(large, "near")
        own, low = near.select("u", F.col("m").alias("v")), near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = storage.written(own.unionByName(low).distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

"""Streaming forms of resumable jobs. The reference has no stream; windows over events are an extension of ours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lethewise.tables import exists


def once_per_key(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each key once; with a time column, keys are forgotten when they can't come any more."""
    return stream.dropDuplicates(keys) if time is None else stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_results(stream: DataFrame, path: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Run ``work`` on what is new and append it; keys already at ``path`` are left out, so a batch that is run again
    after a failure writes nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        if exists(df.sparkSession, path):
            df = df.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
        work(df.dropDuplicates(keys)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_mean(stream: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean and number of values per group and window; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def dual_updates(stream: DataFrame, run: str, step: str, retain: str, epsilon: float, rate: float) -> DataFrame:
    """(run, step, dual): the dual weight of each run after every step, carried as state; steps of a batch are taken in
    their order. A run's updates build on each other, so they are one task's by nature."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dual = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("step")
        out = []
        for s, loss in zip(rows["step"], rows["retain"], strict=True):
            dual = max(0.0, dual + rate * (loss - epsilon))
            out.append((key[0], s, dual))
        state.update((dual,))
        yield pd.DataFrame(out, columns=["run", "step", "dual"])

    named = stream.select(F.col(run).cast("string").alias("run"), F.col(step).cast("long").alias("step"), F.col(retain).cast("double").alias("retain"))
    return named.groupBy("run").applyInPandasWithState(update, "run string, step long, dual double", "dual double", "append", GroupStateTimeout.NoTimeout)


def checkpointed_results(stream: DataFrame, path: str, checkpoint: str, compute: dict[str, Callable[[DataFrame], DataFrame]]) -> StreamingQuery:
    """After every batch, each metric's result over it goes to a partition of its own, as soon as it is there; a batch
    that is run again takes the place of what it wrote."""

    def batch(df: DataFrame, number: int) -> None:
        for name, f in compute.items():
            f(df).withColumns({"metric": F.lit(name), "batch": F.lit(number)}).write.partitionBy("metric", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

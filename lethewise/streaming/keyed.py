"""Keyed state for resumable jobs, on Spark's state processors with a RocksDB store.

State lives with the key, in the checkpoint: a restarted job goes on from where its last batch was committed, and no batch
reads what earlier ones have written. A key's state is one small row (keys seen) or one per open window (sums of
losses), so a hot run is folded as its rows come and never held together.

The processors need their store (``use_store``) and, in the Python workers, protobuf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Fixed value: the class of the store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    """Keep the session's streaming state in RocksDB: on disk, with changes checkpointed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _FirstOfKey(StatefulProcessor):
    """Lets the first row of a key through; forgets a key ``ttl_ms`` after it came, never without."""

    def __init__(self, fields: list[str], ttl_ms: int | None):
        self.fields, self.ttl_ms = fields, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("seen", T.BooleanType())])
        self.seen = handle.getValueState("seen", schema, self.ttl_ms) if self.ttl_ms else handle.getValueState("seen", schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        first = next(iter(rows), None)
        for _ in rows:
            pass
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield Row(**{f: first[f] for f in self.fields})

    def close(self) -> None:
        pass


def first_of_key(stream: DataFrame, keys: list[str], ttl_ms: int | None = None) -> DataFrame:
    """The first row that comes of each key, over all batches and restarts. With ``ttl_ms`` a key may come again that long
    (of processing time) after it came first, and its state goes."""
    out = stream.groupBy(*keys).transformWithState(_FirstOfKey(stream.columns, ttl_ms), stream.schema, "Append", "ProcessingTime" if ttl_ms else "None")
    return out


def append_once(stream: DataFrame, path: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame] = lambda df: df, ttl_ms: int | None = None) -> StreamingQuery:
    """Run ``work`` once on the first row of every key and keep its results under ``path``, a folder for each batch: a batch
    that is run again after a failure takes its own folder's place, so nothing is written twice or lost."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return first_of_key(stream, keys, ttl_ms).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _WindowMeans(StatefulProcessor):
    """Sums by window of event time; a timer at its end emits the means."""

    def __init__(self, time: str, values: list[str], width_ms: int):
        self.time, self.values, self.width_ms = time, values, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        sums = T.StructType([T.StructField("n", T.LongType()), *(T.StructField(f"{p}{k}", t) for k in range(len(self.values)) for p, t in (("n", T.LongType()), ("s", T.DoubleType())))])
        self.open = handle.getMapState("open", T.StructType([T.StructField("end", T.LongType())]), sums)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new: dict[int, list] = {}
        for r in rows:
            if r[self.time] is None:
                continue
            end = (int(r[self.time].timestamp() * 1000) // self.width_ms + 1) * self.width_ms
            mine = new.setdefault(end, [0, *[0, 0.0] * len(self.values)])
            mine[0] += 1
            for k, v in enumerate(self.values):
                if r[v] is not None:
                    mine[1 + 2 * k] += 1
                    mine[2 + 2 * k] += float(r[v])
        for end, mine in new.items():
            if self.open.containsKey((end,)):
                mine = [a + b for a, b in zip(mine, self.open.getValue((end,)), strict=True)]
            else:
                self.handle.registerTimer(end)
            self.open.updateValue((end,), tuple(mine))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        if self.open.containsKey((end,)):
            sums = self.open.getValue((end,))
            self.open.removeKey((end,))
            means = {v: sums[2 + 2 * k] / sums[1 + 2 * k] if sums[1 + 2 * k] else None for k, v in enumerate(self.values)}
            yield Row(run=key[0], window_end_ms=end, n_steps=sums[0], **means)

    def close(self) -> None:
        pass


def loss_log(stream: DataFrame, run: str, time: str, losses: list[str], width_ms: int = 60_000, late: str = "10 minutes") -> DataFrame:
    """(run, window_end_ms, n_steps, and the mean of each loss): per run and window of event time, once the watermark has
    passed its end. Steps later than ``late`` are left out; null losses are not in their mean, and a step without a time in none."""
    named = stream.select(F.col(run).cast("string").alias("run"), F.col(time).cast("timestamp").alias("_time"), *[F.col(c).cast("double").alias(c) for c in losses])
    schema = T.StructType([T.StructField("run", T.StringType()), T.StructField("window_end_ms", T.LongType()), T.StructField("n_steps", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in losses)])
    return named.withWatermark("_time", late).groupBy("run").transformWithState(_WindowMeans("_time", losses, width_ms), schema, "Append", "EventTime")

"""Keyed state over batches and restarts."""

import datetime as dt
import random

import pytest

from lethewise.streaming import jobs, keyed

SCHEMA = "chunk_idx int, view int, text string"


@pytest.fixture(autouse=True)
def store(spark):
    keyed.use_store(spark)
    yield
    for name in ("providerClass", "rocksdb.changelogCheckpointing.enabled"):
        spark.conf.unset(f"spark.sql.streaming.stateStore.{name}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_once_by_key_over_batches_and_restarts(spark, tmp_path):
    path, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    spark.createDataFrame([(0, 0, "a"), (0, 0, "a"), (0, 1, "b")], SCHEMA).coalesce(1).write.parquet(path)
    spark.createDataFrame([(0, 1, "again"), (1, 0, "c"), (None, 0, "n")], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    keyed.append_once(stream(spark, path, SCHEMA), out, check, ["chunk_idx", "view"]).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted((r.chunk_idx, r.view) for r in rows.where("chunk_idx is not null").collect()) == [(0, 0), (0, 1), (1, 0)] and rows.count() == 4
    spark.createDataFrame([(1, 0, "late"), (2, 0, "d"), (None, 0, "n")], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    asked = []

    def work(df):
        asked.append(df.count())
        return df

    keyed.append_once(stream(spark, path, SCHEMA), out, check, ["chunk_idx", "view"], work).awaitTermination()  # a restart
    assert sum(asked) == 1 and spark.read.parquet(out).count() == 5


def test_a_batch_that_fails_is_run_again(spark, tmp_path):
    path, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    spark.createDataFrame([(i, 0, "x") for i in range(20)], SCHEMA).coalesce(1).write.parquet(path)

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        keyed.append_once(stream(spark, path, SCHEMA), out, check, ["chunk_idx"], broken).awaitTermination()
    keyed.append_once(stream(spark, path, SCHEMA), out, check, ["chunk_idx"]).awaitTermination()
    assert sorted(r.chunk_idx for r in spark.read.parquet(out).collect()) == list(range(20))


def test_means_of_losses_by_window(spark, tmp_path):
    rng, begin = random.Random(4), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(run, s, begin + dt.timedelta(seconds=10 * s), rng.random(), rng.random() if s % 4 else None) for run in ("a", "b") for s in range(60)]
    schema = "run string, step int, at timestamp, forget double, retain double"
    path, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    for k in range(0, 60, 15):  # steps of a quarter of the time in each batch
        spark.createDataFrame([r for r in rows if k <= r[1] < k + 15], schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        log = keyed.loss_log(stream(spark, path, schema), "run", "at", ["forget", "retain"], late="0 seconds")
        log.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return {(r.run, r.window_end_ms): (r.n_steps, r.forget, r.retain) for r in spark.read.parquet(out).collect()}

    first = run()
    spark.createDataFrame([("c", 0, begin + dt.timedelta(hours=1), 1.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(path)
    got = run()
    assert len(got) == 20 and len(first) < 20 and all(got[k] == first[k] for k in first)
    for (name, end), (n, forget, retain) in got.items():
        mine = [r for r in rows if r[0] == name and (int(r[2].timestamp()) // 60 + 1) * 60_000 == end]
        assert n == len(mine) == 6 and abs(forget - sum(r[3] for r in mine) / 6) < 1e-12
        some = [r[4] for r in mine if r[4] is not None]
        assert abs(retain - sum(some) / len(some)) < 1e-12


def test_keys_forgotten_by_watermark(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1, 0, 1)), (2, dt.datetime(2024, 1, 1))], "k int, at timestamp").coalesce(1).write.parquet(path)
    once = jobs.once_per_key(stream(spark, path, "k int, at timestamp"), ["k"], "at")
    once.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]

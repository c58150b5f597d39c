"""Metric logs: nested JSON documents {metric: {"agg_value": x, "value_by_index": {item: {stat: value}}}}.

A value may be a list (one for each answer), and an attack's results lie a level deeper, by side: {metric: {"forget":
{"value_by_index": ...}, "holdout": {...}, "auc": x, "agg_value": x}}. Logs are read with Spark's text reader, so from any store
that Spark reads, and taken apart level by level; a folder of several documents is read as their union.

Writing, a log is sorted rows (path, value), of which each task streams its range into a document: braces open and close
where paths part, and nothing is put together in a row. Up to ``ITEMS`` values make one document with the given name; more
make a folder of documents of that name, each valid by itself, which the reader unites.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise.tables import exists

ITEMS = 2_000_000
#: The names of a log's fields.
AGGREGATE, BY_INDEX = "agg_value", "value_by_index"
ITEMS_SCHEMA = "metric string, side string, item bigint, answer_pos int, stat string, value double, text string"
AGGREGATES_SCHEMA = "metric string, side string, stat string, value double"

_MAP = "map<string,string>"


def _opened(text: Column) -> Column:
    """The fields of an object, each value as JSON text; none of what is no object."""
    return F.from_json(F.when(F.ltrim(text).startswith("{"), text), _MAP)


def _documents(spark: SparkSession, path: str, missing_ok: bool) -> DataFrame | None:
    """(metric, key, body): the fields of every metric's results."""
    if missing_ok and not exists(spark, path):
        return None
    metrics = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.explode(_opened(F.col("value"))).alias("metric", "results"))
    return metrics.select("metric", F.explode(_opened(F.col("results"))).alias("key", "body"))


def read_items(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Values by item, long: metric, side (null but for attacks), item, answer_pos (null but in lists), stat, value (of
    numbers) and text (of others). A log that isn't there is an error, or no rows with ``missing_ok``."""
    found = _documents(spark, path, missing_ok)
    if found is None:
        return spark.createDataFrame([], ITEMS_SCHEMA)
    whole = found.where(F.col("key") == BY_INDEX).select("metric", F.lit(None).cast("string").alias("side"), F.col("body").alias("items"))
    sides = found.where(F.col("key") != BY_INDEX).select("metric", F.col("key").alias("side"), _opened(F.col("body"))[BY_INDEX].alias("items"))
    each = whole.unionByName(sides).select("metric", "side", F.explode(_opened(F.col("items"))).alias("item", "stats"))
    each = each.select("metric", "side", F.col("item").cast("long").alias("item"), F.explode(_opened(F.col("stats"))).alias("stat", "raw"))
    listed = F.when(F.ltrim("raw").startswith("["), F.from_json("raw", "array<string>"))
    values = each.select("metric", "side", "item", "stat", F.posexplode(F.coalesce(listed, F.array("raw"))).alias("_p", "_v"), listed.isNotNull().alias("_l"))
    number = F.expr("try_cast(_v AS double)")
    return values.select("metric", "side", "item", F.when(F.col("_l"), F.col("_p")).alias("answer_pos"), "stat", number.alias("value"), F.when(number.isNull(), F.col("_v")).alias("text"))


def read_aggregates(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Numbers beside the items: metric, side, stat (``agg_value``, an attack's ``auc``), value."""
    found = _documents(spark, path, missing_ok)
    if found is None:
        return spark.createDataFrame([], AGGREGATES_SCHEMA)
    is_object = F.ltrim("body").startswith("{")
    own = found.where(~F.coalesce(is_object, F.lit(False))).select("metric", F.lit(None).cast("string").alias("side"), F.col("key").alias("stat"), "body")
    sides = found.where(is_object & (F.col("key") != BY_INDEX)).select("metric", F.col("key").alias("side"), F.explode(_opened(F.col("body"))).alias("stat", "body")).where(F.col("stat") != BY_INDEX)
    return own.unionByName(sides).select("metric", "side", "stat", F.expr("try_cast(body AS double)").alias("value")).distinct()


def _nested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of one document from rows (path, raw) in order."""
    at: list[str] = []
    waiting: str | None = None  # a line whose comma depends on what follows
    for frame in frames:
        lines: list[str] = []
        for path, raw in zip(frame["path"], frame["raw"], strict=True):
            path = list(path)
            if waiting is None:
                lines.append("{")
            same = 0
            while same < min(len(at), len(path) - 1) and at[same] == path[same]:
                same += 1
            if waiting is not None:
                closing = ["    " * (k + 1) + "}" for k in range(len(at) - 1, same - 1, -1)]
                all_lines = [waiting, *closing]
                lines += [*all_lines[:-1], all_lines[-1] + ","]
            lines += ["    " * (k + 1) + json.dumps(path[k]) + ": {" for k in range(same, len(path) - 1)]
            at, waiting = path[:-1], "    " * len(path) + json.dumps(path[-1]) + ": " + raw
        yield pd.DataFrame({"value": lines})
    if waiting is not None:
        yield pd.DataFrame({"value": [waiting, *("    " * (k + 1) + "}" for k in range(len(at) - 1, -1, -1)), "}"]})


def write_log(items: DataFrame, aggregates: DataFrame, path: str) -> None:
    """A log with the rows of ``items`` and ``aggregates`` (columns as read; of one key those with answer_pos are a list in its order),
    sorted by metric, in place of what is at ``path``."""
    spark = items.sparkSession
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    raw = F.when(F.col("value").isNotNull(), F.col("value").cast("string")).when(F.col("text").isNotNull(), quoted).otherwise(F.lit("null"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("answer_pos", "raw"))), lambda x: x["raw"]), ", ")
    each = items.withColumn("raw", raw).groupBy("metric", "side", "item", "stat").agg(F.when(F.max("answer_pos").isNull(), F.first("raw")).otherwise(F.concat(F.lit("["), listed, F.lit("]"))).alias("raw"))
    side = F.when(F.col("side").isNotNull(), F.array("side")).otherwise(F.array().cast("array<string>"))
    by_item = each.select("metric", "side", F.lit(1).alias("kind"), "item", "stat", F.concat(F.array("metric"), side, F.array(F.lit(BY_INDEX), F.col("item").cast("string"), F.col("stat"))).alias("path"), "raw")
    total = aggregates.select("metric", "side", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("item"), "stat", F.concat(F.array("metric"), side, F.array("stat")).alias("path"), F.coalesce(F.col("value").cast("string"), F.lit("null")).alias("raw"))
    rows = total.unionByName(by_item)
    n = max(1, -(-rows.count() // ITEMS))
    order = ["metric", F.col("side").asc_nulls_first(), "kind", F.col("item").asc_nulls_first(), "stat"]
    ranged = rows.repartitionByRange(n, *order) if n > 1 else rows.coalesce(1)
    lines = ranged.sortWithinPartitions(*order).select("path", "raw").mapInPandas(_nested, "value string")
    made = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"  # beside it, so that the commit only renames
    lines.write.text(made)
    _committed(spark, made, path, n == 1)


def _committed(spark: SparkSession, made: str, path: str, one: bool) -> None:
    """What was written takes the place of what is at ``path``; of a folder with one document, the document."""
    jvm = spark._jvm
    folder, target = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    source = folder
    if one:
        parts = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")]
        source = parts[0] if parts else jvm.org.apache.hadoop.fs.Path(folder, "part-0")
        if not parts:
            files.create(source).close()
    files.delete(target, True)
    if not files.rename(source, target):
        raise RuntimeError(f"can't write {path}")
    files.delete(folder, True)

"""Readers and writers of the files that unlearning experiments leave, with explicit schemas."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethewise.tables import exists

#: Column names and types of the index files.
RSUB_SCHEMA = "forget_split string, retain_split string, retain_num int, retain_slice_start int, k int, indices array<int>, max_sim array<double>"
RSUB_VARIANT_SCHEMA = "mode string, forget_split string, retain_split string, retain_num int, retain_slice_start int, k int, encoder string, indices array<int>, s_F array<double>, s_R array<double>, s_F_median_all double"
RSUB_CHUNK_SCHEMA = "split string, encoder string, llama_tokenizer string, chunk_len int, n_forget_chunks int, n_retain_chunks int, k int, rsub_indices array<int>, rfar_indices array<int>"
AUGMENTATION_SCHEMA = "chunk_idx int, view int, text string, input_chars int, output_chars int"
METRIC_ITEMS_SCHEMA = "metric string, split string, item bigint, answer_pos int, stat string, value double"
QA_SCHEMA = "question string, answer string, paraphrased_question string, paraphrased_answer string, perturbed_answer array<string>"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: value."""
    return spark.read.text(path)


def json_strings(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are JSON strings: value, the string."""
    inner = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")
    return spark.read.text(path).select(inner["v"].alias("value"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_list(text: pd.Series) -> pd.Series:
    """A list written as a Python literal; only literals are read, nothing is run. Null for anything else."""

    def read(x: str | None) -> list[str] | None:
        try:
            v = ast.literal_eval(x) if x is not None else None
        except (ValueError, SyntaxError):
            return None
        return [str(i) for i in v] if isinstance(v, (list, tuple)) else None

    return text.map(read)


def csv_lists(spark: SparkSession, path: str, lists: tuple[int, ...] = (2, 3)) -> DataFrame:
    """A CSV whose columns at these places (from 0) are list literals; names are taken from the header."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.select(*[literal_list(F.col(f"`{c}`")).alias(c) if i in lists else F.col(f"`{c}`") for i, c in enumerate(df.columns)])


def json_document(spark: SparkSession, path: str, schema: str = RSUB_SCHEMA) -> DataFrame:
    """A JSON document of one object per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def jsonl(spark: SparkSession, path: str, schema: str = AUGMENTATION_SCHEMA) -> DataFrame:
    """JSON lines; a line that can't be read is left out, as after a job that was cut off."""
    read = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(read.alias("r")).select("r.*").where("_bad is null").drop("_bad")


def qa_items(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Question and answer items; a single perturbed answer becomes a list of one."""
    df = spark.read.schema(QA_SCHEMA).json(path)
    if limit is None:
        return df
    return df.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(limit).drop("_at")  # in the file's order


def metric_log(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Results of an earlier run; if there are none, an error or, with ``missing_ok``, an empty table."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], METRIC_ITEMS_SCHEMA)
    return spark.read.schema(METRIC_ITEMS_SCHEMA).parquet(path)


def completions(df: DataFrame, client: Callable[[str], str | None], text: str = "text", to: str = "output", attempts: int = 3, wait: Callable[[float], None] | None = None) -> DataFrame:
    """``df`` with a client's answer to each text, null after ``attempts`` failures; waits double between them."""
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])

    def ask(x: str) -> str | None:
        import time

        for k in range(attempts):
            try:
                return client(x)
            except Exception:  # noqa: BLE001  any failure of a client is tried again
                if k + 1 < attempts:
                    (wait or time.sleep)(2.0**k)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{to: [None if x is None else ask(x) for x in f[text]]})

    return df.mapInPandas(run, schema)


# -- sinks ------------------------------------------------------------------------------------------------------------

def write_metric(items: DataFrame, path: str) -> None:
    """Results partitioned by metric; a metric written again takes the place of its own partition alone."""
    items.write.partitionBy("metric").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_jsonl(rows: DataFrame, path: str, keys: list[str], schema: str = AUGMENTATION_SCHEMA) -> None:
    """Append rows whose keys aren't in the file yet."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(jsonl(spark, path, schema).select(*keys), keys, "left_anti")
    rows.write.mode("append").json(path)


def write_row_csv(row: DataFrame, path: str) -> None:
    """A table of one row as CSV with a header."""
    row.coalesce(1).write.mode("overwrite").csv(path, header=True)


def _each(array: str, *fields: str) -> Column:
    """One field (of a field) of an array's structs."""
    def within(x: Column) -> Column:
        for f in fields:
            x = x[f]
        return x

    return F.transform(array, lambda x: within(x))


def _object(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def write_index(chosen: DataFrame, path: str, key: str, score: str, about: dict[str, str | int]) -> None:
    """One JSON object: the settings, sorted indices and their scores. The choice is a top-k, small by its nature."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(key).alias("i"), F.col(score).alias("s"))))
    _object(chosen.agg(listed.alias("l")).select(*[F.lit(v).alias(k) for k, v in about.items()], F.size("l").alias("k"), F.transform("l", lambda x: x["i"]).alias("indices"), F.transform("l", lambda x: x["s"]).alias("max_sim")), path)


def write_variant_index(chosen: DataFrame, path: str, key: str, s_f: str, s_r: str, median: float, about: dict[str, str | int]) -> None:
    """As ``write_index``, with both scores of each index and the median of the first over all rows."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(key).alias("i"), F.col(s_f).alias("f"), F.col(s_r).alias("r"))))
    both = {"indices": "i", "s_F": "f", "s_R": "r"}
    _object(chosen.agg(listed.alias("l")).select(*[F.lit(v).alias(k) for k, v in about.items()], F.size("l").alias("k"), *[_each("l", c).alias(n) for n, c in both.items()], F.lit(median).alias("s_F_median_all")), path)


#: Items whose statistics go to one document of an evaluation log; more make several documents, in the items' order.
LOG_ITEMS = 1_000_000


def write_eval_log(items: DataFrame, path: str, key: str, statistics: list[str]) -> None:
    """One JSON object of a split: per statistic the list of its values, by item. Each statistic's values are streamed in order,
    and none is put together in a row; over ``LOG_ITEMS`` items make several objects, a range of items each."""
    n = max(1, -(-items.count() // LOG_ITEMS))
    ranged = items.select(F.col(key).alias("_k"), *statistics).repartitionByRange(n, "_k") if n > 1 else items.select(F.col(key).alias("_k"), *statistics).coalesce(1)
    raw = [F.struct(F.lit(k).alias("_s"), F.coalesce(F.get_json_object(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), "$.v"), F.lit("null")).alias("_v")) for k, c in enumerate(statistics)]
    long = ranged.select("_k", F.inline(F.array(*raw))).sortWithinPartitions("_s", "_k")

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for f in frames:
            out = []
            for s, v in zip(f["_s"], f["_v"], strict=True):
                if s != at:
                    out.append(("{" if at is None else "],") + json.dumps(statistics[s]) + ": [" + v)
                    at = s
                else:
                    out.append("," + v)
            yield pd.DataFrame({"value": out})
        if at is not None:
            yield pd.DataFrame({"value": ["]}"]})

    long.select("_s", "_v").mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def write_metadata(spark: SparkSession, path: str, config: dict, counts: dict[str, DataFrame]) -> None:
    """One JSON object: a run's settings, and the number of rows of each of its tables."""
    row = spark.range(1).select(F.lit(json.dumps(config, sort_keys=True)).alias("config"))
    for name, df in counts.items():
        row = row.crossJoin(F.broadcast(df.agg(F.count("*").alias(f"n_{name}"))))
    _object(row, path)


def append_result(spark: SparkSession, path: str, result: dict, schema: str) -> None:
    """Append the row of one configuration to a CSV; what it lacks, as after a failure, is null."""
    spark.createDataFrame([tuple(result.get(f.name) for f in T.StructType.fromDDL(schema).fields)], schema).coalesce(1).write.mode("append").option("nullValue", "").csv(path, header=True)


def write_profile(report: DataFrame, events: DataFrame, path: str) -> None:
    """A profile's report as CSV, longest total first, and the events that it was made of as JSON lines."""
    report.orderBy(F.desc("total_s")).coalesce(1).write.mode("overwrite").csv(f"{path}/report", header=True)
    events.write.mode("overwrite").json(f"{path}/events")

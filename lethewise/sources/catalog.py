"""Named datasets: handlers by class name, and splits by role."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, metric_logs

HANDLERS: dict[str, Callable[..., DataFrame]] = {
    "parquet": lambda spark, path, **_: spark.read.parquet(path),
    "qa": files.qa_items,
    "lines": files.text_lines,
    "json_strings": files.json_strings,
    "csv_lists": files.csv_lists,
    "json": files.json_document,
    "jsonl": files.jsonl,
    "metric_log": files.metric_log,
    "metric_log_json": metric_logs.read_items,
}


def register(name: str, handler: Callable[..., DataFrame]) -> None:
    HANDLERS[name] = handler


def load(spark: SparkSession, specs: dict[str, dict]) -> dict[str, DataFrame]:
    """Datasets by name or, where a spec has one, by ``access_key``; each spec names its ``handler`` and its arguments."""
    out = {}
    for name, spec in specs.items():
        args = {k: v for k, v in spec.items() if k not in ("handler", "access_key")}
        if spec["handler"] not in HANDLERS:
            raise NotImplementedError(f"no dataset handler {spec['handler']!r}")
        out[spec.get("access_key", name)] = HANDLERS[spec["handler"]](spark, **args)
    return out


def assemble(splits: dict[str, DataFrame], mode: str) -> dict[str, DataFrame]:
    """``train``: the splits as they are. ``unlearn``: all but eval and test become one table with a split column."""
    if mode == "train":
        return splits
    if mode != "unlearn":
        raise ValueError(f"no mode {mode!r}")
    from pyspark.sql import functions as F

    parts = [df.withColumn("split", F.lit(n)) for n, df in splits.items() if n not in ("eval", "test")]
    train = parts[0]
    for p in parts[1:]:
        train = train.unionByName(p, allowMissingColumns=True)
    return {"train": train} | {n: df for n, df in splits.items() if n in ("eval", "test")}

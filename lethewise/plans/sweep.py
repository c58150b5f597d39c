"""Grids of settings, and reports over their results."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations, numbered in their order; a grid of settings is made on the driver."""
    rows = [(*c, i) for i, c in enumerate(product(*(sorted(v) for v in axes.values())))]
    return spark.createDataFrame(rows, [*axes, "config"])


def grid_of(results: DataFrame, axes: list[str], most: int = 1000) -> DataFrame:
    """All combinations of the values that occur on each axis of a table of results, numbered in their order (``config``);
    ``most`` values an axis can have at most, which is checked."""
    out, number = None, F.lit(0).cast("long")
    for axis in axes:
        values = results.select(axis).where(F.col(axis).isNotNull()).distinct()
        n = values.limit(most + 1).count()
        if n > most:
            raise ValueError(f"{axis} has over {most} values")
        own = values.withColumn(f"_{axis}", F.row_number().over(Window.orderBy(axis)) - 1)  # of a checked size
        out = own if out is None else out.crossJoin(F.broadcast(own))
        number = number * n + F.col(f"_{axis}")
    return out.select(*axes, number.alias("config"))


def top_results(results: DataFrame, metric: str, n: int = 5, key: str = "config") -> DataFrame:
    """The n best rows; rows without a value take no part."""
    return results.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), key).limit(n)


def cell(value: float | None) -> str:
    """A number for a report: a dash for none, scientific if it is small, else four digits."""
    if value is None:
        return "—"
    return f"{value:.2e}" if value != 0 and abs(value) < 0.01 else f"{value:.4f}"


def markdown(rows: list[dict], columns: list[str]) -> str:
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    body = ["| " + " | ".join(cell(v) if isinstance(v := r.get(c), float) or v is None else str(v) for c in columns) + " |" for r in rows]
    return "\n".join(head + body)


def profile(events: DataFrame, action: str, seconds: str) -> DataFrame:
    """Per action: calls, mean and total duration."""
    return events.groupBy(action).agg(F.count("*").alias("n_calls"), F.avg(seconds).alias("mean_s"), F.sum(seconds).alias("total_s"))


def latex(rows: list[dict], columns: list[str]) -> str:
    """The report as a LaTeX table."""
    def plain(v) -> str:
        return (cell(v) if isinstance(v, float) or v is None else str(v)).replace("—", "--").replace("_", "\\_").replace("%", "\\%").replace("&", "\\&")

    body = [" & ".join(plain(r.get(c)) for c in columns) + " \\\\" for r in rows]
    head = " & ".join(plain(c) for c in columns) + " \\\\"
    return "\n".join(["\\begin{tabular}{" + "l" * len(columns) + "}", "\\hline", head, "\\hline", *body, "\\hline", "\\end{tabular}"])


def by_column(report: DataFrame, column: str, key: str) -> DataFrame:
    """The report in falling order of a column (then by key), with each row's place."""
    return report.orderBy(F.desc(column), key).withColumn("place", F.row_number().over(Window.orderBy(F.desc(column), key)).cast("long"))

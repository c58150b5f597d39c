"""Multiple-choice evaluation: choices scored by summed log-probabilities, tasks rolled up into groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits to which scores are rounded before the best choice is taken.
DIGITS = 9


def judged_choices(choices: DataFrame, item: list[str], choice: str, logprob: str, length: Column, gold: str) -> DataFrame:
    """Per item, from a row for each choice: ``acc`` and ``acc_norm``, 1 if the gold choice has the largest log-probability,
    and the largest one for its length; of equal ones the first choice counts. A choice without a log-probability or
    a length never wins; an item none of whose choices can win is wrong."""

    def wins(score: Column) -> Column:
        best = F.min(F.when(score.isNotNull(), F.struct((-F.round(score, DIGITS)).alias("down"), F.col(choice).alias("choice"))))
        return F.coalesce((best["choice"] == F.first(gold)).cast("double"), F.lit(0.0))

    per_length = F.col(logprob) / F.when(length > 0, length)
    return choices.groupBy(*item).agg(wins(F.col(logprob)).alias("acc"), wins(per_length).alias("acc_norm"))


def rolled_up(judged: DataFrame, group: str, task: str, metrics: list[str]) -> DataFrame:
    """Rows (name, is_group, metric, value, stderr, n): means over the items of each task, of each group (every item
    counts once, so large tasks weigh more), and of all (named ``all``), in one pass."""
    sums = [x for m in metrics for x in (F.avg(m).alias(m), F.stddev_samp(m).alias(f"_s_{m}"))]
    rolled = judged.rollup(group, task).agg(F.grouping_id().alias("_level"), F.count("*").alias("n"), *sums)
    name = F.when(F.col("_level") == 0, F.col(task)).when(F.col("_level") == 1, F.col(group)).otherwise(F.lit("all"))
    long = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.col(f"_s_{m}") / F.sqrt("n")).alias("stderr")) for m in metrics])
    return rolled.select(name.alias("name"), (F.col("_level") > 0).alias("is_group"), "n", F.inline(long))


def harness_results(rolled: DataFrame) -> DataFrame:
    """Rows (task, is_group, name, value) as an evaluation harness names them: ``metric,none``, ``metric_stderr,none``, and the
    task's alias."""
    each = F.array(
        F.struct(F.concat("metric", F.lit(",none")).alias("name"), F.col("value").cast("string").alias("value")),
        F.struct(F.concat("metric", F.lit("_stderr,none")).alias("name"), F.col("stderr").cast("string").alias("value")),
    )
    named = rolled.select(F.col("name").alias("task"), "is_group", F.inline(each))
    return named.unionByName(rolled.select(F.col("name").alias("task"), "is_group").distinct().withColumns({"name": F.lit("alias"), "value": F.col("task")}))


def summarized(results: DataFrame, wanted: list[str]) -> DataFrame:
    """(metric, value) of the wanted names: of one that is a group its own results alone, else the task's."""
    from .prep import clean_metric_keys

    rows = results.where(F.col("task").isin(wanted))
    groups = rows.where("is_group").select("task").distinct()
    kept = rows.where("is_group").unionByName(rows.where("not is_group").join(groups, "task", "left_anti"))
    return clean_metric_keys(kept).select("metric", "value")

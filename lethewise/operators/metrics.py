"""Metrics of memorisation, privacy and utility over token and item scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethewise.functions.stats import EPS


def checked_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key; an error, when it runs, if one side lacks a key of the other. Null keys on either side
    take no part."""
    sides = [d.where(F.col(key).isNotNull()).withColumn(f"_in{i}", F.lit(True)) for i, d in enumerate((a, b))]
    alone = F.raise_error(F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(" is on one side only"))).cast("boolean")
    return sides[0].join(sides[1], key, "full_outer").where(F.when(F.col("_in0") & F.col("_in1"), True).otherwise(alone)).drop("_in0", "_in1")


def probability_with_options(scores: DataFrame, item: str = "item", eps: float = EPS) -> DataFrame:
    """Per item: the true answer's probability among all; rows of ``scores`` have kind ``answer`` or ``perturbed``."""
    right, wrong = F.sum(F.when(F.col("kind") == "answer", F.col("prob"))), F.sum(F.when(F.col("kind") == "perturbed", F.col("prob")))
    return scores.where(F.col("kind").isin("answer", "perturbed")).groupBy(item).agg((right / (right + wrong + eps)).alias("value")).where("value is not null")


def truth_ratio(scores: DataFrame, aggregator: str, item: str = "item", right: str = "paraphrase", wrong: str = "perturbed") -> DataFrame:
    """Per item: the score of which the metric is the mean. Losses are averaged over answers, then made probabilities."""
    loss = [F.avg(F.when(F.col("kind") == k, F.col("avg_loss"))) for k in (right, wrong)]
    p = scores.groupBy(item).agg(F.exp(-loss[0]).alias("right"), F.exp(-loss[1]).alias("wrong")).where("right is not null and wrong is not null")
    a, b = F.col("right"), F.col("wrong")
    ratio = b / (a + EPS)
    forms: dict[str, Column] = {"closer_to_1_better": F.least(ratio, 1 / (ratio + EPS)), "true_better": F.greatest(F.lit(0.0), 1 - ratio), "prob_mean": a / (a + b + EPS)}
    if aggregator not in forms:
        raise ValueError(f"no aggregator {aggregator!r}")
    return p.select(item, forms[aggregator].alias("value"))


def exact_memorization(predicted: DataFrame, item: str = "item") -> DataFrame:
    """Per item: the share of tokens that were predicted."""
    return predicted.groupBy(item).agg(F.avg((F.col("pred_token") == F.col("token")).cast("double")).alias("value"))


def extraction_strength(predicted: DataFrame, item: str = "item", pos: str = "pos") -> DataFrame:
    """Per item of n tokens: 1 - k / n, k the start of the longest suffix that was predicted, n - 1 at most."""
    order = Window.partitionBy(item).orderBy(pos)
    numbered = predicted.withColumn("_i", F.row_number().over(order) - 1)
    missed = F.max(F.when(F.col("pred_token") != F.col("token"), F.col("_i")))
    k = F.least(F.coalesce(missed + 1, F.lit(0)), F.count("*") - 1)
    return numbered.groupBy(item).agg((1 - k / F.count("*")).alias("value"))


def strength_with_empty(items: DataFrame, strength: DataFrame, item: str = "item") -> DataFrame:
    """All items; those without a token score 0, and count."""
    return items.select(item).join(strength, item, "left").select(item, F.coalesce("value", F.lit(0.0)).alias("value"))


def min_k(scores: DataFrame, item: str, logprob: str, share: float, pos: str = "pos") -> DataFrame:
    """Per item: minus the mean of the lowest share of log-probabilities, of one at least."""
    mine = Window.partitionBy(item)
    ranked = scores.select(item, F.col(logprob).alias("_lp"), F.row_number().over(mine.orderBy(logprob, pos)).alias("_r"), F.count("*").over(mine).alias("_n"))
    low = F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(share))).cast("int"))
    return ranked.where(low).groupBy(item).agg((-F.avg("_lp")).alias("score"))


def min_k_counted(scores: DataFrame, item: str, logprob: str, share: float, count: str = "c", token: str = "token") -> DataFrame:
    """As ``min_k``, of rows that stand for ``count`` equal tokens of their item each."""
    mine = Window.partitionBy(item)
    upto = F.sum(count).over(mine.orderBy(logprob, token).rowsBetween(Window.unboundedPreceding, 0))
    ranked = scores.select(item, F.col(logprob).alias("_lp"), F.col(count).alias("_c"), upto.alias("_upto"), F.sum(count).over(mine).alias("_n"))
    low = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(share))))
    taken = F.greatest(F.lit(0), F.least(F.col("_c"), low - (F.col("_upto") - F.col("_c"))))
    return ranked.groupBy(item).agg((-F.sum(taken * F.col("_lp")) / F.sum(taken)).alias("score"))


def min_k_plus_plus(scores: DataFrame, item: str, logprob: str, mu: Column, sigma2: Column, share: float) -> DataFrame:
    """As ``min_k``, of log-probabilities standardised by the vocabulary's mean and variance."""
    z = (F.col(logprob) - mu) / F.sqrt(F.greatest(sigma2, F.lit(1e-6)))
    return min_k(scores.withColumn("_z", z), item, "_z", share)


def truth_ratio_inverted(scores: DataFrame, forget: Column, item: str = "item", right: str = "paraphrase", wrong: str = "perturbed") -> DataFrame:
    """Per item, from r = exp(mean wrong loss - mean right loss): min(r, 1/r) where ``forget`` holds, else max(0, 1 - 1/r).
    ``right`` may be the true answer as well."""
    loss = [F.avg(F.when(F.col("kind") == k, F.col("avg_loss"))) for k in (wrong, right)]
    each = scores.groupBy(item).agg(F.exp(loss[0] - loss[1]).alias("r"), F.first(forget).alias("_forget")).where("r is not null")
    r = F.col("r")
    return each.select(item, "r", F.when(F.col("_forget"), F.least(r, 1 / r)).otherwise(F.greatest(F.lit(0.0), 1 - 1 / r)).alias("value"))


def target_window(tokens: DataFrame, item: str, target: Column, pos: str = "pos") -> DataFrame:
    """Tokens from the first target of an item to its last, whether targets themselves or not."""
    mine = Window.partitionBy(item)
    edge = [f(F.when(target, F.col(pos))).over(mine) for f in (F.min, F.max)]
    return tokens.withColumns({"_a": edge[0], "_b": edge[1]}).where(F.col(pos).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def transposed(scores: DataFrame, item: str, answer: str, value: str) -> DataFrame:
    """Per item: the values of its answers in order."""
    return scores.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct(answer, value))), lambda s: s[value]).alias("answer_values"))


def without_last_target(tokens: DataFrame, item: str, pos: str = "pos") -> DataFrame:
    """Target tokens but the last of each item."""
    return tokens.withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(F.desc(pos)))).where("_r > 1").drop("_r")

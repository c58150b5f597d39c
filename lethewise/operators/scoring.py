"""The built-in scorer: n-gram models as tables of counts, and token scores by a join.

A producer of a table with the columns of ``token_scores`` may take its place; all metrics start from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethewise.tables import written

from .joins import lookup, salted_join


def exploded(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """One row per token: the keys, pos (from 0) and token."""
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def unigram_counts(tokens: DataFrame, models: dict[str, Column]) -> DataFrame:
    """Per token, its number in each model's training rows (columns c_<model>), counted in one pass."""
    return tokens.groupBy("token").agg(*[F.sum(F.when(rows, 1).otherwise(0)).alias(f"c_{m}") for m, rows in models.items()])


def unigram_logprobs(counts: DataFrame, models: list[str]) -> DataFrame:
    """Per token, log p with one added to every count (columns lp_<model>), over the vocabulary of all models."""
    sums = counts.agg(F.count("*").alias("_v"), *[F.sum(f"c_{m}").alias(f"_n_{m}") for m in models])
    lp = [F.ln((F.col(f"c_{m}") + 1) / (F.col(f"_n_{m}") + F.col("_v"))).alias(f"lp_{m}") for m in models]
    return counts.join(F.broadcast(sums)).select("token", *lp)


def token_scores(tokens: DataFrame, logprobs: DataFrame) -> DataFrame:
    """Tokens with the columns of ``logprobs``; frequent tokens are dealt over several tasks."""
    return salted_join(tokens, logprobs, "token")


def counted_scores(tokens: DataFrame, keys: list[str], models: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(keys, token, c, lp_<model> ...) with one row for each distinct token of a text, and the vocabulary's log p.

    Texts are counted before anything is joined; the counts give the vocabulary, and are joined to it by ``lookup``, which
    broadcasts the few tokens that very many texts hold. Both results come from tables that are written once."""
    counted = written(tokens.groupBy(*keys, "token").agg(F.count("*").alias("c")), "counted")
    sums = [F.sum(F.when(rows, F.col("c")).otherwise(0)).alias(f"c_{m}") for m, rows in models.items()]
    counts = written(counted.groupBy("token").agg(F.count("*").alias("n_texts"), *sums), "vocabulary")
    logprobs = unigram_logprobs(counts, list(models))
    known = written(logprobs.join(counts.select("token", "n_texts"), "token"), "logprobs")
    return lookup(counted, known, "token", "n_texts", counted.count()), known.drop("n_texts")


def vocabulary_moments(logprobs: DataFrame, model: str) -> DataFrame:
    """One row: mean and variance of log p over the vocabulary, each token weighted by p (mu, sigma2)."""
    lp = F.col(f"lp_{model}")
    m = logprobs.agg(F.sum(F.exp(lp) * lp).alias("mu"), F.sum(F.exp(lp) * lp * lp).alias("square"))
    return m.select("mu", (F.col("square") - F.col("mu") * F.col("mu")).alias("sigma2"))


def bigram_scores(tokens: DataFrame, keys: list[str], logprobs: DataFrame, model: str, weight: float = 0.5) -> DataFrame:
    """Tokens from the second of each text on, with log p under weight * bigram + (1 - weight) * unigram, and
    ``pred_token``, the token that most often follows the one before (of equals the first in order)."""
    order = Window.partitionBy(*keys).orderBy("pos")
    pairs = tokens.withColumn("prev", F.lag("token").over(order)).where("prev is not null")
    pair_n = pairs.groupBy("prev", "token").agg(F.count("*").alias("n2"))
    prev_n = pair_n.groupBy("prev").agg(F.sum("n2").alias("n1"), F.min(F.struct((-F.col("n2")).alias("n"), F.col("token"))).alias("b"))
    table = pair_n.join(prev_n, "prev").join(logprobs.select("token", F.col(f"lp_{model}").alias("_u")), "token")
    lp = F.ln(weight * F.col("n2") / F.col("n1") + (1 - weight) * F.exp("_u"))
    table = table.select(F.struct("prev", "token").alias("pair"), lp.alias("lp"), F.col("b.token").alias("pred_token"))
    return salted_join(pairs.withColumn("pair", F.struct("prev", "token")), table, "pair", "inner").drop("pair")


def item_scores(scores: DataFrame, keys: list[str], logprob: str) -> DataFrame:
    """Per item and answer: n_tokens, sum_loss, avg_loss, prob."""
    lp = F.col(logprob)
    out = scores.groupBy(*keys).agg(F.count(lp).alias("n_tokens"), (-F.sum(lp)).alias("sum_loss"), (-F.avg(lp)).alias("avg_loss"))
    return out.withColumn("prob", F.exp(-F.col("avg_loss")))

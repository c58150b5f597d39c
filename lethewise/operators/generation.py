"""Generation with a table of next tokens, and stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stop_flags(tokens: DataFrame, item: str, stop: str, stop_tokens: int) -> DataFrame:
    """Tokens with ``done``: true from the first place on at which the stop string stands within the last
    ``stop_tokens`` + 2 tokens of its item."""
    order = Window.partitionBy(item).orderBy("pos")
    near = F.array_join(F.collect_list("token").over(order.rowsBetween(-(stop_tokens + 1), 0)), " ")
    found = F.contains(near, F.lit(stop)).cast("int")
    return tokens.withColumn("_found", found).withColumn("done", F.max("_found").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_found")


def next_tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """prev, next: the token that most often follows each, of equals the first in order."""
    pairs = tokens.withColumn("prev", F.lag("token").over(Window.partitionBy(*keys).orderBy("pos"))).where("prev is not null")
    counts = pairs.groupBy("prev", "token").agg(F.count("*").alias("n"))
    best = counts.groupBy("prev").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("token"))).alias("b"))
    return best.select("prev", F.col("b.token").alias("next"))


def greedy_continuation(starts: DataFrame, table: DataFrame, item: str, max_new_tokens: int) -> DataFrame:
    """``starts`` (item, token) with ``generated``: each step appends the most likely next token, until there is none.

    One equi-join a step; the number of steps is the caller's limit."""
    state = starts.select(item, F.col("token").alias("_last"), F.array().cast("array<string>").alias("generated"))
    for _ in range(max_new_tokens):
        state = state.join(table, F.col("_last") == F.col("prev"), "left").select(item, F.col("next").alias("_last"), F.when(F.col("next").isNull(), F.col("generated")).otherwise(F.concat("generated", F.array("next"))).alias("generated"))
    return state.select(item, "generated")


def layer_contrast(layers: DataFrame, key: str, final: str, early: str) -> DataFrame:
    """Per position, the early layer whose distribution is farthest from the final one (mean of the two divergences from
    their mean), and the contrasted log-probabilities. Rows: key, layer, and two vectors of logits."""
    from lethewise.functions.arrays import dot, let, log_softmax, softmax

    def apart(p, q):
        def half(a, m):
            return dot(a, F.zip_with(a, m, lambda x, y: F.ln(x) - F.ln(y)))

        return let(F.zip_with(p, q, lambda x, y: (x + y) / 2), lambda m: (half(p, m) + half(q, m)) / 2)

    far = layers.withColumn("js", let(softmax(F.col(final)), lambda p: let(softmax(F.col(early)), lambda q: apart(p, q))))
    best = far.groupBy(key).agg(F.max_by(F.struct("layer", "js", final, early), F.struct("js", -F.col("layer"))).alias("b"))
    diff = F.zip_with(log_softmax(F.col(f"b.{final}")), log_softmax(F.col(f"b.{early}")), lambda a, b: a - b)
    return best.select(key, F.col("b.layer").alias("layer"), F.col("b.js").alias("js"), diff.alias("scores"))

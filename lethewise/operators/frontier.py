"""Generation by composed distributions, as an iterated frontier of states.

Three sparse tables of next tokens (a base and assistants, by state: the last token) are met by full outer join; tokens under
the base's relative-top filter, or that the base never saw behind a state, are masked; the rest score base log-probability
plus weighted assistants' log-probabilities, and the best of each state is its step. All items in one state take the same
step, so what is advanced is the frontier of distinct starts, until every one has stopped: at a stop string (the automaton's
state rides along), at the end token, behind a token that nothing follows, or at the most steps.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethewise.tables import written

from .joins import lookup
from .stopping import StopAutomaton, token_moves

END = "</s>"
#: Digits to which scores are rounded before the best is taken, so that ties do not depend on the order of a sum.
DIGITS = 9


def next_counts(sequences: DataFrame, tokens: Column, models: dict[str, Column]) -> DataFrame:
    """(state, token, c_<model> ...): how often each token follows each, in the rows of each model."""
    from .context import pairs_of

    pairs = sequences.select(*[rows.alias(f"_{m}") for m, rows in models.items()], F.inline(pairs_of(tokens)))
    return pairs.groupBy(F.col("prev").alias("state"), "token").agg(*[F.sum(F.when(F.col(f"_{m}"), 1).otherwise(0)).alias(f"c_{m}") for m in models])


def next_logprobs(counts: DataFrame, model: str) -> DataFrame:
    """(state, token, lp) of one model: log shares of the state's tokens."""
    own = counts.where(F.col(f"c_{model}") > 0).select("state", "token", F.col(f"c_{model}").alias("c"))
    own = written(own, f"next-{model}")
    totals = own.groupBy("state").agg(F.sum("c").alias("_n"), F.count("*").alias("_w"))
    return lookup(own, written(totals, f"states-{model}"), "state", "_w", own.count()).select("state", "token", F.ln(F.col("c") / F.col("_n")).alias("lp"))


def composed_steps(base: DataFrame, assistants: list[tuple[DataFrame, float]], share: float, backoff: float = 0.5) -> DataFrame:
    """(state, next, score): the step of each state that the base knows.

    Masked are tokens whose base probability is under ``share`` of the state's largest, and those that the base lacks. An
    assistant's probability is mixed with the base's, ``backoff`` of it, so one that never saw a state says what the
    base says; of equal scores the first token in order wins."""
    met = reduce(lambda a, k: a.join(assistants[k][0].select("state", "token", F.col("lp").alias(f"_a{k}")), ["state", "token"], "full_outer"), range(len(assistants)), base.select("state", "token", F.col("lp").alias("_b")))
    met = written(met.where("_b is not null"), "met")
    sums = [F.max(F.when(F.col(f"_a{k}").isNotNull(), 1).otherwise(0)).alias(f"_k{k}") for k in range(len(assistants))]
    states = written(met.groupBy("state").agg(F.max("_b").alias("_top"), F.count("*").alias("_w"), *sums), "states")
    each = lookup(met, states, "state", "_w", met.count())
    score = F.col("_b")
    for k, (_, weight) in enumerate(assistants):
        mixed = F.ln(backoff * F.exp("_b") + (1 - backoff) * F.coalesce(F.exp(f"_a{k}"), F.lit(0.0)))
        score = score + weight * F.when(F.col(f"_k{k}") == 1, mixed).otherwise(F.col("_b"))
    kept = each.where(F.col("_b") >= F.col("_top") + math.log(share)).withColumn("score", F.round(score, DIGITS))
    best = kept.groupBy("state").agg(F.min(F.struct((-F.col("score")).alias("down"), F.col("token"))).alias("b"))
    return best.select("state", F.col("b.token").alias("next"), (-F.col("b.down")).alias("score"))


def advanced(starts: DataFrame, steps: DataFrame, stops: StopAutomaton, most: int, end: str = END) -> DataFrame:
    """(start, generated, ended) of each distinct ``start``: the tokens, without the end token and to the stop's last, and
    what ended them: ``stop``, ``end``, ``unknown`` (nothing follows) or ``length``."""
    moves = token_moves(steps.select(F.col("next").alias("token")).where(F.col("token") != end).distinct(), stops)
    known = written(steps.join(moves, F.col("next") == F.col("token"), "left").select("state", "next", "move"), "steps")
    live = written(starts.select("start").where("start is not null").distinct().select("start", F.col("start").alias("last"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("generated")), "frontier")
    over, left = [], live.count()
    for k in range(most):
        if not left:
            break
        weights = live.groupBy("last").agg(F.count("*").alias("_w"))
        table = written(weights.join(known, F.col("last") == F.col("state")).select("last", "_w", "next", "move"), "weights")
        moved = lookup(live, table, "last", "_w", left)
        grows = F.col("next").isNotNull() & (F.col("next") != end)
        at = F.when(grows, F.get("move", F.col("at")))
        ended = F.when(F.col("next").isNull(), "unknown").when(F.col("next") == end, "end").when(at == stops.done, "stop")
        if k == most - 1:
            ended = F.coalesce(ended, F.lit("length"))
        grown = F.when(grows, F.concat("generated", F.array("next"))).otherwise(F.col("generated"))
        moved = written(moved.select("start", F.col("next").alias("last"), F.coalesce(at, F.col("at")).alias("at"), grown.alias("generated"), ended.alias("ended")), "frontier")
        over.append(moved.where("ended is not null").select("start", "generated", "ended"))
        live = moved.where("ended is null").drop("ended")
        left = live.count()
    none = starts.sparkSession.createDataFrame([], "start string, generated array<string>, ended string")
    return reduce(DataFrame.unionByName, over, none)


def generate(items: DataFrame, start: str, steps: DataFrame, stops: StopAutomaton, most: int, end: str = END) -> DataFrame:
    """``items`` with ``generated`` and ``ended``; an item without a start has no tokens and ended ``unknown``."""
    counted = items.where(F.col(start).isNotNull()).groupBy(F.col(start).alias("start")).agg(F.count("*").alias("_w"))
    paths = written(advanced(counted, steps, stops, most, end).join(counted, "start"), "paths").withColumnRenamed("start", start)
    out = lookup(items, paths, start, "_w", items.count())
    return out.withColumns({"generated": F.coalesce("generated", F.array().cast("array<string>")), "ended": F.coalesce("ended", F.lit("unknown"))})

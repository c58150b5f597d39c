"""Registries by name: collators, evaluators, scorers; attacks with a set-up; and JSON-lines logs of runs."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethewise.functions import stats
from lethewise.functions import text as tx
from lethewise.operators import metrics, scoring

from . import suites


class Registry(dict):
    """Things by name; a name that isn't there is an error that lists those that are."""

    def __init__(self, what: str, **known):
        super().__init__(known)
        self.what = what

    def __missing__(self, name: str):
        raise NotImplementedError(f"no {self.what} {name!r}; there are {sorted(self)}")

    def register(self, name: str, thing: Callable) -> Callable:
        self[name] = thing
        return thing


def padded_batch(df: DataFrame, tokens: str, size: int, pad: int = 0, left: bool = False) -> DataFrame:
    """``df`` with input_ids of one length and their attention_mask (of the true lengths)."""
    cut = F.slice(F.col(tokens), 1, size)
    return df.withColumns({"input_ids": tx.padded(cut, size, pad, left), "attention_mask": tx.true_mask(F.size(cut), size, left)})


def unigram_scorer(tokens: DataFrame, keys: list[str], models: dict[str, Column]) -> DataFrame:
    """Counted tokens with log p under each model."""
    return scoring.counted_scores(tokens, keys, models)[0]


def bigram_scorer(tokens: DataFrame, keys: list[str], models: dict[str, Column]) -> DataFrame:
    """Tokens with log p under an interpolated bigram of the first model, and the most likely token."""
    counts = scoring.unigram_counts(tokens, models)
    return scoring.bigram_scores(tokens, keys, scoring.unigram_logprobs(counts, list(models)), next(iter(models)))


def table_scorer(tokens: DataFrame, keys: list[str], models: dict[str, DataFrame]) -> DataFrame:
    """Tokens with log p that another program wrote: a table by keys and pos for each model."""
    for name, given in models.items():
        tokens = tokens.join(given.select(*keys, "pos", F.col("logprob").alias(f"lp_{name}")), [*keys, "pos"])
    return tokens


COLLATORS = Registry("collator", padded=padded_batch)
SCORERS = Registry("scorer", unigram=unigram_scorer, bigram=bigram_scorer, table=table_scorer)
EVALUATORS = Registry("evaluator", **{name: (lambda frames, options=None, names=names: suites.plan(names, frames, options).run()) for name, names in suites.SUITES.items()})


class Attack(Protocol):
    """A membership attack. ``setup`` sees both sides before anything is scored, and ``score`` gives (item, score)."""

    def setup(self, forget: DataFrame, holdout: DataFrame) -> None: ...

    def score(self, tokens: DataFrame) -> DataFrame: ...


class LossAttack:
    """Minus the mean log p of an item."""

    def setup(self, forget: DataFrame, holdout: DataFrame) -> None:
        pass

    def score(self, tokens: DataFrame) -> DataFrame:
        return tokens.groupBy("item").agg((-F.avg("logprob")).alias("score"))


class MinKAttack:
    """Minus the mean of the lowest share of an item's log p."""

    def __init__(self, k: float = 0.4):
        self.k = k

    def setup(self, forget: DataFrame, holdout: DataFrame) -> None:
        pass

    def score(self, tokens: DataFrame) -> DataFrame:
        return metrics.min_k(tokens, "item", "logprob", self.k)


class CentredLossAttack(LossAttack):
    """The loss, less the mean loss of all items of both sides."""

    def setup(self, forget: DataFrame, holdout: DataFrame) -> None:
        self.mean = super().score(forget.unionByName(holdout)).agg(F.avg("score").alias("mean"))

    def score(self, tokens: DataFrame) -> DataFrame:
        return super().score(tokens).join(F.broadcast(self.mean)).select("item", (F.col("score") - F.col("mean")).alias("score"))


ATTACKS = Registry("attack", loss=LossAttack, min_k=MinKAttack, centred_loss=CentredLossAttack)


def run_attack(attack: Attack, forget: DataFrame, holdout: DataFrame) -> DataFrame:
    """One row: the area under the curve (1: forget scores are lower), and the mean score of either side."""
    attack.setup(forget, holdout)
    both = attack.score(forget).withColumn("y", F.lit(0)).unionByName(attack.score(holdout).withColumn("y", F.lit(1)))
    means = both.agg(*[F.avg(F.when(F.col("y") == k, F.col("score"))).alias(n) for k, n in enumerate(("mean_forget", "mean_holdout"))])
    return stats.auc(both, "score", "y").join(F.broadcast(means))


class JsonLines(logging.Formatter):
    """A log record as one line of JSON: time, level, logger, event, and the fields of ``extra={"fields": {...}}``."""

    def format(self, record: logging.LogRecord) -> str:
        own = {"time": self.formatTime(record), "level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()}
        return json.dumps(own | getattr(record, "fields", {}), ensure_ascii=False, default=str)


def json_log(path: str, name: str = "lethewise", drop_loggers: tuple[str, ...] = (), drop: tuple[str, object] | None = None) -> logging.Logger:
    """A logger that appends JSON lines to a file, without records of some loggers or with some field's value."""
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(JsonLines())
    handler.addFilter(lambda r: r.name not in drop_loggers and (drop is None or getattr(r, "fields", {}).get(drop[0]) != drop[1]))
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    log.handlers, log.propagate = [handler], False
    return log

"""Metric handlers by name, the configured instances of them, and evaluation suites.

A handler takes frames: ``scores`` (item, kind, answer_pos, avg_loss, prob), ``predicted`` (item, pos, token, pred_token),
``tokens`` (item, pos, logprob, mu, sigma2), ``generated`` (item, truth, said), each for one data set, or results of other
metrics. It returns rows (item, value), or (value).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethewise.functions import stats
from lethewise.functions import text as tx
from lethewise.operators import metrics
from lethewise.operators.classify import Classifier

from .metric_plan import HANDLERS, Metric, Plan, metric


@metric("probability")
def probability(scores: DataFrame, kind: str = "answer") -> DataFrame:
    return scores.where(F.col("kind") == kind).groupBy("item").agg(F.avg("prob").alias("value"))


@metric("probability_w_options")
def probability_w_options(scores: DataFrame) -> DataFrame:
    return metrics.probability_with_options(scores)


@metric("rouge")
def rouge(generated: DataFrame, rouge_type: str = "rougeL_recall", stemmer: bool = True) -> DataFrame:
    return tx.rouge(generated, "truth", "said", stemmer).select("item", F.col(rouge_type).alias("value"))


@metric("truth_ratio")
def truth_ratio(scores: DataFrame, aggregator: str = "closer_to_1_better", right: str = "paraphrase") -> DataFrame:
    return metrics.truth_ratio(scores, aggregator, right=right)


@metric("exact_memorization")
def exact_memorization(predicted: DataFrame) -> DataFrame:
    return metrics.exact_memorization(predicted)


@metric("extraction_strength")
def extraction_strength(predicted: DataFrame) -> DataFrame:
    return metrics.extraction_strength(predicted)


@metric("ks_test")
def ks_test(mine: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """One row: the p-value against a reference run, null without one."""
    if reference is None:
        return mine.sparkSession.createDataFrame([(None,)], "value double")
    both = mine.select("value", F.lit(0).alias("side")).unionByName(reference.select("value", F.lit(1).alias("side")))
    row = stats.ks_statistic(both, "value", "side").first()
    p = stats.ks_pvalue(row.ks, row.n0, row.n1) if row else None
    return mine.sparkSession.createDataFrame([(p,)], "value double")


@metric("privleak")
def privleak(auc: DataFrame, reference: DataFrame | None = None, ref_value: float = 0.5) -> DataFrame:
    """One row, from an attack's area and that of a reference run or, without one, a constant."""
    ref = F.lit(ref_value) if reference is None else F.coalesce(F.lit(reference.agg(F.avg("value")).first()[0]), F.lit(ref_value))
    return auc.agg(F.avg("value").alias("v")).select(stats.privacy_leakage(F.col("v"), ref).alias("value"))


@metric("rel_diff")
def rel_diff(auc: DataFrame, reference: DataFrame | None = None, ref_value: float = 0.5) -> DataFrame:
    ref = F.lit(ref_value) if reference is None else F.coalesce(F.lit(reference.agg(F.avg("value")).first()[0]), F.lit(ref_value))
    return auc.agg(F.avg("value").alias("v")).select(stats.relative_change(F.col("v"), ref).alias("value"))


@metric("hm_aggregate")
def hm_aggregate(*parts: DataFrame) -> DataFrame:
    """One row: the harmonic mean of the parts' means; a part without values counts as 0."""
    out = None
    for p in parts:
        one = p.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out.agg(stats.harmonic_mean(F.col("v")).alias("value"))


@metric("classifier_prob")
def classifier_prob(generated: DataFrame, classifier: Classifier | Callable[[list[str]], list[float]] | None = None, class_id: int = 0) -> DataFrame:
    """Probability of a class for each generated text, from a classifier of the engine, or from a function of texts."""
    if classifier is None:
        raise ValueError("this metric needs a classifier")
    if isinstance(classifier, Classifier):
        return classifier.probabilities(generated.select("item", "said"), "said", "_prob").select("item", F.get("_prob", class_id).alias("value"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"item": f["item"], "value": classifier(f["said"].fillna("").tolist())})

    item = generated.schema["item"]
    return generated.select("item", "said").mapInPandas(run, T.StructType([T.StructField("item", item.dataType), T.StructField("value", T.DoubleType())]))


def _attack(score: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The area of an item score between two sets: forget (0) and holdout (1)."""

    def run(forget: DataFrame, holdout: DataFrame, **options) -> DataFrame:
        both = score(forget, **options).withColumn("y", F.lit(0)).unionByName(score(holdout, **options).withColumn("y", F.lit(1)))
        return stats.auc(both, "score", "y").select(F.col("auc").alias("value"))

    return run


def _loss(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("item").agg((-F.avg("logprob")).alias("score"))


def _reference(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("item").agg((F.avg("reference_logprob") - F.avg("logprob")).alias("score"))


def _zlib(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("item").agg((-F.avg("logprob") / F.max("n_zlib")).alias("score"))


def _min_k(tokens: DataFrame, k: float = 0.4) -> DataFrame:
    return metrics.min_k(tokens, "item", "logprob", k)


def _min_k_pp(tokens: DataFrame, k: float = 0.4) -> DataFrame:
    return metrics.min_k_plus_plus(tokens, "item", "logprob", F.col("mu"), F.col("sigma2"), k)


def _gradnorm(tokens: DataFrame, p: int = 2) -> DataFrame:
    """From norms that the producer of the scores gives; the engine computes no gradients of networks."""
    return tokens.groupBy("item").agg(F.max("grad_norm").alias("score"))


for _name, _score in (("mia_loss", _loss), ("mia_reference", _reference), ("mia_zlib", _zlib), ("mia_min_k", _min_k), ("mia_min_k_plus_plus", _min_k_pp), ("mia_gradnorm", _gradnorm)):
    HANDLERS[_name] = _attack(_score)


def _instances() -> dict[str, tuple[str, tuple[str, ...], dict]]:
    """Name -> handler, what it takes (frames as set.frame, or metrics), options. The names and options."""
    out: dict[str, tuple[str, tuple[str, ...], dict]] = {}
    for s in ("forget", "retain", "ra", "wf"):
        out[f"{s}_Q_A_Prob"] = ("probability", (f"{s}.scores",), {"kind": "answer"})
        out[f"{s}_Q_A_PERT_Prob"] = ("probability", (f"{s}.scores",), {"kind": "perturbed"})
        out[f"{s}_Q_A_ROUGE"] = ("rouge", (f"{s}.generated",), {"rouge_type": "rougeL_recall"})
    for s in ("forget", "retain"):
        out[f"{s}_Q_A_PARA_Prob"] = ("probability", (f"{s}.scores",), {"kind": "paraphrase"})
        out[f"{s}_knowmem_ROUGE"] = ("rouge", (f"{s}_knowmem.generated",), {"rouge_type": "rougeL_f1"})
    for s in ("ra", "wf"):
        out[f"{s}_Q_A_Prob_normalised"] = ("probability_w_options", (f"{s}.scores",), {})
        out[f"{s}_Truth_Ratio"] = ("truth_ratio", (f"{s}.scores",), {"aggregator": "true_better", "right": "answer"})
    out["forget_Q_A_PARA_ROUGE"] = ("rouge", ("forget_para.generated",), {"rouge_type": "rougeL_recall"})
    out["forget_Q_A_PERT_ROUGE"] = ("rouge", ("forget_pert.generated",), {"rouge_type": "rougeL_recall"})
    out["forget_verbmem_ROUGE"] = ("rouge", ("forget_verbmem.generated",), {"rouge_type": "rougeL_f1"})
    out["forget_truth_ratio"] = ("truth_ratio", ("forget.scores",), {"aggregator": "closer_to_1_better"})
    out["retain_Truth_Ratio"] = ("truth_ratio", ("retain.scores",), {"aggregator": "true_better"})
    out["forget_quality"] = ("ks_test", ("forget_truth_ratio",), {})
    nine = ("retain_Q_A_Prob", "retain_Q_A_ROUGE", "retain_Truth_Ratio", "ra_Q_A_Prob_normalised", "ra_Q_A_ROUGE", "ra_Truth_Ratio", "wf_Q_A_Prob_normalised", "wf_Q_A_ROUGE", "wf_Truth_Ratio")
    out["model_utility"] = ("hm_aggregate", nine, {})
    for name, options in (("mia_loss", {}), ("mia_zlib", {}), ("mia_reference", {}), ("mia_gradnorm", {"p": 2}), ("mia_min_k", {"k": 0.4}), ("mia_min_k_plus_plus", {"k": 0.4})):
        out[name] = (name, ("forget.tokens", "holdout.tokens"), options)
    out["privleak"] = ("privleak", ("mia_min_k",), {"ref_value": 0.5})
    out["exact_memorization"] = ("exact_memorization", ("forget.predicted",), {})
    out["extraction_strength"] = ("extraction_strength", ("forget.predicted",), {})
    out["forget_Q_A_gibberish"] = ("classifier_prob", ("forget.generated",), {})
    out["forget_gibberish"] = ("classifier_prob", ("forget_verbmem.generated",), {})
    return out


INSTANCES = _instances()
SUITES = {
    "question_answer": ["forget_quality", "forget_Q_A_Prob", "forget_Q_A_ROUGE", "model_utility", "privleak", "extraction_strength", "exact_memorization", "mia_min_k", "forget_truth_ratio"],
    "raw_text": ["forget_knowmem_ROUGE", "retain_knowmem_ROUGE", "forget_verbmem_ROUGE", "privleak", "extraction_strength"],
    "raw_text_fast": ["forget_knowmem_ROUGE", "retain_knowmem_ROUGE", "privleak"],
}


def plan(names: list[str], frames: dict[str, DataFrame], options: dict[str, dict] | None = None) -> Plan:
    """A plan of the named instances and those they need. ``frames`` are by set and name (``forget.scores``); ``options``
    adds to an instance's own, such as a classifier or a reference."""
    made: dict[str, Metric] = {}

    def add(name: str) -> None:
        if name in made:
            return
        handler, takes, own = INSTANCES[name]
        needs = tuple(t for t in takes if "." not in t)
        missing = [t for t in takes if "." in t and t not in frames]
        if missing:
            raise KeyError(f"{name} needs {missing[0]}")
        given = [frames[t] for t in takes if "." in t]
        f = HANDLERS[handler]
        made[name] = Metric(name, lambda *parts, f=f, given=given, **o: f(*given, *parts, **o), needs, own | (options or {}).get(name, {}))
        for n in needs:
            add(n)

    for n in names:
        add(n)
    return Plan(list(made.values()))

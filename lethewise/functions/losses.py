"""Losses of unlearning as functions of scores: scalars per item, or vectors of logits. None is optimised here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import Vector, dot, let, log_sigmoid, log_softmax, softmax, total


def gradient_ascent(token_loss: Column) -> Column:
    """Aggregate: minus the mean loss of the tokens."""
    return -F.avg(token_loss)


def grad_diff(forget: Column, retain: Column, gamma: float = 1.0, alpha: float = 1.0) -> Column:
    """Descent on what stays and ascent on what goes."""
    return -gamma * forget + alpha * retain


def kl_to_reference(reference: Vector, logits: Vector) -> Column:
    """Per row: the divergence of the model from the reference."""
    return total(F.zip_with(F.zip_with(log_softmax(reference), log_softmax(logits), lambda a, b: a - b), softmax(reference), lambda d, p: d * p))


def dpo(win: Column | None, win_ref: Column | None, lose: Column, lose_ref: Column, beta: float = 0.1) -> Column:
    """Per item, from losses: -2/beta log sigmoid(beta (log-ratio of the winner - log-ratio of the loser)). Without a
    winner it is the negative preference loss."""
    gain = F.lit(0.0) if win is None else win_ref - win
    return -2.0 / beta * log_sigmoid(beta * (gain - (lose_ref - lose)))


def npo(lose: Column, lose_ref: Column, beta: float = 0.1) -> Column:
    return dpo(None, None, lose, lose_ref, beta)


def simnpo(nll: Column, length: Column, beta: float = 4.5, delta: float = 0.0) -> Column:
    """Per item: as npo, from the mean loss and a margin in place of a reference."""
    return -2.0 / beta * log_sigmoid(beta * (nll / length - delta))


def wga(token_logprob: Column, beta: float = 1.0) -> Column:
    """Per token: the ascent weighted by a power of the token's probability."""
    return F.exp(token_logprob * beta) * token_logprob


def satimp(token_logprob: Column, beta1: float = 5.0, beta2: float = 1.0) -> Column:
    """Per token: weighted by powers of the probability and of its complement."""
    p = F.exp(token_logprob)
    return F.pow(p, F.lit(beta1)) * F.pow(1 - p, F.lit(beta2)) * token_logprob


def ceu(logits: Vector, target: Column) -> Column:
    """Per position: cross entropy to the model's own distribution without the target (0-based place)."""
    without = F.transform(logits, lambda x, i: F.when(i == target, F.lit(float("-inf"))).otherwise(x))
    return -dot(softmax(without), log_softmax(logits))


def undial(student: Vector, teacher: Vector, target: Column, beta: float = 10.0) -> Column:
    """Per position: cross entropy to the teacher's distribution with the target's logit lowered."""
    lowered = F.transform(teacher, lambda x, i: F.when(i == target, x - beta).otherwise(x))
    return -dot(softmax(lowered), log_softmax(student))


def uniform_kl(logits: Vector, minus_log: bool = True) -> Column:
    """Per position: the divergence from the uniform distribution; with ``minus_log`` false it is the variant that adds
    log V where the divergence subtracts it."""
    v = F.size(logits).cast("double")
    return -total(log_softmax(logits)) / v - F.ln(v) * (1 if minus_log else -1)


def pdu_forget(logits: Vector) -> Column:
    """Per position: the squared distance of the largest logit from the mean."""
    return F.pow(F.array_max(logits) - total(logits) / F.size(logits), F.lit(2.0))


def pdu_duals(steps: Column, epsilon: float, step: float, start: float = 0.0) -> Column:
    """The dual weight after each of an array of retain losses, in their order."""
    begin = F.struct(F.lit(start).alias("dual"), F.array().cast("array<double>").alias("all"))

    def after(state: Column, retain: Column) -> Column:
        return let(F.greatest(F.lit(0.0), state["dual"] + step * (retain - epsilon)), lambda d: F.struct(d.alias("dual"), F.concat(state["all"], F.array(d)).alias("all")))

    return F.aggregate(steps, begin, after)["all"]


def pdu_dual(dual: float, retain: float, epsilon: float, step: float) -> float:
    return max(0.0, dual + step * (retain - epsilon))


def unilogit(logits: Vector, target: Column) -> Column:
    """Per position: reverse divergence to the distribution that gives the target 1/V and keeps the others' proportions."""
    v = F.size(logits).cast("double")

    def loss(p: Vector) -> Column:
        def against(at: Column) -> Column:
            goal = F.transform(p, lambda x, i: F.when(i == target, 1 / v).otherwise(x * (1 - 1 / v) / (1 - at)))
            return total(F.zip_with(p, goal, lambda a, b: a * (F.ln(a) - F.ln(b))))

        return let(F.get(p, target), against)

    return let(softmax(logits), loss)


def flat(good: Column, bad: Column, kind: str = "kl") -> Column:
    """Per pair of probabilities: -(g*(good) - f*(g*(bad))) of an f-divergence; for js, f*(u) = -log(2 - exp(u))."""
    if kind == "tv":
        return -(F.tanh(good) / 2 - F.tanh(bad) / 2)
    if kind == "kl":
        return -(good - F.exp(bad - 1))
    if kind == "js":
        def g(x: Column) -> Column:
            return F.lit(0.6931471805599453) - F.log1p(F.exp(-x))

        return -(g(good) + F.ln(2 - F.exp(g(bad))))
    raise ValueError(f"no divergence {kind!r}")


def role_split(role: Column, loss: Column, weight: float = 1.0) -> Column:
    """Aggregate: mean loss of role 0 plus weight times mean loss of role 1; an empty side adds 0."""

    def side(k: int) -> Column:
        return F.coalesce(F.avg(F.when(role == k, loss)), F.lit(0.0))

    return side(0) + weight * side(1)


def remember_and_flatten(role: Column, token_loss: Column, uniform: Column, weight: float = 1.0) -> Column:
    """Aggregate: the mean cross entropy of role 0 plus weight times the mean divergence from the uniform distribution
    of role 1."""
    return role_split(role, F.when(role == 0, token_loss).otherwise(uniform), weight)


def masked_mse(a: Vector, b: Vector, mask: Column) -> Column:
    """Squared distance of activations to a control vector over unmasked rows' mean."""
    return F.avg(F.when(mask, dot(F.zip_with(a, b, lambda x, y: x - y), F.zip_with(a, b, lambda x, y: x - y)) / F.size(a)))


REGISTRY = {
    "GradAscent": gradient_ascent, "GradDiff": grad_diff, "KL": kl_to_reference, "DPO": dpo, "NPO": npo, "SimNPO": simnpo, "WGA": wga, "SatImp": satimp, "CEU": ceu,
    "UNDIAL": undial, "uniform": uniform_kl, "PDU": pdu_forget, "Unilogit": unilogit, "FLAT": flat, "RoleSplit": role_split, "RMU": masked_mse, "remember+uniform": remember_and_flatten,
}


def loss(name: str):
    """A loss by name."""
    if name not in REGISTRY:
        raise NotImplementedError(f"no loss {name!r}")
    return REGISTRY[name]

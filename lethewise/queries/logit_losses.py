"""Queries of logit composition and of losses.

Embeddings stand for logits over 64 tokens: vector i is the base model's, i + 1 and i + 2 (around the end) are those of
two assistants, and the label is the target token. Losses of sequences use the answers' scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise.functions import arrays, losses
from lethewise.operators import ranks

from .frames import ANSWER_SCORES, answer_logprobs, answer_scores, answer_tokens, table

QUERIES, ORACLE_SQL = {}, {}
SHARE, W1, W2 = 0.1, -0.8, 0.8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, target, base, a1, a2."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("target"), (arrays.doubles(F.col("embedding"))).alias("base"))
    e = ranks.add_row_index(e, "vec_id", "i")
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    e1 = e.join(n).select(((F.col("i") - 1 + F.col("n")) % F.col("n")).alias("i"), F.col("base").alias("a1"))
    e2 = e.join(n).select(((F.col("i") - 2 + 2 * F.col("n")) % F.col("n")).alias("i"), F.col("base").alias("a2"))
    return e.join(e1, "i").join(e2, "i").select("vec_id", "target", "base", "a1", "a2")


_L = """e AS (SELECT vec_id, label AS target, embedding::DOUBLE[] AS base, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings),
g AS (SELECT a.vec_id, a.target, a.base, b.base AS a1, c.base AS a2 FROM e a JOIN e b ON b.i = (a.i + 1) % a.n JOIN e c ON c.i = (a.i + 2) % a.n),
x AS (SELECT vec_id, target, unnest(range(0, 64)) AS v, unnest(base) AS base, unnest(a1) AS a1, unnest(a2) AS a2 FROM g),
p AS (SELECT *, base - ln(sum(exp(base)) OVER w) AS lp, a1 - ln(sum(exp(a1)) OVER w) AS lp1, a2 - ln(sum(exp(a2)) OVER w) AS lp2, row_number() OVER (PARTITION BY vec_id ORDER BY base DESC) AS r FROM x WINDOW w AS (PARTITION BY vec_id)),
k AS (SELECT *, least(max(CASE WHEN r = 6 THEN lp END) OVER w, max(lp) OVER w + ln(0.1::DOUBLE)) AS thr FROM p WINDOW w AS (PARTITION BY vec_id)),
m AS (SELECT *, lp < thr AS mask FROM k)"""


@query(f"WITH {_L} SELECT vec_id, count(*) FILTER (mask) AS n_masked FROM m GROUP BY vec_id")
def relative_top_filter(spark: SparkSession, sf: str) -> DataFrame:
    mask = arrays.relative_top_mask(F.col("base"), SHARE)
    return _logits(spark, sf).select("vec_id", F.size(F.filter(mask, lambda b: b)).cast("long").alias("n_masked"))


@query(f"WITH {_L} SELECT vec_id, round(sum(base + CASE WHEN mask THEN 0 ELSE -0.8::DOUBLE * a1 + 0.8::DOUBLE * a2 END), 6) AS total, round(max(base + CASE WHEN mask THEN 0 ELSE -0.8::DOUBLE * a1 + 0.8::DOUBLE * a2 END), 6) AS top FROM m GROUP BY vec_id")
def dual_compose(spark: SparkSession, sf: str) -> DataFrame:
    mask = arrays.relative_top_mask(F.col("base"), SHARE)
    made = _logits(spark, sf).withColumn("mask", mask).withColumn("s", arrays.composed(F.col("base"), [(F.col("a1"), W1), (F.col("a2"), W2)], F.col("mask")))
    return made.select("vec_id", F.round(arrays.total(F.col("s")), 6).alias("total"), F.round(F.array_max("s"), 6).alias("top"))


@query(f"WITH {_L} SELECT vec_id, round(sum(base - 0.75::DOUBLE * a1), 6) AS total, round(max(base - 0.75::DOUBLE * a1), 6) AS top FROM m GROUP BY vec_id")
def single_compose(spark: SparkSession, sf: str) -> DataFrame:
    made = _logits(spark, sf).withColumn("s", arrays.composed(F.col("base"), [(F.col("a1"), -0.75)]))
    return made.select("vec_id", F.round(arrays.total(F.col("s")), 6).alias("total"), F.round(F.array_max("s"), 6).alias("top"))


@query(f"""WITH {_L} SELECT vec_id, round(sum(CASE WHEN mask THEN -1000.0::DOUBLE ELSE base - 0.8::DOUBLE * a1 + 0.8::DOUBLE * a2 END), 6) AS filtered, round(sum(lp - 0.8::DOUBLE * lp1 + 0.8::DOUBLE * lp2), 6) AS unfiltered FROM m GROUP BY vec_id""")
def decode_compose(spark: SparkSession, sf: str) -> DataFrame:
    parts = [(F.col("a1"), W1), (F.col("a2"), W2)]
    made = _logits(spark, sf).select("vec_id", arrays.decoding_scores(F.col("base"), parts, SHARE).alias("f"), arrays.decoding_scores(F.col("base"), parts).alias("u"))
    return made.select("vec_id", F.round(arrays.total(F.col("f")), 6).alias("filtered"), F.round(arrays.total(F.col("u")), 6).alias("unfiltered"))


@query(f"WITH {_L} SELECT vec_id, CAST(arg_max(v, base - 0.8::DOUBLE * a1 + 0.8::DOUBLE * a2) FILTER (NOT mask) AS INTEGER) AS token FROM m GROUP BY vec_id")
def greedy_argmax(spark: SparkSession, sf: str) -> DataFrame:
    made = _logits(spark, sf).withColumn("mask", arrays.relative_top_mask(F.col("base"), SHARE))
    made = made.withColumn("s", arrays.composed(F.col("base"), [(F.col("a1"), W1), (F.col("a2"), W2)], F.col("mask")))
    return made.select("vec_id", arrays.greedy(F.col("s"), F.col("mask")).alias("token"))


@query(f"""WITH {_L}, u AS (SELECT vec_id, CAST('0x' || substr(md5('42|' || vec_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM embeddings), s AS (SELECT vec_id, v, sum(exp(lp)) OVER (PARTITION BY vec_id ORDER BY v) AS upto FROM p)
SELECT vec_id, CAST(least(count(*) FILTER (upto <= u), 63) AS INTEGER) AS token FROM s JOIN u USING (vec_id) GROUP BY vec_id""")
def sampled_token(spark: SparkSession, sf: str) -> DataFrame:
    made = _logits(spark, sf).withColumn("u", ranks.hash_number(42, "vec_id") / F.lit(float(1 << 32)))
    return made.select("vec_id", arrays.sampled(F.col("base"), F.col("u")).alias("token"))


@query(f"WITH {_L} SELECT vec_id, round(max(exp(lp)), 6) AS top, round(sum(exp(lp)), 6) AS total FROM p GROUP BY vec_id")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    s = _logits(spark, sf).select("vec_id", arrays.softmax(F.col("base")).alias("s"))
    return s.select("vec_id", F.round(F.array_max("s"), 6).alias("top"), F.round(arrays.total(F.col("s")), 6).alias("total"))


@query(f"WITH {_L} SELECT vec_id, round(max(lp), 6) AS top, round(sum(lp), 6) AS total FROM p GROUP BY vec_id")
def log_softmax(spark: SparkSession, sf: str) -> DataFrame:
    s = _logits(spark, sf).select("vec_id", arrays.log_softmax(F.col("base")).alias("s"))
    return s.select("vec_id", F.round(F.array_max("s"), 6).alias("top"), F.round(arrays.total(F.col("s")), 6).alias("total"))


# -- losses of sequences ----------------------------------------------------------------------------------------------

_I = f"""WITH {ANSWER_SCORES}, i AS (SELECT item, max(n_tokens) FILTER (kind = 'answer') AS n, max(sum_loss) FILTER (kind = 'answer') AS win, max(sum_loss_ref) FILTER (kind = 'answer') AS win_ref,
  max(sum_loss) FILTER (answer_pos = 1) AS lose, max(sum_loss_ref) FILTER (answer_pos = 1) AS lose_ref FROM item_scores GROUP BY item)"""
_LS = "(least({0}, 0) - ln(1 + exp(-abs({0}))))"


def _seq(spark: SparkSession, sf: str) -> DataFrame:
    """item, n, and the summed losses of the answer (win) and of a wrong one (lose) under the target and the reference."""
    mine, ref = answer_scores(spark, sf), answer_scores(spark, sf, "retrain")
    key = ["item", "kind", "answer_pos"]
    both = mine.select(*key, "n_tokens", "sum_loss").join(ref.select(*key, F.col("sum_loss").alias("ref_loss")), key)

    def pick(where, c):
        return F.max(F.when(where, F.col(c)))

    win, lose = F.col("kind") == "answer", F.col("answer_pos") == 1
    return both.groupBy("item").agg(pick(win, "n_tokens").alias("n"), pick(win, "sum_loss").alias("win"), pick(win, "ref_loss").alias("win_ref"), pick(lose, "sum_loss").alias("lose"), pick(lose, "ref_loss").alias("lose_ref"))


@query(f"{_I} SELECT item, round(win, 6) AS loss FROM i")
def loss_nll(spark: SparkSession, sf: str) -> DataFrame:
    return _seq(spark, sf).select("item", F.round("win", 6).alias("loss"))


@query(f"{_I} SELECT round(-avg(win / n), 6) AS ascent, round(avg(win / n), 6) AS descent FROM i")
def loss_gradient(spark: SparkSession, sf: str) -> DataFrame:
    mean = F.col("win") / F.col("n")
    return _seq(spark, sf).agg(F.round(losses.gradient_ascent(mean), 6).alias("ascent"), F.round(F.avg(mean), 6).alias("descent"))


@query(f"{_I} SELECT item, round(-win / n + lose / n, 6) AS loss FROM i")
def loss_graddiff(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    return _seq(spark, sf).select("item", F.round(losses.grad_diff(F.col("win") / n, F.col("lose") / n), 6).alias("loss"))


@query(f"{_I} SELECT item, round(-20 * {_LS.format('(0.1::DOUBLE * ((win_ref - win) - (lose_ref - lose)))')}, 6) AS loss FROM i")
def loss_dpo(spark: SparkSession, sf: str) -> DataFrame:
    s = _seq(spark, sf)
    return s.select("item", F.round(losses.dpo(F.col("win"), F.col("win_ref"), F.col("lose"), F.col("lose_ref")), 6).alias("loss"))


@query(f"{_I} SELECT item, round(-20 * {_LS.format('(0.1::DOUBLE * (lose - lose_ref))')}, 6) AS loss FROM i")
def loss_npo(spark: SparkSession, sf: str) -> DataFrame:
    return _seq(spark, sf).select("item", F.round(losses.npo(F.col("lose"), F.col("lose_ref")), 6).alias("loss"))


@query(f"{_I} SELECT item, round(-2 / 0.5::DOUBLE * {_LS.format('(0.5::DOUBLE * (win / n - 0.5))')}, 6) AS loss FROM i")
def loss_simnpo(spark: SparkSession, sf: str) -> DataFrame:
    return _seq(spark, sf).select("item", F.round(losses.simnpo(F.col("win"), F.col("n"), beta=0.5, delta=0.5), 6).alias("loss"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    from lethewise.operators import scoring

    return scoring.token_scores(answer_tokens(spark, sf).where("kind = 'answer'"), answer_logprobs(spark, sf))


@query(f"WITH {ANSWER_SCORES} SELECT item, round(avg(exp(lp_target) * lp_target), 6) AS loss FROM token_scores WHERE kind = 'answer' GROUP BY item")
def loss_wga(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).groupBy("item").agg(F.round(F.avg(losses.wga(F.col("lp_target"))), 6).alias("loss"))


@query(f"WITH {ANSWER_SCORES} SELECT item, round(avg(exp(lp_target) * (1 - exp(lp_target)) * lp_target), 6) AS loss FROM token_scores WHERE kind = 'answer' GROUP BY item")
def loss_satimp(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).groupBy("item").agg(F.round(F.avg(losses.satimp(F.col("lp_target"), beta1=1.0)), 6).alias("loss"))


@query(f"{_I} SELECT round(avg(CASE WHEN item % 2 = 0 THEN win / n END) + 5 * avg(CASE WHEN item % 2 = 1 THEN lose / n END), 6) AS loss FROM i")
def loss_role_split(spark: SparkSession, sf: str) -> DataFrame:
    s = _seq(spark, sf)
    loss = F.when(F.col("item") % 2 == 0, F.col("win") / F.col("n")).otherwise(F.col("lose") / F.col("n"))
    return s.agg(F.round(losses.role_split(F.col("item") % 2, loss, 5.0), 6).alias("loss"))


@query(f"""{_I} SELECT item, round(-(exp(-win / n) - exp(exp(-lose / n) - 1)), 6) AS kl, round(-((exp(exp(-win / n)) - exp(-exp(-win / n))) / (exp(exp(-win / n)) + exp(-exp(-win / n))) / 2 - (exp(exp(-lose / n)) - exp(-exp(-lose / n))) / (exp(exp(-lose / n)) + exp(-exp(-lose / n))) / 2), 6) AS tv,
  round(-((ln(2::DOUBLE) - ln(1 + exp(-exp(-win / n)))) + ln(2 - exp(ln(2::DOUBLE) - ln(1 + exp(-exp(-lose / n)))))), 6) AS js FROM i""")
def loss_flat(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = F.exp(-F.col("win") / F.col("n")), F.exp(-F.col("lose") / F.col("n"))
    return _seq(spark, sf).select("item", F.round(losses.flat(good, bad, "kl"), 6).alias("kl"), F.round(losses.flat(good, bad, "tv"), 6).alias("tv"), F.round(losses.flat(good, bad, "js"), 6).alias("js"))


# -- losses of positions ----------------------------------------------------------------------------------------------

def _each(spark: SparkSession, sf: str, loss) -> DataFrame:
    return _logits(spark, sf).select("vec_id", F.round(loss, 6).alias("loss"))


@query(f"WITH {_L} SELECT vec_id, round(sum(exp(lp1) * (lp1 - lp)), 6) AS loss FROM p GROUP BY vec_id")
def loss_kl(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, losses.kl_to_reference(F.col("a1"), F.col("base")))


@query(f"WITH {_L} SELECT vec_id, round(-sum(CASE WHEN v <> target THEN exp(base) * lp ELSE 0 END) / sum(CASE WHEN v <> target THEN exp(base) ELSE 0 END), 6) AS loss FROM p GROUP BY vec_id")
def loss_ceu(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, losses.ceu(F.col("base"), F.col("target")))


@query(f"WITH {_L}, t AS (SELECT *, a1 - CASE WHEN v = target THEN 10 ELSE 0 END AS low FROM p) SELECT vec_id, round(-sum(exp(low) * lp) / sum(exp(low)), 6) AS loss FROM t GROUP BY vec_id")
def loss_undial(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, losses.undial(F.col("base"), F.col("a1"), F.col("target")))


@query(f"WITH {_L} SELECT vec_id, round(-avg(lp) - ln(64), 6) AS loss, round(-avg(lp) + ln(64), 6) AS loss_chunks FROM p GROUP BY vec_id")
def loss_uniform(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("base")
    return _logits(spark, sf).select("vec_id", F.round(losses.uniform_kl(b), 6).alias("loss"), F.round(losses.uniform_kl(b, False), 6).alias("loss_chunks"))


@query(f"WITH {_L}, t AS (SELECT *, exp(lp) AS q, max(CASE WHEN v = target THEN exp(lp) END) OVER (PARTITION BY vec_id) AS at FROM p) SELECT vec_id, round(sum(q * (lp - ln(CASE WHEN v = target THEN 1 / 64.0::DOUBLE ELSE q * (1 - 1 / 64.0::DOUBLE) / (1 - at) END))), 6) AS loss FROM t GROUP BY vec_id".replace("AS at", "AS hit").replace("- at)", "- hit)"))
def loss_unilogit(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, losses.unilogit(F.col("base"), F.col("target")))


@query(f"WITH {_L} SELECT vec_id, round(pow(max(base) - avg(base), 2), 6) AS loss FROM p GROUP BY vec_id")
def loss_pdu_forget(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, losses.pdu_forget(F.col("base")))


@query(f"WITH {_L} SELECT target, round(avg(d), 6) AS loss FROM (SELECT vec_id, target, avg((base - a1) * (base - a1)) AS d FROM x GROUP BY vec_id, target) GROUP BY target")
def loss_rmu(spark: SparkSession, sf: str) -> DataFrame:
    return _logits(spark, sf).groupBy("target").agg(F.round(losses.masked_mse(F.col("base"), F.col("a1"), F.lit(True)), 6).alias("loss"))


@query(f"WITH {_L}, t AS (SELECT vec_id, max(-lp) FILTER (v = target) AS ce, -avg(lp) - ln(64) AS u FROM p GROUP BY vec_id) SELECT round(avg(ce) FILTER (vec_id % 2 = 0) + 0.5::DOUBLE * avg(u) FILTER (vec_id % 2 = 1), 6) AS loss FROM t")
def loss_remember_uniform(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("base")
    nll = -F.get(arrays.log_softmax(b), F.col("target"))
    each = _logits(spark, sf).select((F.col("vec_id") % 2).alias("role"), nll.alias("nll"), losses.uniform_kl(b).alias("u"))
    return each.agg(F.round(losses.remember_and_flatten(F.col("role"), F.col("nll"), F.col("u"), 0.5), 6).alias("loss"))


@query("""WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), d(user_id, r, dual) AS (
SELECT user_id, 1, greatest(0, 0.1::DOUBLE * (value - 40)) FROM s WHERE r = 1 UNION ALL SELECT s.user_id, s.r, greatest(0, dual + 0.1::DOUBLE * (s.value - 40)) FROM d JOIN s ON s.user_id = d.user_id AND s.r = d.r + 1)
SELECT user_id, count(*) AS n_steps, round(max(dual), 4) AS top, round(arg_max(dual, r), 4) AS last FROM d GROUP BY user_id""")
def pdu_dual_updates(spark: SparkSession, sf: str) -> DataFrame:
    """The dual weight of each run (here a user's events, in order) after every step."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    d = e.select("user_id", losses.pdu_duals(F.transform("s", lambda x: x["value"]), 40.0, 0.1).alias("d"))
    return d.select("user_id", F.size("d").cast("long").alias("n_steps"), F.round(F.array_max("d"), 4).alias("top"), F.round(F.element_at("d", -1), 4).alias("last"))

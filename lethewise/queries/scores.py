"""Queries of scoring, memorisation, attacks and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise.functions import arrays, stats
from lethewise.functions import text as tx
from lethewise.operators import generation, metrics, scoring, select
from lethewise.plans import metric_plan, sweep

from .frames import ANSWER_SCORES, ANSWERS, DOC_PROBS, MODELS, WORDS, answer_logprobs, answer_scores, answer_tokens, document_scores, documents, table, unnested

QUERIES, ORACLE_SQL = {}, {}
SHARE = 0.4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(name: str, to: str | None = None):
    return F.round(name, 6).alias(to or name)


def _mean(model: str):
    """Mean log p of a text's counted tokens."""
    return F.sum(F.col("c") * F.col(f"lp_{model}")) / F.sum("c")


# -- scores -----------------------------------------------------------------------------------------------------------

@query(f"WITH {DOC_PROBS} SELECT doc_id, count(*) AS n_tokens, " + ", ".join(f"round(-avg(lp_{m}), 6) AS loss_{m}" for m in MODELS) + " FROM scores GROUP BY doc_id")
def unigram_scores(spark: SparkSession, sf: str) -> DataFrame:
    s, _ = document_scores(spark, sf)
    return s.groupBy("doc_id").agg(F.sum("c").alias("n_tokens"), *[F.round(-_mean(m), 6).alias(f"loss_{m}") for m in MODELS])


_BIGRAM = f"""{ANSWER_SCORES}, seq AS (SELECT item, pos, token, lag(token) OVER (PARTITION BY item ORDER BY pos) AS prev FROM answer_tokens WHERE kind = 'answer'
), n2 AS (SELECT prev, token, count(*) AS n2 FROM seq WHERE prev IS NOT NULL GROUP BY ALL
), best AS (SELECT prev, token AS pred_token FROM (SELECT prev, token, row_number() OVER (PARTITION BY prev ORDER BY n2 DESC, token) AS r FROM n2) WHERE r = 1
), n1 AS (SELECT prev, sum(n2) AS n1 FROM n2 GROUP BY prev
), predicted AS (SELECT seq.item, seq.pos, seq.prev, seq.token, pred_token, ln(0.5::DOUBLE * n2 / n1 + 0.5::DOUBLE * exp(lp_target)) AS lp
  FROM seq JOIN n2 USING (prev, token) JOIN n1 USING (prev) JOIN best USING (prev) JOIN probs ON probs.token = seq.token)"""


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    tokens = answer_tokens(spark, sf).where("kind = 'answer'").select("item", "pos", "token")
    return scoring.bigram_scores(tokens, ["item"], answer_logprobs(spark, sf), "target")


@query(f"WITH {_BIGRAM} SELECT item, count(*) AS n_tokens, round(-avg(lp), 6) AS avg_loss FROM predicted GROUP BY item")
def bigram_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf).groupBy("item").agg(F.count("*").alias("n_tokens"), F.round(-F.avg("lp"), 6).alias("avg_loss"))


@query(f"WITH {ANSWER_SCORES} SELECT item, kind, answer_pos, n_tokens, round(avg_loss, 6) AS avg_loss, round(prob, 6) AS prob FROM item_scores")
def item_probability(spark: SparkSession, sf: str) -> DataFrame:
    return answer_scores(spark, sf).select("item", "kind", "answer_pos", "n_tokens", _r("avg_loss"), _r("prob"))


@query(f"WITH {ANSWER_SCORES} SELECT kind, round(avg(p), 6) AS prob FROM (SELECT kind, item, avg(prob) AS p FROM item_scores GROUP BY ALL) GROUP BY kind")
def mean_probability(spark: SparkSession, sf: str) -> DataFrame:
    per_item = answer_scores(spark, sf).groupBy("kind", "item").agg(F.avg("prob").alias("p"))
    return per_item.groupBy("kind").agg(F.round(F.avg("p"), 6).alias("prob"))


@query(f"WITH {ANSWER_SCORES} SELECT item, round(sum(CASE WHEN kind = 'answer' THEN prob END) / (sum(CASE WHEN kind = 'answer' THEN prob END) + sum(CASE WHEN kind = 'perturbed' THEN prob END) + 1e-10), 6) AS value FROM item_scores GROUP BY item HAVING value IS NOT NULL")
def prob_with_options(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.probability_with_options(answer_scores(spark, sf)).select("item", _r("value"))


_TR = f"WITH {ANSWER_SCORES}, t AS (SELECT item, exp(-avg(CASE WHEN kind = 'paraphrase' THEN avg_loss END)) AS a, exp(-avg(CASE WHEN kind = 'perturbed' THEN avg_loss END)) AS b FROM item_scores GROUP BY item)"


@query(f"{_TR} SELECT item, round(least(b / (a + 1e-10), 1 / (b / (a + 1e-10) + 1e-10)), 6) AS value FROM t")
def truth_ratio_forget(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.truth_ratio(answer_scores(spark, sf), "closer_to_1_better").select("item", _r("value"))


@query(f"{_TR} SELECT item, round(greatest(0, 1 - b / (a + 1e-10)), 6) AS value FROM t")
def truth_ratio_retain(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.truth_ratio(answer_scores(spark, sf), "true_better").select("item", _r("value"))


@query(f"{_TR} SELECT item, round(a / (a + b + 1e-10), 6) AS value FROM t")
def truth_ratio_prob_mean(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.truth_ratio(answer_scores(spark, sf), "prob_mean").select("item", _r("value"))


@query(f"WITH {_BIGRAM} SELECT item, round(avg(CASE WHEN pred_token = token THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS value FROM predicted GROUP BY item")
def exact_memorization(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.exact_memorization(_predicted(spark, sf)).select("item", _r("value"))


@query(f"""WITH {_BIGRAM}, n AS (SELECT item, row_number() OVER (PARTITION BY item ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY item) AS n, pred_token <> token AS missed FROM predicted)
SELECT items.item, round(coalesce(value, 0), 6) AS value FROM items LEFT JOIN (SELECT item, 1 - least(coalesce(max(CASE WHEN missed THEN i END) + 1, 0), max(n) - 1)::DOUBLE / max(n) AS value FROM n GROUP BY item) s ON s.item = items.item""")
def extraction_strength(spark: SparkSession, sf: str) -> DataFrame:
    from .frames import items

    strength = metrics.extraction_strength(_predicted(spark, sf))
    return metrics.strength_with_empty(items(spark, sf), strength).select("item", _r("value"))


@query(f"WITH {_BIGRAM} SELECT round(avg(CASE WHEN pred_token = token THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy, count(*) AS n_tokens FROM predicted")
def token_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf).agg(F.round(F.avg((F.col("pred_token") == F.col("token")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n_tokens"))


@query(f"WITH {ANSWERS}, t AS ({unnested(WORDS.format('answer'), 'items', 'item')}) SELECT item, pos, token, lead(token) OVER (PARTITION BY item ORDER BY pos) AS next_token FROM t")
def next_token_shift(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    t = answer_tokens(spark, sf).where("kind = 'answer'").select("item", F.col("pos").cast("long").alias("pos"), "token")
    return t.withColumn("next_token", F.lead("token").over(Window.partitionBy("item").orderBy("pos")))


@query(f"WITH {ANSWERS}, t AS ({unnested(WORDS.format('answer'), 'items', 'item')}) SELECT item, count(*) FILTER (r > 5) AS n_scored FROM (SELECT item, row_number() OVER (PARTITION BY item ORDER BY pos) AS r FROM t) GROUP BY item")
def masked_first_n(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    t = answer_tokens(spark, sf).where("kind = 'answer'")
    upto = F.sum(F.lit(1)).over(Window.partitionBy("item").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("upto", upto).groupBy("item").agg(F.count(F.when(F.col("upto") > 5, 1)).alias("n_scored"))


@query(f"WITH {ANSWER_SCORES} SELECT item, count(*) - 1 AS n_tokens, round(sum(lp_target) FILTER (pos < last), 6) AS lp FROM (SELECT *, max(pos) OVER (PARTITION BY item) AS last FROM token_scores WHERE kind = 'answer') GROUP BY item HAVING count(*) > 1")
def drop_last_target(spark: SparkSession, sf: str) -> DataFrame:
    s = scoring.token_scores(answer_tokens(spark, sf).where("kind = 'answer'"), answer_logprobs(spark, sf))
    return metrics.without_last_target(s, "item").groupBy("item").agg(F.count("*").alias("n_tokens"), F.round(F.sum("lp_target"), 6).alias("lp"))


@query(f"WITH {ANSWERS}, t AS ({unnested(WORDS.format('answer'), 'items', 'item')}), n AS (SELECT item, pos, contains(string_agg(token, ' ') OVER (PARTITION BY item ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 'of the') AS found FROM t), d AS (SELECT item, pos, max(found) OVER (PARTITION BY item ORDER BY pos) AS done FROM n) SELECT item, count(*) FILTER (NOT done) AS n_before FROM d GROUP BY item")
def stop_flags(spark: SparkSession, sf: str) -> DataFrame:
    t = answer_tokens(spark, sf).where("kind = 'answer'").select("item", "pos", "token")
    return generation.stop_flags(t, "item", "of the", 2).groupBy("item").agg(F.count(F.when(~F.col("done"), 1)).alias("n_before"))


@query(f"""WITH RECURSIVE {_BIGRAM}, starts AS (SELECT item, {WORDS.format('question')}[1] AS token FROM items), g(item, last, words, step) AS (
SELECT item, token, CAST([] AS VARCHAR[]), 0 FROM starts UNION ALL SELECT item, pred_token, list_append(words, pred_token), step + 1 FROM g JOIN best ON best.prev = g.last WHERE step < 8)
SELECT item, arg_max(array_to_string(words, ' '), step) AS generated FROM g GROUP BY item""")
def greedy_continuation(spark: SparkSession, sf: str) -> DataFrame:
    from .frames import items

    tokens = answer_tokens(spark, sf).where("kind = 'answer'").select("item", "pos", "token")
    starts = items(spark, sf).select("item", F.get(tx.words("question"), 0).alias("token"))
    made = generation.greedy_continuation(starts, generation.next_tokens(tokens, ["item"]), "item", 8)
    return made.select("item", F.array_join("generated", " ").alias("generated"))


# -- attacks: forget documents are members (0), holdout documents are not (1) -----------------------------------------

def _marked(scores: DataFrame) -> DataFrame:
    label = F.when(F.col("doc_id") % 10 == 0, 0).when(F.col("doc_id") % 10 == 1, 1)
    return scores.withColumn("label", label).where("label is not null").withColumn("score", F.round("score", 9))


def _auc(scores: DataFrame, name: str) -> DataFrame:
    """The area for scores by doc_id."""
    return stats.auc(_marked(scores), "score", "label").select(F.lit(name).alias("attack"), _r("auc"))


def _loss(s: DataFrame) -> DataFrame:
    return s.groupBy("doc_id").agg((-_mean("retrain")).alias("score"))


def _against(s: DataFrame) -> DataFrame:
    return s.groupBy("doc_id").agg((_mean("reference") - _mean("retrain")).alias("score"))


def _standard(s: DataFrame, probs: DataFrame) -> DataFrame:
    with_moments = s.join(F.broadcast(scoring.vocabulary_moments(probs, "retrain")))
    z = (F.col("lp_retrain") - F.col("mu")) / F.sqrt(F.greatest(F.col("sigma2"), F.lit(1e-6)))
    return metrics.min_k_counted(with_moments.withColumn("z", z), "doc_id", "z", SHARE)


_AUC = """, l AS (SELECT round(score, 9) AS s, doc_id % 10 AS y FROM attack WHERE doc_id % 10 IN (0, 1)), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM l)
SELECT '{}' AS attack, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 6) AS auc FROM k"""


@query(f"WITH {DOC_PROBS}, attack AS (SELECT doc_id, -avg(lp_retrain) AS score FROM scores GROUP BY doc_id)" + _AUC.format("loss"))
def mia_loss_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _auc(_loss(document_scores(spark, sf)[0]), "loss")


@query(f"WITH {DOC_PROBS}, attack AS (SELECT doc_id, avg(lp_reference) - avg(lp_retrain) AS score FROM scores GROUP BY doc_id)" + _AUC.format("reference"))
def mia_reference_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _auc(_against(document_scores(spark, sf)[0]), "reference")


_LOW = "SELECT doc_id, -avg(v) AS score FROM (SELECT doc_id, {0} AS v, row_number() OVER (PARTITION BY doc_id ORDER BY {0}, pos) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM {1}) WHERE r <= greatest(1, CAST(floor(n * 0.4::DOUBLE) AS INTEGER)) GROUP BY doc_id"


@query(f"WITH {DOC_PROBS}, attack AS ({_LOW.format('lp_retrain', 'scores')})" + _AUC.format("min_k"))
def mia_min_k_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _auc(metrics.min_k_counted(document_scores(spark, sf)[0], "doc_id", "lp_retrain", SHARE), "min_k")


_MOMENTS = "moments AS (SELECT sum(exp(lp_retrain) * lp_retrain) AS mu, sum(exp(lp_retrain) * lp_retrain * lp_retrain) AS sq FROM probs)"


@query(f"WITH {DOC_PROBS}, {_MOMENTS}, z AS (SELECT doc_id, pos, (lp_retrain - mu) / sqrt(greatest(sq - mu * mu, 1e-6)) AS z FROM scores, moments), attack AS ({_LOW.format('z', 'z')})" + _AUC.format("min_k_plus_plus"))
def mia_min_k_pp_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Moments of a unigram scorer, the same at every place: it ranks as ``mia_min_k_auc`` does. ``mia_min_k_pp_context`` has
    moments of each context."""
    return _auc(_standard(*document_scores(spark, sf)), "min_k_plus_plus")


@query()
def mia_zlib_auc(spark: SparkSession, sf: str) -> DataFrame:
    loss = _loss(document_scores(spark, sf)[0]).withColumnRenamed("score", "loss")
    size = documents(spark, sf).select("doc_id", tx.zlib_length("text").alias("n"))
    return _auc(loss.join(size, "doc_id").select("doc_id", (F.col("loss") / F.col("n")).alias("score")), "zlib")


@query(f"WITH {DOC_PROBS}, d AS (SELECT doc_id, token, count(*) AS c, any_value(lp_retrain) AS lp FROM scores GROUP BY doc_id, token), n AS (SELECT doc_id, sum(c) AS n FROM d GROUP BY doc_id), s AS (SELECT sum(exp(2 * lp_retrain)) AS pp FROM probs)"
       ", attack AS (SELECT doc_id, sqrt(greatest(any_value(pp) + sum(pow(c / n, 2) - 2 * exp(lp) * c / n), 0)) AS score FROM d JOIN n USING (doc_id), s GROUP BY doc_id)" + _AUC.format("gradient_norm_closed_form"))
def mia_gradnorm_auc(spark: SparkSession, sf: str) -> DataFrame:
    """The norm of p_v - count_v / n over the vocabulary: the closed form for a unigram scorer, not a network's gradient."""
    s, probs = document_scores(spark, sf)
    by_token = s.select("doc_id", "token", "c", F.col("lp_retrain").alias("lp"))
    n = by_token.groupBy("doc_id").agg(F.sum("c").alias("n"))
    pp = probs.agg(F.sum(F.exp(2 * F.col("lp_retrain"))).alias("pp"))
    share = F.col("c") / F.col("n")
    each = by_token.join(n, "doc_id").groupBy("doc_id").agg(F.sum(share * share - 2 * F.exp("lp") * share).alias("d")).join(F.broadcast(pp))
    return _auc(each.select("doc_id", F.sqrt(F.greatest(F.col("pp") + F.col("d"), F.lit(0.0))).alias("score")), "gradient_norm_closed_form")


_SIDES = "SELECT '{0}' AS attack, round(avg(score) FILTER (doc_id % 10 = 0), 6) AS mean_forget, round(avg(score) FILTER (doc_id % 10 = 1), 6) AS mean_holdout FROM ({1})"


@query(f"WITH {DOC_PROBS}, {_MOMENTS}, z AS (SELECT doc_id, pos, (lp_retrain - mu) / sqrt(greatest(sq - mu * mu, 1e-6)) AS z FROM scores, moments) " + " UNION ALL ".join(_SIDES.format(n, f"SELECT doc_id, round(score, 9) AS score FROM ({q})") for n, q in (
    ("loss", "SELECT doc_id, -avg(lp_retrain) AS score FROM scores GROUP BY doc_id"), ("reference", "SELECT doc_id, avg(lp_reference) - avg(lp_retrain) AS score FROM scores GROUP BY doc_id"),
    ("min_k", _LOW.format("lp_retrain", "scores")), ("min_k_plus_plus", _LOW.format("z", "z")))))
def attack_means(spark: SparkSession, sf: str) -> DataFrame:
    """The mean score of each side under four attacks, all from one table of scores."""
    s, probs = document_scores(spark, sf)
    out = None
    for name, scores in (("loss", _loss(s)), ("reference", _against(s)), ("min_k", metrics.min_k_counted(s, "doc_id", "lp_retrain", SHARE)), ("min_k_plus_plus", _standard(s, probs))):
        side = [F.round(F.avg(F.when(F.col("label") == k, F.col("score"))), 6).alias(c) for k, c in enumerate(("mean_forget", "mean_holdout"))]
        one = _marked(scores).agg(*side).select(F.lit(name).alias("attack"), "mean_forget", "mean_holdout")
        out = one if out is None else out.unionByName(one)
    return out


# -- statistics -------------------------------------------------------------------------------------------------------

_LAB = "l AS (SELECT n_chars AS s, {0} AS y FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_LAB.format('toxic')}, k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM l) SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 6) AS auc FROM k")
def auc_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return stats.auc(d, "n_chars", "toxic").select(_r("auc"))


@query(f"WITH {_LAB.format('quality')}, c AS (SELECT s, sum(count(*) FILTER (y = 0)) OVER w AS c0, sum(count(*) FILTER (y <> 0)) OVER w AS c1 FROM l GROUP BY s WINDOW w AS (ORDER BY s)) SELECT round(max(abs(c0 / n0 - c1 / n1)), 6) AS ks FROM c, (SELECT count(*) FILTER (y = 0)::DOUBLE AS n0, count(*) FILTER (y <> 0)::DOUBLE AS n1 FROM l)")
def ks_statistic(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return stats.ks_statistic(d, "n_chars", "quality").select(_r("ks"))


@query()
def ks_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    row = stats.ks_statistic(d, "n_chars", "quality").first()
    return spark.createDataFrame([(row.ks, row.n0, row.n1, stats.ks_pvalue(row.ks, row.n0, row.n1))], "ks double, n0 long, n1 long, p_value double")


@query("SELECT lang, round(CASE WHEN min(n_chars) = 0 THEN 0 ELSE count(n_chars) / sum(1.0::DOUBLE / nullif(n_chars, 0)) END, 6) AS hm FROM documents GROUP BY lang")
def harmonic_mean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(stats.harmonic_mean(F.col("n_chars").cast("double")), 6).alias("hm"))


_SHARES = "SELECT source, avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0 END) AS a FROM documents GROUP BY source"


@query(f"SELECT source, round(((1 - a) - 0.5::DOUBLE) / (0.5::DOUBLE + 1e-10) * 100, 6) AS value FROM ({_SHARES})")
def privleak(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").groupBy("source").agg(F.avg((F.col("lang") == "en").cast("double")).alias("a"))
    return a.select("source", F.round(stats.privacy_leakage(F.col("a"), F.lit(0.5)), 6).alias("value"))


@query(f"SELECT source, round((a - 0.5::DOUBLE) / (0.5::DOUBLE + 1e-10) * 100, 6) AS value FROM ({_SHARES})")
def rel_diff(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").groupBy("source").agg(F.avg((F.col("lang") == "en").cast("double")).alias("a"))
    return a.select("source", F.round(stats.relative_change(F.col("a"), F.lit(0.5)), 6).alias("value"))


@query("SELECT n_chars AS median FROM (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS r, count(*) OVER () AS n FROM documents) WHERE r = (n + 1) // 2")
def lower_median(spark: SparkSession, sf: str) -> DataFrame:
    return stats.lower_median(table(spark, sf, "documents"), "n_chars")


@query(f"WITH {ANSWER_SCORES} SELECT item, list(n_tokens ORDER BY answer_pos) AS answer_values FROM item_scores WHERE kind = 'perturbed' GROUP BY item")
def transpose_answers(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.transposed(answer_scores(spark, sf).where("kind = 'perturbed'"), "item", "answer_pos", "n_tokens")


@query("WITH e AS (SELECT label, unnest(range(1, 65)) AS place, unnest(embedding::DOUBLE[]) AS x, (vec_id % 3)::DOUBLE AS w FROM embeddings), p AS (SELECT label, place, sum(x * w) / greatest(sum(w), 1e-6) AS x FROM e GROUP BY ALL) SELECT label, round(sum(x), 6) AS total, round(sqrt(sum(x * x)), 6) AS norm FROM p GROUP BY label")
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    pooled = select.mean_pool(e, "label", F.col("embedding"), F.col("vec_id") % 3)
    return pooled.select("label", F.round(arrays.total(F.col("pooled")), 6).alias("total"), F.round(arrays.lp_norm(F.col("pooled"), 2), 6).alias("norm"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(list_sum(v) / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS total, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS norm_inf, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS norm_1 FROM e")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = arrays.doubles(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(arrays.total(arrays.l2_normalized(v)), 6).alias("total"), F.round(arrays.lp_norm(v, float("inf")), 6).alias("norm_inf"), F.round(arrays.lp_norm(v, 1), 6).alias("norm_1"))


# -- reports ----------------------------------------------------------------------------------------------------------

def _utility(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Results by name, from one plan in which the harmonic mean needs the others."""
    scores = answer_scores(spark, sf)
    plan = metric_plan.Plan(
        [
            metric_plan.Metric("model_utility", lambda *parts: _hm(parts), ("probability", "probability_w_options", "truth_ratio")),
            metric_plan.Metric("probability", lambda: scores.where("kind = 'answer'").select("item", F.col("prob").alias("value"))),
            metric_plan.Metric("probability_w_options", lambda: metrics.probability_with_options(scores)),
            metric_plan.Metric("truth_ratio", lambda: metrics.truth_ratio(scores, "true_better")),
        ]
    )
    return plan.run()


def _hm(parts: tuple[DataFrame, ...]) -> DataFrame:
    means = [p.agg(F.avg("value").alias("v")) for p in parts]
    out = means[0]
    for m in means[1:]:
        out = out.unionByName(m)
    return out.agg(stats.harmonic_mean(F.col("v")).alias("value"))


_PARTS = f"""WITH {ANSWER_SCORES}, t AS (SELECT item, exp(-avg(CASE WHEN kind = 'paraphrase' THEN avg_loss END)) AS a, exp(-avg(CASE WHEN kind = 'perturbed' THEN avg_loss END)) AS b,
  sum(CASE WHEN kind = 'answer' THEN prob END) AS p, sum(CASE WHEN kind = 'perturbed' THEN prob END) AS q FROM item_scores GROUP BY item),
m AS (SELECT 'probability' AS metric, avg(p) AS v FROM t UNION ALL SELECT 'probability_w_options', avg(p / (p + q + 1e-10)) FROM t UNION ALL SELECT 'truth_ratio', avg(greatest(0, 1 - b / (a + 1e-10))) FROM t)"""


@query(f"{_PARTS} SELECT round(count(*) / sum(1 / v), 6) AS value FROM m")
def model_utility(spark: SparkSession, sf: str) -> DataFrame:
    return _utility(spark, sf)["model_utility"].select(_r("value"))


@query(f"{_PARTS} SELECT metric, round(v, 6) AS value FROM m UNION ALL SELECT 'model_utility', round(count(*) / sum(1 / v), 6) FROM m")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    found = _utility(spark, sf)
    return metric_plan.summary(found, list(found)).select("metric", _r("value"))


@query(f"{_TR}, l AS (SELECT round(b / (a + 1e-10), 9) AS s, CASE WHEN split = 'forget' THEN 0 ELSE 1 END AS y FROM t JOIN items USING (item)), c AS (SELECT s, sum(count(*) FILTER (y = 0)) OVER w AS c0, sum(count(*) FILTER (y = 1)) OVER w AS c1 FROM l GROUP BY s WINDOW w AS (ORDER BY s)) SELECT round(max(abs(c0 / n0 - c1 / n1)), 6) AS ks FROM c, (SELECT count(*) FILTER (y = 0)::DOUBLE AS n0, count(*) FILTER (y = 1)::DOUBLE AS n1 FROM l)")
def forget_quality_d(spark: SparkSession, sf: str) -> DataFrame:
    from .frames import items

    s = answer_scores(spark, sf)
    loss = [F.avg(F.when(F.col("kind") == k, F.col("avg_loss"))) for k in ("paraphrase", "perturbed")]
    ratio = s.groupBy("item").agg(F.round(F.exp(-loss[1]) / (F.exp(-loss[0]) + stats.EPS), 9).alias("ratio"))
    sides = ratio.join(items(spark, sf).select("item", F.when(F.col("split") == "forget", 0).otherwise(1).alias("side")), "item")
    return stats.ks_statistic(sides, "ratio", "side").select(_r("ks"))


_DERIVED = "SELECT source, avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0 END) AS fp, avg(CASE WHEN lang = 'de' THEN 1.0::DOUBLE ELSE 0.0 END) AS fr, avg(CASE WHEN lang = 'fr' THEN 1.0::DOUBLE ELSE 0.0 END) AS ft, avg(CASE WHEN lang <> 'es' THEN 1.0::DOUBLE ELSE 0.0 END) AS u FROM documents GROUP BY source"


@query(f"SELECT source, round(mem, 6) AS mem, round(2 / (1 / greatest(mem, 1e-6) + 1 / greatest(u, 1e-6)), 6) AS agg FROM (SELECT source, u, 3 / (1 / greatest(1 - fp, 1e-6) + 1 / greatest(1 - fr, 1e-6) + 1 / greatest(ft, 1e-6)) AS mem FROM ({_DERIVED}))")
def derived_mem_agg(spark: SparkSession, sf: str) -> DataFrame:
    def share(c):
        return F.avg(c.cast("double"))

    d = table(spark, sf, "documents").groupBy("source").agg(share(F.col("lang") == "en").alias("fp"), share(F.col("lang") == "de").alias("fr"), share(F.col("lang") == "fr").alias("ft"), share(F.col("lang") != "es").alias("u"))

    mem, agg = stats.memory_columns(*[F.col(c) for c in ("fp", "fr", "ft", "u")])
    return d.select("source", F.round(mem, 6).alias("mem"), F.round(agg, 6).alias("agg"))


@query("SELECT source AS config, round(avg(n_chars), 6) AS fq FROM documents GROUP BY source HAVING avg(n_chars) IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 5")
def top5_sweep(spark: SparkSession, sf: str) -> DataFrame:
    results = table(spark, sf, "documents").groupBy(F.col("source").alias("config")).agg(F.round(F.avg("n_chars"), 6).alias("fq"))
    return sweep.top_results(results, "fq")


@query("SELECT event_type, count(*) AS n_calls, round(avg(value), 6) AS mean_s, round(sum(value), 4) AS total_s FROM events GROUP BY event_type")
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = sweep.profile(table(spark, sf, "events"), "event_type", "value")
    return p.select("event_type", "n_calls", _r("mean_s"), F.round("total_s", 4).alias("total_s"))

"""Queries of templates, evaluation sets, roles of chunks, twins of metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise import tables
from lethewise.functions import arrays, stats
from lethewise.functions import text as tx
from lethewise.operators import metrics, prep, ranks, select
from lethewise.plans import sweep

from .frames import ANSWER_SCORES, ANSWERS, DOC_PROBS, DOCS, ITEMS, WORDS, answer_scores, answer_tokens, answers, document_scores, documents, embeddings, items, table, unnested
from .scores import _AUC, _auc

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- templates and columns --------------------------------------------------------------------------------------------

@query(f"WITH {ITEMS} SELECT item, CASE item % 3 WHEN 0 THEN '[INST] ' || trim(question) || ' [/INST]' || trim(answer) WHEN 1 THEN trim(question) || ' ' || answer ELSE answer END AS full_text, CASE item % 3 WHEN 0 THEN trim('[INST] ' || trim(question) || ' [/INST]') WHEN 1 THEN trim(question) || ' ' ELSE '' END AS open_text FROM items")
def instruction_forms(spark: SparkSession, sf: str) -> DataFrame:
    kind, q, a = F.col("item") % 3, F.col("question"), F.col("answer")
    columns = [F.when(kind == 0, q), F.when(kind == 0, a), F.when(kind == 1, q), F.when(kind == 1, a), F.when(kind == 2, a)]
    return items(spark, sf).select("item", tx.instruction_form(*columns).alias("full_text"), tx.instruction_form(*columns, open_turn=True).alias("open_text"))


@query(f"WITH {ITEMS} SELECT item, ['[INST] ' || trim(question) || ' [/INST]' || trim(answer), '[INST] ' || trim(question) || ' [/INST]so ' || trim(answer)] AS prompts FROM items")
def choice_prompts(spark: SparkSession, sf: str) -> DataFrame:
    a = F.trim("answer")
    return items(spark, sf).select("item", tx.choice_prompts(F.col("question"), F.array(a, F.concat(F.lit("so "), a))).alias("prompts"))


@query(f"WITH {ITEMS} SELECT item, split_part(question || ' [/INST]' || answer, ' [/INST]', 1) AS asked, split_part(question || ' [/INST]' || answer, ' [/INST]', 2) AS truth FROM items")
def marker_split(spark: SparkSession, sf: str) -> DataFrame:
    before, after = tx.around_marker(F.concat("question", F.lit(" [/INST]"), "answer"), " [/INST]")
    return items(spark, sf).select("item", before.alias("asked"), after.alias("truth"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%S') AS stamp FROM events")
def run_stamp(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", tx.run_stamp(F.col("ts")).alias("stamp"))


@query(f"WITH {ITEMS} SELECT item, answer AS original, question AS alternate FROM items")
def alternate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return prep.with_alternate(items(spark, sf), "answer", "question").select("item", "pair.original", "pair.alternate")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 IN (0, 1) THEN 'answer' ELSE 'paraphrased_answer' END AS answer_key FROM nation")
def answer_column(spark: SparkSession, sf: str) -> DataFrame:
    task = F.element_at(F.array(F.lit("real_authors"), F.lit("world_facts"), F.lit("forget")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", prep.answer_key(task).alias("answer_key"))


@query("SELECT r_regionkey, r_name FROM region WHERE regexp_full_match(r_name, 'A[SM].*A') AND r_name NOT LIKE '%M%'")
def only_match(spark: SparkSession, sf: str) -> DataFrame:
    return select.only_match(table(spark, sf, "region"), "r_name", "A[S].*A").select("r_regionkey", "r_name")


@query(rf"WITH {ITEMS}, t AS (SELECT item, {WORDS.format('answer')} AS w FROM items) SELECT item, CASE WHEN w[-1] = '.' THEN w ELSE list_append(w, '.') END AS tokens FROM t")
def append_end(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("item", tx.append_once(tx.words("answer"), F.lit(".")).alias("tokens"))


@query(rf"""WITH {ITEMS}, t AS (SELECT item, list_transform(list_slice({WORDS.format('answer')}, 1, 12), lambda x: length(x)) AS w FROM items)
SELECT item, list_concat(list_transform(range(0, 12 - len(w)), lambda x: 0), w) AS left_padded, list_concat(w, list_transform(range(0, 12 - len(w)), lambda x: 0)) AS right_padded FROM t""")
def padded_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(tx.truncated(tx.words("answer"), F.lit(12)), F.length)
    return items(spark, sf).select("item", tx.padded(ids, 12, 0, left=True).cast("array<bigint>").alias("left_padded"), tx.padded(ids, 12, 0).cast("array<bigint>").alias("right_padded"))


@query(rf"SELECT doc_id, md5(coalesce(list_aggregate({WORDS.format('text')}, 'string_agg', ' '), '')) AS words, md5(coalesce(text, '')) AS characters FROM documents")
def detokenized(spark: SparkSession, sf: str) -> DataFrame:
    """Texts through a tokenizer and back: words lose white space, characters nothing."""
    return table(spark, sf, "documents").select("doc_id", *[F.md5(tx.detokenized(tx.tokenized("text", n), n)).alias(n) for n in ("words", "characters")])


@query("SELECT source, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM documents WHERE text IS NOT NULL GROUP BY source")
def joined_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return prep.joined_texts(d, "source", "doc_id", "text").select("source", F.md5("text").alias("digest"))


# -- joins and rows ---------------------------------------------------------------------------------------------------

@query(f"WITH {DOCS}, f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM docs WHERE split = 'forget'), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS r FROM benchmark) SELECT doc_id, item_id FROM f JOIN b USING (r)")
def zip_loaders(spark: SparkSession, sf: str) -> DataFrame:
    forget = documents(spark, sf).where("split = 'forget'").select("doc_id")
    return prep.zipped(forget, table(spark, sf, "benchmark").select("item_id"), "doc_id", "item_id").select("doc_id", "item_id")


@query(f"WITH {DOCS} SELECT doc_id FROM docs WHERE split = 'holdout'")
def tail_without_clamp(spark: SparkSession, sf: str) -> DataFrame:
    """As many of the last rows as there are forget rows of all kinds: more than there are, so all come."""
    d = documents(spark, sf)
    return ranks.matched_tail(d.where("split = 'holdout'").select("doc_id"), "doc_id", d.count(), clamp=False)


@query("SELECT event_id FROM events WHERE event_type <> 'click' AND user_id % 7 <> 0")
def dropped_events(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").withColumn("logger", F.concat(F.lit("l"), (F.col("user_id") % 7).cast("string")))
    return prep.dropped_events(log, "event_type", "click", ("l0",)).select("event_id")


@query(f"WITH {DOCS} SELECT count(*) FILTER (split = 'forget') AS n_forget, count(*) FILTER (split = 'retain') AS n_retain FROM docs")
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return prep.split_sizes(documents(spark, sf), "split", ["forget", "retain"])


@query(f"""WITH {ITEMS}, w AS (SELECT (item - 1 + (SELECT count(*) FROM items)) % (SELECT count(*) FROM items) AS item, answer AS wrong FROM items)
SELECT 'forget' AS set, item, question, answer FROM items WHERE split = 'forget' UNION ALL SELECT 'retain', item, question, answer FROM items WHERE split = 'retain'
UNION ALL SELECT 'perturb', item, question, wrong FROM items JOIN w USING (item) WHERE split = 'forget' UNION ALL SELECT 'paraphrase', item, 'so ' || question, 'so ' || answer FROM items WHERE split = 'forget'""")
def evaluation_sets(spark: SparkSession, sf: str) -> DataFrame:
    wrong = answers(spark, sf).where("kind = 'perturbed'").groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("answer_pos", "text"))), lambda s: s["text"]).alias("perturbed_answer"))
    so = [F.concat(F.lit("so "), c).alias(f"paraphrased_{c}") for c in ("question", "answer")]
    return prep.evaluation_sets(items(spark, sf).select("item", "split", "question", "answer", *so).join(wrong, "item"))


_CHUNK_VECTORS = """v AS (SELECT label < 2 AS forget, vec_id // 4 AS chunk, unnest(range(1, 65)) AS place, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
c AS (SELECT forget, chunk, list(x ORDER BY place) AS e FROM (SELECT forget, chunk, place, avg(x) AS x FROM v GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH {_CHUNK_VECTORS}, s AS (SELECT a.chunk, round(max(list_dot_product(a.e, b.e) / greatest(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 1e-12)), 9) AS s FROM c a, c b WHERE NOT a.forget AND b.forget GROUP BY a.chunk),
r AS (SELECT chunk, row_number() OVER (ORDER BY s DESC, chunk) AS r, count(*) OVER () AS n FROM s) SELECT chunk, r <= greatest(1, CAST(round_even(0.4::DOUBLE * n, 0) AS BIGINT)) AS in_rsub FROM r""")
def rsub_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Retained chunks (here four vectors, pooled), the most similar share of them against the rest."""
    sides = []
    for side in embeddings(spark, sf):
        side = side.select(F.floor(F.col("vec_id") / 4).alias("chunk"), "embedding")
        sides.append(select.mean_pool(side, "chunk", F.col("embedding"), F.lit(1.0)))
    scored = tables.written(select.similarity(sides[1], sides[0], "chunk", "pooled").select("chunk", F.round("max_sim", 9).alias("s")), "scored")
    return select.top_share(scored, 0.4, "s", "chunk", "in_rsub").select("chunk", "in_rsub")


_ROLE_SOURCES = "n AS (SELECT count(*) FILTER (split = 'forget') AS f, count(*) FILTER (split = 'retain' AND doc_id % 3 = 0) AS near, count(*) FILTER (split = 'retain' AND doc_id % 3 <> 0) AS far, count(*) FILTER (split = 'holdout') AS h FROM docs)"


@query(f"WITH {DOCS}, {_ROLE_SOURCES} SELECT * FROM (SELECT 'a1' AS assistant, 0 AS role, f + near + f AS n FROM n UNION ALL SELECT 'a1', 1, h FROM n UNION ALL SELECT 'a2', 0, near FROM n UNION ALL SELECT 'a2 weighted', 0, near FROM n UNION ALL SELECT 'a2 weighted', 1, f + far + h FROM n) WHERE n > 0")
def role_compose_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Roles with augmented and perturbed rows and without the far ones; and without a weight for what is retained."""
    d = documents(spark, sf).select("doc_id", "split")
    forget, retain, other = (d.where(F.col("split") == s).select("doc_id") for s in ("forget", "retain", "holdout"))
    chosen = retain.where("doc_id % 3 = 0")
    parts = {
        "a1": select.compose_a1(forget, retain, chosen, "doc_id", augmented=forget, perturbed=other, far=False),
        "a2": select.compose_a2(forget, retain, chosen, "doc_id", perturbed=other, retain_weight=0),
        "a2 weighted": select.compose_a2(forget, retain, chosen, "doc_id", perturbed=other, retain_weight=2.0),
    }
    out = None
    for name, rows in parts.items():
        one = rows.groupBy("role").agg(F.count("*").alias("n")).select(F.lit(name).alias("assistant"), "role", "n")
        out = one if out is None else out.unionByName(one)
    return out


# -- metrics ----------------------------------------------------------------------------------------------------------

@query(f"WITH {ANSWERS}, t AS ({unnested(WORDS.format('answer'), 'items', 'item')}), e AS (SELECT item, min(pos) FILTER (length(token) > 3) AS a, max(pos) FILTER (length(token) > 3) AS b FROM t GROUP BY item) SELECT item, count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY pos)) AS digest FROM t JOIN e USING (item) WHERE pos BETWEEN a AND b GROUP BY item")
def target_window(spark: SparkSession, sf: str) -> DataFrame:
    t = answer_tokens(spark, sf).where("kind = 'answer'").select("item", "pos", "token")
    inside = metrics.target_window(t, "item", F.length("token") > 3).groupBy("item")
    return inside.agg(F.count("*").alias("n_tokens"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), " ")).alias("digest"))


_INV = f"WITH {ANSWER_SCORES}, t AS (SELECT item, exp(avg(CASE WHEN kind = 'perturbed' THEN avg_loss END) - avg(CASE WHEN kind = '{{0}}' THEN avg_loss END)) AS r FROM item_scores GROUP BY item)"


def _inverted(spark: SparkSession, sf: str, right: str) -> DataFrame:
    s = answer_scores(spark, sf).join(items(spark, sf).select("item", "split"), "item")
    return metrics.truth_ratio_inverted(s, F.col("split") == "forget", right=right)


@query(_INV.format("paraphrase") + " SELECT split, round(avg(CASE WHEN split = 'forget' THEN least(r, 1 / r) ELSE greatest(0, 1 - 1 / r) END), 6) AS value FROM t JOIN items USING (item) GROUP BY split")
def truth_ratio_inverted(spark: SparkSession, sf: str) -> DataFrame:
    each = _inverted(spark, sf, "paraphrase").join(items(spark, sf).select("item", "split"), "item")
    return each.groupBy("split").agg(F.round(F.avg("value"), 6).alias("value"))


@query(_INV.format("answer") + " SELECT item, round(r, 6) AS r FROM t WHERE r IS NOT NULL")
def truth_ratio_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    return _inverted(spark, sf, "answer").select("item", F.round("r", 6).alias("r"))


@query(_INV.format("paraphrase") + """, l AS (SELECT round(r, 9) AS s, CASE WHEN split = 'forget' THEN 0 ELSE 1 END AS y, row_number() OVER (PARTITION BY split = 'forget' ORDER BY item) AS p FROM t JOIN items USING (item) WHERE r IS NOT NULL),
k AS (SELECT * FROM l WHERE p <= (SELECT least(count(*) FILTER (y = 0), count(*) FILTER (y = 1)) FROM l)), c AS (SELECT s, sum(count(*) FILTER (y = 0)) OVER w AS c0, sum(count(*) FILTER (y = 1)) OVER w AS c1 FROM k GROUP BY s WINDOW w AS (ORDER BY s))
SELECT round(max(abs(c0 / n0 - c1 / n1)), 6) AS ks, any_value(n0)::BIGINT AS n FROM c, (SELECT count(*) FILTER (y = 0)::DOUBLE AS n0, count(*) FILTER (y = 1)::DOUBLE AS n1 FROM k)""")
def ks_truncated(spark: SparkSession, sf: str) -> DataFrame:
    """The distance between the ratios of two sets, the longer one cut to the length of the other."""
    r = _inverted(spark, sf, "paraphrase").join(items(spark, sf).select("item", (F.col("split") != "forget").cast("int").alias("side")), "item")
    r = tables.written(r.select("item", "side", F.round("r", 9).alias("r")), "ratios")
    sides = [ranks.add_row_index(r.where(F.col("side") == k), "item", "place") for k in (0, 1)]
    n = min(r.where(F.col("side") == k).count() for k in (0, 1))
    return stats.ks_statistic(sides[0].unionByName(sides[1]).where(F.col("place") < n), "r", "side").select(F.round("ks", 6).alias("ks"), F.col("n0").alias("n"))


@query(f"WITH {ANSWER_SCORES} SELECT item, round(sum(CASE WHEN kind = 'answer' THEN prob END) / (sum(CASE WHEN kind = 'answer' THEN prob END) + sum(CASE WHEN kind = 'perturbed' THEN prob END)), 6) AS value FROM item_scores GROUP BY item HAVING value IS NOT NULL")
def prob_with_options_no_eps(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.probability_with_options(answer_scores(spark, sf), eps=0.0).select("item", F.round("value", 6).alias("value"))


_R1 = """a AS (SELECT item, token, count(*) AS n FROM (SELECT item, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS token FROM items) GROUP BY ALL),
b AS (SELECT item, token, count(*) AS n FROM (SELECT item, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS token FROM items) GROUP BY ALL),
g AS (SELECT i.item, coalesce(sum(CASE WHEN b.n IS NULL THEN 0 ELSE least(a.n, b.n) END) / nullif(sum(a.n), 0), 0) AS rouge FROM items i LEFT JOIN a ON a.item = i.item LEFT JOIN b ON b.item = a.item AND b.token = a.token GROUP BY i.item)"""


@query(f"""WITH {ANSWER_SCORES}, {_R1}, t AS (SELECT item, item % 3 AS s, sum(CASE WHEN kind = 'answer' THEN prob END) AS p, sum(CASE WHEN kind = 'perturbed' THEN prob END) AS q,
  exp(-avg(CASE WHEN kind = 'paraphrase' THEN avg_loss END)) AS a, exp(-avg(CASE WHEN kind = 'perturbed' THEN avg_loss END)) AS b FROM item_scores GROUP BY item),
m AS (SELECT s, avg(CASE WHEN s = 0 THEN p ELSE p / (p + q + 1e-10) END) AS v FROM t GROUP BY s UNION ALL SELECT item % 3, avg(rouge) FROM g GROUP BY 1 UNION ALL SELECT s, avg(greatest(0, 1 - b / (a + 1e-10))) FROM t GROUP BY s)
SELECT count(*) AS n_parts, round(count(*) / sum(1 / v), 6) AS value FROM m""")
def model_utility_nine(spark: SparkSession, sf: str) -> DataFrame:
    """Probability, overlap and truth ratio on three sets (item modulo 3; the first is scored without options)."""
    s, it = answer_scores(spark, sf), items(spark, sf)
    rouge = it.select("item", tx.rouge1_recall(tx.rouge_tokens("answer"), tx.rouge_tokens("question")).alias("value"))
    plain, options, truth = s.where("kind = 'answer'").select("item", F.col("prob").alias("value")), metrics.probability_with_options(s), metrics.truth_ratio(s, "true_better")
    parts = []
    for k in range(3):
        parts += [d.where(F.col("item") % 3 == k).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("v")) for d in (plain if k == 0 else options, rouge, truth)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.count("*").alias("n_parts"), F.round(stats.harmonic_mean(F.col("v")), 6).alias("value"))


@query(f"WITH {DOC_PROBS}, d AS (SELECT doc_id, token, count(*) AS c, any_value(lp_retrain) AS lp FROM scores GROUP BY doc_id, token), n AS (SELECT doc_id, sum(c) AS n FROM d GROUP BY doc_id), s AS (SELECT sum(exp(lp_retrain)) AS pp FROM probs)"
       ", attack AS (SELECT doc_id, any_value(pp) + sum(abs(exp(lp) - c / n) - exp(lp)) AS score FROM d JOIN n USING (doc_id), s GROUP BY doc_id)" + _AUC.format("gradient_norm_1"))
def mia_gradnorm_1_auc(spark: SparkSession, sf: str) -> DataFrame:
    """The 1-norm of p_v - count_v / n over the vocabulary, in closed form for a unigram scorer."""
    s, probs = document_scores(spark, sf)
    n = s.groupBy("doc_id").agg(F.sum("c").alias("n"))
    pp = probs.agg(F.sum(F.exp("lp_retrain")).alias("pp"))
    p, share = F.exp("lp_retrain"), F.col("c") / F.col("n")
    each = s.join(n, "doc_id").groupBy("doc_id").agg(F.sum(F.abs(p - share) - p).alias("d")).join(F.broadcast(pp))
    return _auc(each.select("doc_id", (F.col("pp") + F.col("d")).alias("score")), "gradient_norm_1")


def _bleu_sql() -> str:
    sides = ", ".join(f"{s}{n} AS (SELECT item, g, count(*) AS c FROM (SELECT item, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: list_slice(w, i, i + {n - 1}))) AS g FROM {s} WHERE len(w) >= {n}) GROUP BY ALL)" for s in "ts" for n in range(1, 5))
    hits = ", ".join(f"h{n} AS (SELECT coalesce(sum(least(s{n}.c, t{n}.c)), 0)::DOUBLE AS h, (SELECT sum(c) FROM s{n})::DOUBLE AS k FROM s{n} JOIN t{n} USING (item, g))" for n in range(1, 5))
    product = " + ".join(f"ln(h{n}.h / h{n}.k)" for n in range(1, 5))
    return f"""WITH {ITEMS}, t AS (SELECT item, {WORDS.format('answer')} AS w FROM items), s AS (SELECT item, {WORDS.format("'so ' || answer || ' and ' || question")} AS w FROM items), {sides}, {hits},
l AS (SELECT (SELECT sum(len(w)) FROM t)::DOUBLE AS nt, (SELECT sum(len(w)) FROM s)::DOUBLE AS ns) SELECT round(CASE WHEN least(h1.h, h2.h, h3.h, h4.h) > 0 THEN CASE WHEN ns >= nt THEN 1 ELSE exp(1 - nt / ns) END * exp(({product}) / 4) ELSE 0 END, 6) AS bleu FROM h1, h2, h3, h4, l"""


@query(_bleu_sql())
def corpus_bleu(spark: SparkSession, sf: str) -> DataFrame:
    said = items(spark, sf).withColumn("said", F.concat(F.lit("so "), "answer", F.lit(" and "), "question"))
    return tx.corpus_bleu(said, "answer", "said").select(F.round("bleu", 6).alias("bleu"))


@query("SELECT event_type, total_s, row_number() OVER (ORDER BY total_s DESC, event_type) AS place FROM (SELECT event_type, round(sum(value), 4) AS total_s FROM events GROUP BY event_type)")
def sorted_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = sweep.profile(table(spark, sf, "events"), "event_type", "value").select("event_type", F.round("total_s", 4).alias("total_s"))
    return sweep.by_column(p, "total_s", "event_type")


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 6) AS p1, round(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 6) AS p_inf FROM embeddings")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    v = arrays.doubles(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(arrays.lp_norm(v, 1), 6).alias("p1"), F.round(arrays.lp_norm(v, float("inf")), 6).alias("p_inf"))

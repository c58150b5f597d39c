"""Queries of joins, similarity selection, composition and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise import tables
from lethewise.operators import prep as prep_ops, pruned
from lethewise.operators import ranks, sample, select
from lethewise.operators.metrics import checked_join

from .frames import ANSWER_SCORES, DOCS, ITEMS, WORDS, answer_scores, documents, embeddings, items, table

QUERIES, ORACLE_SQL = {}, {}
K = 40


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-12)"
_SF = f"f AS (SELECT a.vec_id, round(max({_COS}), 9) AS s_f, avg({_COS}) AS mean_f, count(*) AS n FROM embeddings a, embeddings b WHERE a.label >= 2 AND b.label < 2 GROUP BY a.vec_id)"
_SR = f"r AS (SELECT a.vec_id, round(max({_COS}), 9) AS s_r FROM embeddings a, embeddings b WHERE a.label >= 2 AND b.label >= 2 AND a.vec_id <> b.vec_id GROUP BY a.vec_id)"
_MED = "m AS (SELECT s_f AS med FROM (SELECT s_f, row_number() OVER (ORDER BY s_f) AS r, count(*) OVER () AS n FROM f) WHERE r = (n + 1) // 2)"
_TOP = f"top AS (SELECT vec_id, s_f FROM f ORDER BY s_f DESC, vec_id LIMIT {K})"


def _sf(spark: SparkSession, sf: str) -> DataFrame:
    forget, retain = embeddings(spark, sf)
    return select.similarity(retain, forget).select("vec_id", F.round("max_sim", 9).alias("s_f"))


def _both(spark: SparkSession, sf: str) -> DataFrame:
    _, retain = embeddings(spark, sf)
    s_r = select.similarity(retain, retain, not_self=True).select("vec_id", F.round("max_sim", 9).alias("s_r"))
    return _sf(spark, sf).join(s_r, "vec_id")


@query(f"WITH {_SF} SELECT vec_id, round(s_f, 6) AS max_sim, round(mean_f, 6) AS mean_sim, n AS n_pairs FROM f")
def all_pairs_cosine(spark: SparkSession, sf: str) -> DataFrame:
    forget, retain = embeddings(spark, sf)
    s = select.similarity(retain, forget)
    return s.select("vec_id", F.round(F.round("max_sim", 9), 6).alias("max_sim"), F.round(F.col("sum_sim") / F.col("n_pairs"), 6).alias("mean_sim"), "n_pairs")


@query(f"WITH {_SR} SELECT vec_id, round(s_r, 6) AS max_sim FROM r")
def self_similarity(spark: SparkSession, sf: str) -> DataFrame:
    _, retain = embeddings(spark, sf)
    return select.similarity(retain, retain, not_self=True).select("vec_id", F.round(F.round("max_sim", 9), 6).alias("max_sim"))


@query(f"WITH {_SF}, {_TOP} SELECT vec_id, round(s_f, 6) AS max_sim FROM top ORDER BY vec_id")
def rsub_topk_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """As ``rsub_topk``, with cells of the forget side that can't hold anything better skipped."""
    forget, retain = embeddings(spark, sf)
    found, _ = pruned.top_k_pruned(retain, forget, K)
    return found.select("vec_id", F.round(F.round("max_sim", 9), 6).alias("max_sim"))


@query(f"WITH {_SF}, {_TOP} SELECT vec_id, round(s_f, 6) AS max_sim FROM top ORDER BY vec_id")
def rsub_topk(spark: SparkSession, sf: str) -> DataFrame:
    return select.top_k(_sf(spark, sf), K, "s_f").select("vec_id", F.round("s_f", 6).alias("max_sim")).orderBy("vec_id")


@query(f"WITH {_SF}, {_TOP} SELECT vec_id, round(s_f, 6) AS score FROM top")
def rsub_variants_forget(spark: SparkSession, sf: str) -> DataFrame:
    return select.top_k(_sf(spark, sf), K, "s_f").select("vec_id", F.round("s_f", 6).alias("score"))


@query(f"WITH {_SF}, {_SR}, {_MED} SELECT vec_id, round(s_r, 6) AS score FROM (SELECT vec_id, s_r FROM f JOIN r USING (vec_id), m WHERE s_f < med ORDER BY s_r DESC, vec_id LIMIT {K})")
def rsub_variants_retain(spark: SparkSession, sf: str) -> DataFrame:
    return select.gated_top_k(_both(spark, sf), K).select("vec_id", F.round("s_r", 6).alias("score"))


@query(f"WITH {_SF}, {_SR} SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, round(s_f + s_r, 9) AS s FROM f JOIN r USING (vec_id) ORDER BY s DESC, vec_id LIMIT {K})")
def rsub_variants_both(spark: SparkSession, sf: str) -> DataFrame:
    scored = _both(spark, sf).withColumn("s", F.round(F.col("s_f") + F.col("s_r"), 9))
    return select.top_k(scored, K, "s").select("vec_id", F.round("s", 6).alias("score"))


_FRACTION = f"""WITH {_SF}, k AS (SELECT greatest(1, CAST(round_even(0.25::DOUBLE * count(*), 0) AS BIGINT)) AS k FROM f),
ranked AS (SELECT vec_id, row_number() OVER (ORDER BY s_f DESC, vec_id) AS r FROM f)
SELECT vec_id, r <= k AS in_rsub FROM ranked, k"""


@query(_FRACTION)
def rsub_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return select.top_share(tables.written(_sf(spark, sf), "scored"), 0.25, "s_f", name="in_rsub").select("vec_id", "in_rsub")


@query(f"WITH {_SF}, {_TOP} SELECT vec_id, label FROM embeddings SEMI JOIN top USING (vec_id)")
def rsub_semi(spark: SparkSession, sf: str) -> DataFrame:
    _, retain = embeddings(spark, sf)
    return select.in_set(retain, rsub_topk(spark, sf), "vec_id").select("vec_id", "label")


@query(f"WITH {_SF}, {_TOP} SELECT vec_id, label FROM embeddings e ANTI JOIN top USING (vec_id) WHERE label >= 2")
def rfar_anti(spark: SparkSession, sf: str) -> DataFrame:
    _, retain = embeddings(spark, sf)
    return select.not_in_set(retain, rsub_topk(spark, sf), "vec_id").select("vec_id", "label")


@query(f"WITH {_SF}, {_TOP} SELECT vec_id, CASE WHEN label < 2 OR vec_id IN (SELECT vec_id FROM top) THEN 0 ELSE 1 END AS role FROM embeddings")
def role_compose_a1(spark: SparkSession, sf: str) -> DataFrame:
    forget, retain = (x.select("vec_id") for x in embeddings(spark, sf))
    return select.compose_a1(forget, retain, rsub_topk(spark, sf), "vec_id")


@query(f"WITH {_SF}, {_TOP} SELECT vec_id, CASE WHEN vec_id IN (SELECT vec_id FROM top) THEN 0 ELSE 1 END AS role FROM embeddings")
def role_compose_a2(spark: SparkSession, sf: str) -> DataFrame:
    forget, retain = (x.select("vec_id") for x in embeddings(spark, sf))
    return select.compose_a2(forget, retain, rsub_topk(spark, sf), "vec_id")


@query(f"WITH {_SF}, {_TOP}, roles AS (SELECT CASE WHEN label < 2 OR vec_id IN (SELECT vec_id FROM top) THEN 0 ELSE 1 END AS role FROM embeddings) SELECT role, count(*) AS n FROM roles GROUP BY role")
def role_counts(spark: SparkSession, sf: str) -> DataFrame:
    return role_compose_a1(spark, sf).groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT vec_id, count(*) AS n FROM (SELECT vec_id FROM embeddings WHERE label < 2 UNION ALL SELECT vec_id FROM embeddings WHERE label < 2) GROUP BY vec_id")
def expand_fallback(spark: SparkSession, sf: str) -> DataFrame:
    forget, _ = embeddings(spark, sf)
    return select.expanded_or_doubled(forget.select("vec_id"), None).groupBy("vec_id").agg(F.count("*").alias("n"))


@query(f"WITH {ANSWER_SCORES} SELECT item, round(max(CASE WHEN kind = 'answer' THEN avg_loss END), 6) AS correct_loss, round(max(CASE WHEN kind = 'paraphrase' THEN avg_loss END), 6) AS other_loss FROM item_scores WHERE kind <> 'perturbed' GROUP BY item")
def index_join(spark: SparkSession, sf: str) -> DataFrame:
    s = answer_scores(spark, sf)
    a, b = (s.where(F.col("kind") == k).select("item", F.round("avg_loss", 6).alias(c)) for k, c in (("answer", "correct_loss"), ("paraphrase", "other_loss")))
    return checked_join(a, b, "item")


@query("SELECT doc_id, CAST(v AS INTEGER) AS view_no FROM documents, (SELECT unnest([0, 1, 2]) AS v) WHERE NOT (doc_id IN (SELECT doc_id FROM labels) AND v = 0)")
def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("view_no"))
    done = table(spark, sf, "labels").select("doc_id", F.lit(0).alias("view_no"))
    return jobs.join(done, ["doc_id", "view_no"], "left_anti")


_H = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@query(f"""WITH {DOCS}, f AS (SELECT doc_id FROM docs WHERE split = 'forget'), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM docs WHERE split <> 'forget')
SELECT f.doc_id AS forget_id, r.doc_id AS retain_id FROM f JOIN r ON {_H.format("'42|' || f.doc_id")} % r.n = r.i""")
def anchor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("doc_id", "split")
    others = ranks.add_row_index(d.where("split <> 'forget'").select(F.col("doc_id").alias("retain_id")), "retain_id", "i")
    anchors = d.where("split = 'forget'").select(F.col("doc_id").alias("forget_id"))
    return sample.random_partner(anchors, others, "i", d.where("split <> 'forget'").count(), "forget_id").select("forget_id", "retain_id")


@query(f"""WITH {ITEMS}, b AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark)
SELECT item, question, text AS refusal FROM items JOIN b ON {_H.format("'7|' || item")} % n = i""")
def random_refusal(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    others = ranks.add_row_index(b.select("item_id", F.col("text").alias("refusal")), "item_id", "i")
    return sample.random_partner(items(spark, sf), others, "i", b.count(), "item", seed=7).select("item", "question", "refusal")


@query(rf"""WITH {ITEMS}, q AS (SELECT item, unnest(list_slice(list_sort(list_distinct({WORDS.format('question')})), 1, 4)) AS a FROM items),
w AS (SELECT item, unnest(list_slice(list_sort(list_distinct({WORDS.format('answer')})), 1, 4)) AS b FROM items)
SELECT item, a, b FROM (SELECT item, a, b, row_number() OVER (PARTITION BY item ORDER BY a, b) AS r FROM q JOIN w USING (item)) WHERE r <= 5""")
def qa_cross_expand(spark: SparkSession, sf: str) -> DataFrame:
    from lethewise.functions.text import words

    it = items(spark, sf).select("item", prep_ops.set_list(words("question"), 4).alias("qs"), prep_ops.set_list(words("answer"), 4).alias("ans"))
    pairs = F.flatten(F.transform("qs", lambda q: F.transform("ans", lambda a: F.struct(q.alias("a"), a.alias("b")))))
    return it.select("item", F.explode(F.slice(pairs, 1, 5)).alias("p")).select("item", "p.a", "p.b")


@query(f"WITH {ITEMS}, s AS (SELECT count(*) AS n, sum(length(question) + length(answer)) AS c FROM (SELECT * FROM items ORDER BY item LIMIT 3)) SELECT item, CAST(n AS BIGINT) AS n_shots, CAST(c AS BIGINT) AS shot_chars FROM items, s")
def few_shot(spark: SparkSession, sf: str) -> DataFrame:
    it = items(spark, sf)
    chars = F.aggregate("shots", F.lit(0), lambda a, s: a + F.length(s["question"]) + F.length(s["answer"]))
    return prep_ops.few_shot(it, ranks.head_n(it, "item", 3), "item").select("item", F.size("shots").cast("long").alias("n_shots"), chars.cast("long").alias("shot_chars"))


@query("""SELECT a2, w1, w2, CAST(row_number() OVER (ORDER BY a2, w1, w2) - 1 AS BIGINT) AS config FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS a2 FROM lineitem),
(SELECT DISTINCT -CAST(l_discount AS DOUBLE) AS w1 FROM lineitem), (SELECT DISTINCT CAST(l_tax AS DOUBLE) AS w2 FROM lineitem)""")
def weight_grid(spark: SparkSession, sf: str) -> DataFrame:
    """All combinations of the settings that a table of runs has on its axes (line items stand for runs)."""
    from lethewise.plans.sweep import grid_of

    runs = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("a2"), (-F.col("l_discount").cast("double")).alias("w1"), F.col("l_tax").cast("double").alias("w2"))
    return grid_of(runs, ["a2", "w1", "w2"])


@query("""SELECT source AS metric, round(avg(n_chars), 6) AS value, CASE WHEN source IN (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) THEN 1.0::DOUBLE END AS reference FROM documents GROUP BY source""")
def reference_lookup(spark: SparkSession, sf: str) -> DataFrame:
    from lethewise.plans.metric_plan import with_reference

    d = table(spark, sf, "documents")
    mine = d.groupBy(F.col("source").alias("metric")).agg(F.round(F.avg("n_chars"), 6).alias("value"))
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    logged = d.join(toxic, "doc_id", "left_semi").select(F.col("source").alias("metric")).distinct().withColumn("value", F.lit(1.0))
    return with_reference(mine, logged)


@query("""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents WHERE lang = 'fr'), l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents WHERE lang = 'en'),
k AS (SELECT (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM l) AS nl), q AS (SELECT ns, CAST(round_even(nl::DOUBLE / ns, 0) AS BIGINT) AS ratio FROM k),
u AS (SELECT doc_id, i * (ratio + 1) AS slot FROM s, q UNION ALL SELECT doc_id, (i // ratio) * (ratio + 1) + 1 + i % ratio FROM l, q WHERE i // ratio < ns)
SELECT doc_id, CAST(slot AS BIGINT) AS slot FROM u""")
def balanced_interleave(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang")
    sides = [ranks.add_row_index(d.where(F.col("lang") == v), "doc_id", "i") for v in ("fr", "en")]
    n_short, n_long = (F.lit(d.where(F.col("lang") == v).count()) for v in ("fr", "en"))
    both = sides[0].unionByName(sides[1])
    slot = sample.balanced_slots(F.col("i"), F.col("lang") == "fr", n_short, n_long)
    return both.select("doc_id", slot.cast("long").alias("slot")).where("slot is not null")


@query("""WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () // 2 * 2 AS n FROM documents), h AS (SELECT doc_id, CASE WHEN i < n // 2 THEN 0 ELSE 1 END AS h, CASE WHEN i < n // 2 THEN i ELSE i - n // 2 END AS o FROM t WHERE i < n)
SELECT doc_id, row_number() OVER (ORDER BY (o // 8) * 16 + h * 8 + o % 8) - 1 AS place FROM h""")
def block_interleave(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id")
    n = d.count() // 2 * 2
    slots = ranks.add_row_index(d, "doc_id", "i").where(F.col("i") < n).withColumn("slot", sample.block_slot(F.col("i"), F.lit(n), 8))
    return ranks.add_row_index(slots, "slot", "place").select("doc_id", "place")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_H.format("'42|' || doc_id")}, doc_id) - 1 AS place FROM documents")
def hash_permutation(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", ranks.hash_number(42, "doc_id").alias("h"))
    return ranks.add_row_index(d, "h", "place", ties=["doc_id"]).select("doc_id", "place")


@query("WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM labels) SELECT doc_id FROM a WHERE doc_id IN (SELECT doc_id FROM b)")
def key_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def union_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return select.union_overwrite(old, table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT DISTINCT split_part(p_type, ' ', -1) AS suffix FROM part WHERE p_brand <> 'lm_head'")
def distinct_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_brand <> 'lm_head'").select(F.substring_index("p_type", " ", -1).alias("suffix")).distinct()


@query("SELECT o_orderpriority AS split, arg_max(o_orderkey, o_orderkey) AS latest FROM orders GROUP BY 1")
def latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string"))
    step = F.regexp_extract(path, r"-(\d+)$", 1).cast("long")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("split")).agg(F.max_by(step, step).alias("latest"))

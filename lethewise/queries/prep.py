"""Queries of corpus preparation and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise.functions import text as tx
from lethewise.operators import prep, ranks

from .frames import ANSWERS, DOCS, ITEMS, SPLIT, WORDS, answers, documents, items, pairs, split_of, table

QUERIES, ORACLE_SQL = {}, {}
CHUNK = 256


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS \"index\" FROM documents")
def add_row_index(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.add_row_index(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 300")
def head_n(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.head_n(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 300)


@query(f"WITH {DOCS} SELECT doc_id, lang FROM docs WHERE split = 'retain' ORDER BY doc_id DESC LIMIT (SELECT least(count(*) FILTER (split = 'forget'), count(*) FILTER (split = 'retain')) FROM docs)")
def tail_n(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("doc_id", "lang", "split")
    return ranks.tail_n(d.where("split = 'retain'"), "doc_id", d.where("split = 'forget'").count()).drop("split")


@query("SELECT doc_id, '' AS prefix, coalesce(lang, '') AS lang FROM documents")
def optional_column_default(spark: SparkSession, sf: str) -> DataFrame:
    return prep.with_defaults(table(spark, sf, "documents"), {"prefix": "", "lang": ""}).select("doc_id", "prefix", "lang")


@query("SELECT doc_id, text AS body FROM documents")
def rename_drop(spark: SparkSession, sf: str) -> DataFrame:
    return prep.renamed(table(spark, sf, "documents").drop("lang", "source", "n_chars", "no_such_column"), "text", "body")


@query(rf"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
c AS (SELECT doc_id, unnest(range(0, (len(w) + 255) // 256)) AS chunk_idx, w FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, CAST(least(256, len(w) - 256 * chunk_idx) AS BIGINT) AS n_tokens FROM c WHERE len(w) - 256 * chunk_idx >= 16""")
def min_len_chunks(spark: SparkSession, sf: str) -> DataFrame:
    own = prep.row_chunks(table(spark, sf, "documents").select("doc_id", "text"), tx.words("text"), CHUNK, min_tokens=16)
    return own.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.size("tokens").cast("long").alias("n_tokens"))


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents)
WHERE trim(s) <> '' GROUP BY doc_id""")
def blank_filter(spark: SparkSession, sf: str) -> DataFrame:
    lines = prep.not_blank(table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")), "line")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.hash_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT 'forget' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS forget_split, 'retain' || lpad(CAST(100 - n_nationkey AS VARCHAR), 2, '0') AS retain_split FROM nation")
def split_name(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "nation").select(F.concat(F.lit("forget"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("forget_split"))
    return named.withColumn("retain_split", prep.retain_split_name("forget_split"))


@query(rf"""WITH {ITEMS}, t AS (SELECT item, len({WORDS.format('question')}) AS q, len({WORDS.format('question')}) + len({WORDS.format('answer')}) AS n FROM items)
SELECT item, CAST(n AS BIGINT) AS n_tokens, CAST(n - least(n, greatest(q, 1)) AS BIGINT) AS n_targets FROM t""")
def label_mask(spark: SparkSession, sf: str) -> DataFrame:
    it = items(spark, sf)
    q, both = tx.words("question"), F.concat(tx.words("question"), tx.words("answer"))
    mask = prep.target_mask(both, F.size(q))
    return it.select("item", F.size(both).cast("long").alias("n_tokens"), F.size(F.filter(mask, lambda m: m)).cast("long").alias("n_targets"))


@query(rf"""WITH {ITEMS} SELECT item, CAST(least(len({WORDS.format('question')}) + len({WORDS.format('answer')}), len({WORDS.format('question')}) + 32) AS BIGINT) AS n_tokens,
md5(list_aggregate(list_slice(list_concat({WORDS.format('question')}, {WORDS.format('answer')}), 1, len({WORDS.format('question')}) + 32), 'string_agg', ' ')) AS digest FROM items""")
def truncate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    q = tx.words("question")
    cut = tx.truncated(F.concat(q, tx.words("answer")), F.size(q) + 32)
    return items(spark, sf).select("item", F.size(cut).cast("long").alias("n_tokens"), F.md5(F.array_join(cut, " ")).alias("digest"))


@query("""SELECT p_partkey, p_type || '/' || split_part(p_brand || ',none', ',', 1) AS metric, TRY_CAST(p_size AS DOUBLE) AS value FROM part WHERE p_brand <> 'alias'""")
def metric_key_clean(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("task"), F.concat("p_brand", F.lit(",none")).alias("name"), F.col("p_size").cast("string").alias("value"))
    return prep.clean_metric_keys(raw).select("p_partkey", "metric", "value")


_GLOBAL = rf"""WITH {DOCS}, w AS (SELECT doc_id, split, {WORDS.format('text')} AS w FROM docs),
s AS (SELECT *, sum(len(w)) OVER (PARTITION BY split ORDER BY doc_id) - len(w) AS base FROM w),
t AS (SELECT split, base + unnest(range(0, len(w))) AS place, unnest(w) AS token FROM s)"""


@query(_GLOBAL + """ SELECT split, CAST(place // 256 AS BIGINT) AS chunk_idx, count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY place)) AS digest FROM t GROUP BY ALL""")
def concat_chunk(spark: SparkSession, sf: str) -> DataFrame:
    chunks = prep.corpus_chunks(documents(spark, sf), "split", "doc_id", tx.words("text"), CHUNK)
    return chunks.select("split", "chunk_idx", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(_GLOBAL + """ SELECT split, CAST(v AS INTEGER) AS view_no, CAST((place - 128 * v) // 256 AS BIGINT) AS chunk_idx, count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY place)) AS digest
FROM t, (SELECT unnest([0, 1]) AS v) WHERE place >= 128 * v GROUP BY ALL HAVING count(*) >= 16""")
def multi_view_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = prep.corpus_chunks(documents(spark, sf), "split", "doc_id", tx.words("text"), CHUNK, views=2, min_tokens=16)
    return chunks.select("split", "view_no", "chunk_idx", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"""WITH {ITEMS}, shots AS (SELECT string_agg('[INST] ' || question || ' [/INST]' || answer || chr(10), '' ORDER BY item) AS s FROM (SELECT * FROM items ORDER BY item LIMIT 3))
SELECT item, md5('Answer briefly.' || chr(10) || s || '[INST] ' || question || ' [/INST]') AS digest FROM items, shots""")
def prompt_template(spark: SparkSession, sf: str) -> DataFrame:
    it = items(spark, sf)
    return prep.few_shot(it, ranks.head_n(it, "item", 3), "item").select("item", F.md5(tx.prompt(F.col("question"), F.col("shots"), "Answer briefly.\n")).alias("digest"))


@query("""SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""")
def chat_render(spark: SparkSession, sf: str) -> DataFrame:
    return prep.rendered_chat(table(spark, sf, "conversations"))


@query(f"WITH {ITEMS} SELECT item, 'Q: ' || question || chr(10) || 'A: ' || answer AS qa FROM items")
def qa_text(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("item", tx.qa_text(F.col("question"), F.col("answer")).alias("qa"))


@query(f"WITH {ITEMS} SELECT item, '[INST]  ' || question || '  [/INST]' || answer AS evaluation, '[INST] ' || trim(question) || ' [/INST]' AS training FROM items")
def qa_templates(spark: SparkSession, sf: str) -> DataFrame:
    q, a = F.col("question"), F.col("answer")
    return items(spark, sf).select("item", tx.qa_template(q, a).alias("evaluation"), tx.instruction(q).alias("training"))


@query(f"WITH {ITEMS} SELECT item, trim(replace(question || ' ' || answer, question, '')) AS truth FROM items")
def strip_prompt(spark: SparkSession, sf: str) -> DataFrame:
    q, a = F.col("question"), F.col("answer")
    return items(spark, sf).select("item", tx.strip_prompt(tx.joined_prefix(q, a), q).alias("truth"))


@query(f"WITH {ITEMS} SELECT item, trim(split_part(split_part(answer, '.', 1), chr(10), 1)) AS cut FROM items")
def stop_cut(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("item", tx.stop_cut(F.col("answer"), [".", "\n"]).alias("cut"))


@query(rf"""WITH {ITEMS}, t AS (SELECT item, list_concat({WORDS.format('question')}, {WORDS.format('answer')}) AS w, greatest(len({WORDS.format('question')}), 1) AS p FROM items)
SELECT item, coalesce(list_aggregate(list_slice(w, p + 1, len(w)), 'string_agg', ' '), '') AS target FROM t""")
def target_text(spark: SparkSession, sf: str) -> DataFrame:
    q = tx.words("question")
    return items(spark, sf).select("item", tx.target_text(F.concat(q, tx.words("answer")), F.greatest(F.size(q), F.lit(1))).alias("target"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n_tokens FROM documents""")
def rouge_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(tx.rouge_tokens("text")).cast("long").alias("n_tokens"))


_ROUGE1 = f"""WITH {ITEMS}, a AS (SELECT item, token, count(*) AS n FROM (SELECT item, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS token FROM items) GROUP BY ALL),
b AS (SELECT item, token, count(*) AS n FROM (SELECT item, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS token FROM items) GROUP BY ALL)
SELECT item, round(coalesce(sum(hit) / nullif(sum(an), 0), 0), 6) AS rouge1_recall FROM (
  SELECT i.item, CASE WHEN b.n IS NULL THEN 0 ELSE least(a.n, b.n) END AS hit, coalesce(a.n, 0) AS an FROM items i LEFT JOIN a ON a.item = i.item LEFT JOIN b ON b.item = a.item AND b.token = a.token) GROUP BY item"""


@query(_ROUGE1)
def rouge1_recall(spark: SparkSession, sf: str) -> DataFrame:
    recall = tx.rouge1_recall(tx.rouge_tokens("answer"), tx.rouge_tokens("question"))
    return items(spark, sf).select("item", F.round(recall, 6).alias("rouge1_recall"))


@query()
def rougeL(spark: SparkSession, sf: str) -> DataFrame:
    r = tx.rouge(items(spark, sf).select("item", "question", "answer"), "answer", "question")
    return r.select("item", F.round("rougeL_recall", 6).alias("rougeL_recall"), F.round("rougeL_f1", 6).alias("rougeL_f1"))


@query()
def rougeL_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    r = tx.rouge(items(spark, sf).select("item", "question", "answer"), "answer", "question", stemmer=True)
    return r.select("item", F.round("rougeL_recall", 6).alias("rougeL_recall"))


@query()
def zlib_len(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.zlib_length("text").alias("n_bytes"))


@query("SELECT p_partkey, replace(replace(CAST(p_size AS VARCHAR) || '.5-' || p_brand, '.', 'p'), '-', 'm') AS tag FROM part")
def tag_slug(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.col("p_size").cast("string"), F.lit(".5-"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", tx.slug(raw).alias("tag"))


@query(rf"""WITH {ITEMS}, t AS (SELECT item, {WORDS.format('answer')} AS w FROM items)
SELECT item, CAST(least(len(w), 64) AS BIGINT) AS n_true, list_concat(list_transform(list_slice(w, 1, 64), lambda x: 1), list_transform(range(0, greatest(0, 64 - len(w))), lambda x: 0)) AS mask FROM t""")
def pad_mask(spark: SparkSession, sf: str) -> DataFrame:
    n = F.least(F.size(tx.words("answer")), F.lit(64))
    return items(spark, sf).select("item", n.cast("long").alias("n_true"), tx.true_mask(n, 64).alias("mask"))

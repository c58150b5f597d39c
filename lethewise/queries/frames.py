"""The driver's tables in the roles of the reference's data, in Spark and in SQL.

``documents`` are split by ``doc_id % 10``: 0 forget, 1 holdout, else retain. Question and answer items are a user turn
and the assistant turn behind it. Embeddings with label 0 or 1 are the forget side. Every row of a table has a role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise import tables
from lethewise.functions import text as tx
from lethewise.operators import ranks, scoring

MODELS = ["target", "retrain", "reference"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: str) -> Column:
    part = F.col(key) % 10
    return F.when(part == 0, "forget").when(part == 1, "holdout").otherwise("retain")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("split", split_of("doc_id"))


def embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Forget and retain vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.where("label < 2"), e.where("label >= 2")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, split, question, answer."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"]).withColumn("split", split_of("conv_id"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item (from 0), split, question, answer."""
    p = pairs(spark, sf_dir).withColumn("_key", F.col("conv_id") * 100000 + F.col("turn"))
    return tables.written(ranks.add_row_index(p, "_key", "item").select("item", "conv_id", "split", "question", "answer"), "items")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: item, kind (answer, paraphrase, perturbed), answer_pos, text. The answers of the next three items stand
    for wrong ones."""
    it = items(spark, sf_dir)
    n = it.agg(F.count("*").alias("n"))
    right = it.select("item", F.lit("answer").alias("kind"), F.lit(0).alias("answer_pos"), F.col("answer").alias("text"))
    other = it.select("item", F.lit("paraphrase").alias("kind"), F.lit(0).alias("answer_pos"), F.concat(F.lit("so "), "answer").alias("text"))
    moved = it.join(F.broadcast(n)).select(F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("o"), "*")
    wrong = moved.select(((F.col("item") - F.col("o") + 3 * F.col("n")) % F.col("n")).alias("item"), F.lit("perturbed").alias("kind"), F.col("o").alias("answer_pos"), F.col("answer").alias("text"))
    return right.unionByName(other).unionByName(wrong)


def document_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counted tokens of every document with log p under the three models, and the vocabulary's log p."""
    rows = {"target": F.lit(True), "retrain": F.col("split") == "retain", "reference": F.col("split") == "holdout"}
    return scoring.counted_scores(document_tokens(spark, sf_dir).drop("pos"), ["doc_id", "split"], rows)


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, split, pos, token."""
    return scoring.exploded(documents(spark, sf_dir), tx.words("text"), "doc_id", "split")


def answer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, kind, answer_pos, pos, token."""
    return scoring.exploded(answers(spark, sf_dir), tx.words("text"), "item", "kind", "answer_pos")


def answer_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the answers: all of them, and those outside the forget split."""
    it = items(spark, sf_dir)
    tokens = scoring.exploded(it, tx.words(F.concat(F.lit("so "), "answer")), "split")
    counts = scoring.unigram_counts(tokens, {"target": F.lit(True), "retrain": F.col("split") != "forget"})
    return scoring.unigram_logprobs(counts, ["target", "retrain"])


def answer_scores(spark: SparkSession, sf_dir: str, model: str = "target") -> DataFrame:
    """Per item and answer: n_tokens, sum_loss, avg_loss, prob."""
    s = scoring.token_scores(answer_tokens(spark, sf_dir), answer_logprobs(spark, sf_dir))
    return tables.written(scoring.item_scores(s, ["item", "kind", "answer_pos"], f"lp_{model}"), "answer-scores")


# -- the same in SQL --------------------------------------------------------------------------------------------------

WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '\S+')"
SPLIT = "CASE WHEN {0} % 10 = 0 THEN 'forget' WHEN {0} % 10 = 1 THEN 'holdout' ELSE 'retain' END"


def unnested(of: str, source: str, *keys: str) -> str:
    """Rows (keys, pos, token) of a list column ``of``."""
    k = ", ".join(keys)
    return f"SELECT {k}, unnest(range(0, len(w))) AS pos, unnest(w) AS token FROM (SELECT {k}, {of} AS w FROM {source})"


DOCS = f"docs AS (SELECT *, {SPLIT.format('doc_id')} AS split FROM documents)"
ITEMS = f"""items AS (
  SELECT row_number() OVER (ORDER BY q.conv_id, q.turn) - 1 AS item, q.conv_id, {SPLIT.format('q.conv_id')} AS split, q.text AS question, a.text AS answer
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant')"""
ANSWERS = f"""{ITEMS}, answers AS (
  SELECT item, 'answer' AS kind, 0 AS answer_pos, answer AS text FROM items
  UNION ALL SELECT item, 'paraphrase', 0, 'so ' || answer FROM items
  UNION ALL SELECT (item - o + 3 * n) % n, 'perturbed', o, answer FROM items, (SELECT count(*) AS n FROM items), (SELECT unnest([1, 2, 3]) AS o))"""
DOC_TOKENS = f"{DOCS}, tokens AS ({unnested(WORDS.format('text'), 'docs', 'doc_id', 'split')})"
DOC_PROBS = f"""{DOC_TOKENS}, counts AS (
  SELECT token, count(*) AS c_target, count(*) FILTER (split = 'retain') AS c_retrain, count(*) FILTER (split = 'holdout') AS c_reference FROM tokens GROUP BY token
), probs AS (
  SELECT token, {', '.join(f"ln((c_{m} + 1) / (sum(c_{m}) OVER () + count(*) OVER ())) AS lp_{m}" for m in MODELS)} FROM counts
), scores AS (SELECT doc_id, split, pos, token, lp_target, lp_retrain, lp_reference FROM tokens JOIN probs USING (token))"""
ANSWER_SCORES = f"""{ANSWERS}, model_tokens AS ({unnested(WORDS.format("'so ' || answer"), 'items', 'split')}
), counts AS (SELECT token, count(*) AS c_target, count(*) FILTER (split <> 'forget') AS c_retrain FROM model_tokens GROUP BY token
), probs AS (SELECT token, {', '.join(f"ln((c_{m} + 1) / (sum(c_{m}) OVER () + count(*) OVER ())) AS lp_{m}" for m in ('target', 'retrain'))} FROM counts
), answer_tokens AS ({unnested(WORDS.format('text'), 'answers', 'item', 'kind', 'answer_pos')}
), token_scores AS (SELECT * FROM answer_tokens JOIN probs USING (token)
), item_scores AS (
  SELECT item, kind, answer_pos, count(*) AS n_tokens, -sum(lp_target) AS sum_loss, -avg(lp_target) AS avg_loss, exp(avg(lp_target)) AS prob,
    -sum(lp_retrain) AS sum_loss_ref, -avg(lp_retrain) AS avg_loss_ref FROM token_scores GROUP BY ALL)"""
